"""Registered queries: name -> (spark, folder) -> DataFrame.

Each one reads the given tables as a whole.  Computed doubles are rounded so that
they compare with plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.functions import scores as S
from civilspark.functions import text as T
from civilspark.functions.tokens import word_tokens
from civilspark.operators import (
    features,
    metrics,
    models,
    prepare,
    scoring,
    vocabulary,
)
from civilspark.operators.sizes import likely_in
from civilspark.plans import jobs
from civilspark.session import materialise, read_table, shared_folder
from civilspark.sources import readers, split_csv, writers
from civilspark.streaming import comments as streaming

VOCAB_QUERY_SIZE = 20000
POOL_VECTOR_SIZE = 64


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "conversations")


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents as short comments."""
    return readers.lines_to_rows(documents(spark, folder), "text", keep=["doc_id"])


# ---- preparation -----------------------------------------------------------


def profile_nulls(spark, folder):
    return prepare.profile(read_table(spark, folder, "documents"))


def dedupe_keep_first(spark, folder):
    return prepare.drop_duplicate_texts(documents(spark, folder), "text", "doc_id")


def dedupe_counts(spark, folder):
    return prepare.duplicate_counts(documents(spark, folder), "text")


def class_distribution(spark, folder):
    docs = documents(spark, folder)
    keyed = docs.select("doc_id", "lang", prepare.text_key(F.col("text")).alias("key"))
    keyed = materialise(keyed, "keys")
    kept = keyed.join(prepare.copy_ids(keyed, "key", "doc_id"), "doc_id", "left_anti")
    return prepare.class_distribution(kept, "lang")


def min_length_filter(spark, folder):
    lines = documents(spark, folder).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )
    return prepare.min_length_filter(lines, "line")


def stratified_split(spark, folder):
    return jobs.prepare_dataset(documents(spark, folder), "text", "lang", "doc_id")


def split_summary(spark, folder):
    return prepare.split_summary(stratified_split(spark, folder))


# ---- sources ---------------------------------------------------------------


def lines_to_rows(spark, folder):
    return document_lines(spark, folder)


def detect_text_column(spark, folder):
    return readers.comments_from_table(
        read_table(spark, folder, "conversations"), keep=["conv_id", "turn"]
    )


def csv_roundtrip(spark, folder):
    """Documents as CSV files, read back by several tasks per file."""
    docs, path = documents(spark, folder), shared_folder(spark, "documents-csv")
    writers.write_report(docs, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return split_csv.read_csv_in_parts(spark, path, schema)


def split_roundtrip(spark, folder):
    """Whole rows of the dataset, written by split and read back split by split."""
    docs, path = documents(spark, folder), shared_folder(spark, "splits")
    split = materialise(jobs.prepare_dataset(docs, "text", "lang", "doc_id"), "split")
    writers.write_splits(jobs.attach_split(docs, split, "doc_id"), path)
    parts = [
        writers.read_split(spark, path, name).withColumn("split", F.lit(name))
        for name in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report_roundtrip(spark, folder):
    """The flat report as CSV files, read back."""
    report, path = batch_report(spark, folder), shared_folder(spark, "report")
    writers.write_report(report, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in report.schema)
    return split_csv.read_csv_in_parts(spark, path, schema)


def vocab_roundtrip(spark, folder):
    """The vocabulary as one JSON document, read back."""
    path = shared_folder(spark, "vocabulary")
    writers.write_vocabulary_document(vocab_topk(spark, folder), path)
    return writers.read_vocabulary_document(spark, path)


# ---- normalisation ---------------------------------------------------------


def non_string_text(spark, folder):
    """Numbers as texts; missing ones normalise to the empty string."""
    number = F.when(F.col("lang") == "en", F.col("n_chars"))
    return documents(spark, folder).select("doc_id", T.clean_text(number).alias("cleaned"))


def _page_text() -> Column:
    return F.concat_ws(" ", "url", "html")


def url_mention_mask(spark, folder):
    masked = T.mask_mentions(T.mask_urls(_page_text()))
    return pages(spark, folder).select("page_id", masked.alias("masked"))


def mention_mask(spark, folder):
    return documents(spark, folder).select(
        "doc_id", T.mask_mentions(F.col("text")).alias("masked")
    )


def collapse_repeats(spark, folder):
    return documents(spark, folder).select(
        "doc_id", T.collapse_repeats(F.col("text")).alias("collapsed")
    )


def squash_whitespace(spark, folder):
    return documents(spark, folder).select(
        "doc_id", T.squash_whitespace(F.col("text")).alias("squashed")
    )


def lowercase_fold(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.lower(T.fold_unicode(F.col("text"))).alias("folded")
    )


def html_unescape(spark, folder):
    return pages(spark, folder).select(
        "page_id", T.unescape_html(F.col("html")).alias("unescaped")
    )


def leet_decode(spark, folder):
    return documents(spark, folder).select(
        "doc_id", T.decode_leet(F.lower("text")).alias("decoded")
    )


def clean_text(spark, folder):
    return (
        documents(spark, folder)
        .select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))
        .withColumn("model_text", T.decode_leet(F.col("cleaned")))
    )


def clean_pages(spark, folder):
    return pages(spark, folder).select(
        "page_id", T.clean_text(_page_text()).alias("cleaned")
    )


# ---- tokens, vocabulary, features ------------------------------------------


def token_frequency(spark, folder):
    return vocabulary.token_frequency(documents(spark, folder), "text")


def vocab_topk(spark, folder, size: int = VOCAB_QUERY_SIZE):
    return vocabulary.build_vocabulary(
        documents(spark, folder), "text", "doc_id", max_vocab_size=size
    )


def _encoded(spark, folder, vocab):
    return vocabulary.encode(
        conversations(spark, folder), ["conv_id", "turn"], "text", vocab
    )


def encode_tokens(spark, folder):
    encoded = _encoded(spark, folder, vocab_topk(spark, folder))
    return encoded.select(
        "conv_id", "turn", F.array_join("token_ids", " ").alias("token_ids")
    )


def decode_tokens(spark, folder):
    vocab = vocab_topk(spark, folder)
    decoded = vocabulary.decode(
        _encoded(spark, folder, vocab), ["conv_id", "turn"], vocab
    )
    return decoded.select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"))


def masked_mean_pool(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    # Token ids stand for vector ids; a token without a vector counts as zeros.
    pooled = vocabulary.masked_mean_pool(
        _encoded(spark, folder, vocab_topk(spark, folder)),
        ["conv_id", "turn"],
        vectors,
        POOL_VECTOR_SIZE,
        idx_col="vec_id",
    )
    return pooled.select("conv_id", "turn", "dim", F.round("mean", 4).alias("mean"))


def bigram_counts(spark, folder):
    return features.ngram_counts(documents(spark, folder), "text", (2, 2))


def tfidf_terms(spark, folder):
    weights = features.tfidf(documents(spark, folder), "doc_id", "text")
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def label_index(spark, folder):
    return features.label_index(read_table(spark, folder, "documents"), "lang")


def balanced_weights(spark, folder):
    out = features.balanced_weights(read_table(spark, folder, "labels"), "toxic")
    return out.select("toxic", "n", F.round("weight", 6).alias("weight"))


def inverse_freq_weights(spark, folder):
    out = features.inverse_frequency_weights(
        read_table(spark, folder, "documents"), "lang"
    )
    return out.select("lang", "n", F.round("weight", 6).alias("weight"))


# ---- scoring and moderation ------------------------------------------------


def multilabel_scores(spark, folder):
    docs = documents(spark, folder)
    tokens = docs.select(
        "doc_id",
        F.explode(word_tokens(T.model_text(F.col("text")))).alias("term"),
    )
    weights = spark.createDataFrame(
        [
            (term, label, w)
            for term, row in fixed.LEXICON_WEIGHTS.items()
            for label, w in zip(fixed.LABELS, row)
        ],
        "term string, label string, weight double",
    )
    wide = scoring.linear_scores(
        docs,
        tokens.withColumn("value", F.lit(1.0)),
        weights,
        fixed.LEXICON_BIAS,
        ["doc_id"],
    )
    return wide.select("doc_id", *[F.round(l, 6).alias(l) for l in fixed.LABELS])


def _predictions(spark, folder, **options) -> DataFrame:
    return scoring.predict_batch(
        documents(spark, folder), "text", keep=["doc_id"], **options
    )


def flag_categories(spark, folder):
    return _predictions(spark, folder).select(
        "doc_id",
        F.array_join("flagged_categories", ",").alias("flagged"),
        "is_toxic",
    )


def primary_category(spark, folder):
    return _predictions(spark, folder).select(
        "doc_id", "primary_category", F.round("overall_score", 6).alias("overall_score")
    )


def severity(spark, folder):
    return _predictions(spark, folder).select("doc_id", "severity_level")


def argmax_label(spark, folder):
    values = F.transform("scores", lambda s: s["score"])
    return _predictions(spark, folder).select(
        "doc_id", models.argmax_class(values, fixed.LABELS).alias("label")
    )


def category_breakdown(spark, folder):
    out = scoring.category_breakdown(_predictions(spark, folder), ["doc_id"])
    return out.withColumn("raw_score", F.round("raw_score", 6))


def threshold_sweep(spark, folder):
    return scoring.threshold_sweep(_predictions(spark, folder))


def blank_guard(spark, folder):
    """Records of blank comments: what is left of a document without its words."""
    blanks = documents(spark, folder).select(
        "doc_id", F.regexp_replace("text", r"[^\x20\x09-\x0D]", "").alias("blanks")
    )
    records = scoring.predict(blanks, "blanks", keep=["doc_id"])
    return records.select(
        "doc_id",
        "original_text",
        "cleaned_text",
        "is_toxic",
        "overall_score",
        "primary_category",
        "severity_level",
        F.array_max(F.transform("scores", lambda s: s["score"])).alias("best"),
        F.size("scores").alias("labels"),
        F.size("flagged_categories").alias("flagged"),
        F.size("token_highlights").alias("highlights"),
    )


def prediction_record(spark, folder):
    """Full records of lines as comments, nested fields as text."""
    records = scoring.predict(
        document_lines(spark, folder), "comment", keep=["doc_id", "line_no"]
    )
    return records.select(
        "doc_id",
        "line_no",
        "original_text",
        "cleaned_text",
        "is_toxic",
        F.round("overall_score", 6).alias("overall_score"),
        "primary_category",
        "severity_level",
        F.array_join(
            F.transform(
                "scores",
                lambda s: F.concat(
                    s["label"], F.lit("="), F.round(s["score"] * 10000).cast("int")
                ),
            ),
            ",",
        ).alias("scores"),
        F.array_join("flagged_categories", ",").alias("flagged_categories"),
        F.size("token_highlights").alias("highlights"),
    )


def _highlights(spark, folder) -> DataFrame:
    return jobs.explain_comments(
        document_lines(spark, folder),
        ["doc_id", "line_no"],
        "comment",
        scoring.default_lexicon(),
    )


def occlusion_highlights(spark, folder):
    return _highlights(spark, folder).select(
        "doc_id", "line_no", F.inline("token_highlights")
    )


def trigger_words(spark, folder):
    """The same highlights through the in-row shortcut of the linear scorer."""
    records = scoring.predict(
        document_lines(spark, folder), "comment", keep=["doc_id", "line_no"]
    ).where("is_toxic")
    return records.select(
        "doc_id",
        "line_no",
        S.trigger_words(F.col("token_highlights")).alias("trigger_words"),
    )


HEADS = ("toxic", "insult")


def _heads(spark, folder):
    """Heads fitted on ``labels``; toxic documents of low quality stand for insults."""
    both = (F.col("toxic") == 1) & (F.col("quality") == 0)
    marks = read_table(spark, folder, "labels").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), both.cast("int").alias("insult")
    )
    return jobs.fit_moderation_heads(documents(spark, folder), marks, "text", "doc_id", HEADS)


def heads_report(spark, folder):
    """Flat report of all documents scored by fitted heads."""
    records = jobs.moderate(
        documents(spark, folder), "text", keep=["doc_id"], scorer=_heads(spark, folder)
    )
    return scoring.batch_report(records, ["doc_id"])


def heads_highlights(spark, folder):
    """Words of toxic lines with their importance to the fitted heads."""
    records = jobs.explained_records(
        document_lines(spark, folder), ["doc_id", "line_no"], "comment", _heads(spark, folder)
    )
    return records.select("doc_id", "line_no", F.inline("token_highlights"))


def batch_report(spark, folder):
    records = jobs.moderate(documents(spark, folder), "text", keep=["doc_id"])
    return scoring.batch_report(records, ["doc_id"])


def batch_summary(spark, folder):
    return scoring.batch_summary(
        jobs.moderate(documents(spark, folder), "text", keep=["doc_id"])
    )


def toxic_rows(spark, folder):
    """Flat report filtered by status."""
    return batch_report(spark, folder).where(F.col("Status") == fixed.STATUS_TOXIC)


def category_metadata(spark, folder):
    """Category frequencies with display name and description attached."""
    flagged = _predictions(spark, folder).select(
        F.explode("flagged_categories").alias("label")
    )
    counts = flagged.groupBy("label").agg(F.count(F.lit(1)).alias("comments"))
    # Six fixed rows.
    return counts.join(
        F.broadcast(scoring.categories_table(spark)), "label", "left"
    ).select(
        "label",
        F.coalesce("display", "label").alias("display"),
        "description",
        "comments",
    )


# ---- metrics ---------------------------------------------------------------


def _judged_labels(spark, folder, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """Labelled documents: expected flag, predicted flag, probability, best score.

    Documents without a label are left out before they are scored, and the others are
    reduced to id and verdict before they meet the labels.
    """
    labels = read_table(spark, folder, "labels").select("doc_id", "toxic")
    scored = scoring.predict_batch(
        likely_in(documents(spark, folder), "doc_id", labels),
        "text",
        keep=["doc_id"],
        threshold=threshold,
    )
    p_toxic = S.score_of(F.col("scores"), "toxic").alias("p_toxic")
    verdicts = scored.select("doc_id", "is_toxic", p_toxic, "overall_score")

    def name(flag: Column) -> Column:
        return F.when(flag, "toxic").otherwise("clean")

    return labels.join(verdicts, "doc_id").select(
        "doc_id",
        name(F.col("toxic") == 1).alias("actual"),
        name(F.col("is_toxic")).alias("pred"),
        "p_toxic",
        "overall_score",
    )


TOXIC_CLASSES = ["clean", "toxic"]


def expected_vs_predicted(spark, folder):
    return _judged_labels(spark, folder).select(
        "doc_id", F.col("actual").alias("expected"), F.col("pred").alias("predicted")
    )


def _matrix(spark, folder, **options) -> DataFrame:
    return metrics.confusion_matrix(
        _judged_labels(spark, folder, **options), TOXIC_CLASSES
    )


def confusion_matrix(spark, folder):
    return _matrix(spark, folder)


def confusion_wide(spark, folder):
    return metrics.confusion_wide(_matrix(spark, folder), TOXIC_CLASSES)


def matrix_roundtrip(spark, folder):
    """The labelled matrix as a CSV file, read back."""
    path = shared_folder(spark, "matrix")
    writers.write_confusion_matrix(_matrix(spark, folder), TOXIC_CLASSES, path)
    back = spark.read.option("header", True).csv(path)
    return back.select(
        F.col(back.columns[0]).alias("class"),
        *[F.col(f"Pred_{c}").cast("long").alias(f"Pred_{c}") for c in TOXIC_CLASSES],
    )


def metrics_document(spark, folder):
    """The metrics document as a JSON file, read back and taken apart."""
    path = shared_folder(spark, "metrics")
    matrix = materialise(_matrix(spark, folder), "cells")
    writers.write_metrics(metrics.metrics_document(matrix, TOXIC_CLASSES, "lexicon"), path)
    document = writers.read_metrics(spark, path)
    at = lambda place: F.get_json_object("document", place)
    number = lambda place: F.round(at(place).cast("double"), 6)
    report = "$['classification_report']"
    return document.select(
        at("$.model").alias("model"),
        *[at(f"$.{x}").cast("double").alias(x) for x in ("macro_f1", "weighted_f1", "accuracy")],
        at("$.classes").alias("classes"),
        at("$.confusion_matrix").alias("confusion_matrix"),
        *[
            number(f"{report}['{c}']['{x}']").alias(f"{c}_{x}".replace("-", "_"))
            for c in TOXIC_CLASSES
            for x in ("precision", "recall", "f1-score", "support")
        ],
        number(f"{report}['accuracy']").alias("report_accuracy"),
        number(f"{report}['macro avg']['f1-score']").alias("macro_avg_f1"),
        number(f"{report}['weighted avg']['support']").alias("weighted_avg_support"),
    )


def class_report(spark, folder):
    report = metrics.class_report(_matrix(spark, folder))
    return report.select(
        "label",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        "support",
    )


def summary_metrics(spark, folder):
    out = metrics.summary_metrics(_matrix(spark, folder))
    return out.select(
        *[F.round(c, 6).alias(c) for c in out.columns if c != "support"], "support"
    )


def log_loss(spark, folder):
    judged = _judged_labels(spark, folder)
    p_actual = F.when(F.col("actual") == "toxic", F.col("p_toxic")).otherwise(
        1.0 - F.col("p_toxic")
    )
    return metrics.log_loss(judged, p_actual).select(
        F.round("log_loss", 6).alias("log_loss")
    )


def model_compare(spark, folder):
    """Thresholds as models: documents are scored once, all matrices counted together."""
    verdict = {
        f"lexicon at {t}": F.when(F.col("overall_score") >= t, "toxic").otherwise("clean")
        for t in (0.5, 0.9)
    }
    cells = metrics.confusion_matrices(_judged_labels(spark, folder), TOXIC_CLASSES, verdict)
    cells = materialise(cells, "matrices")
    summaries = {
        model: metrics.summary_metrics(cells.where(F.col("model") == model).drop("model"))
        for model in verdict
    }
    out = metrics.compare_models(summaries, "lexicon at 0.5")
    return out.select(
        "model", *[F.round(c, 6).alias(c) for c in out.columns if c != "model"]
    )


# ---- models ----------------------------------------------------------------


def _texts(spark, folder) -> DataFrame:
    docs = documents(spark, folder)
    split = jobs.prepare_dataset(docs, "text", "lang", "doc_id")
    return jobs.labelled_model_texts(docs, split, "text", "lang", "doc_id")


def _rounded_summary(evaluation: jobs.Evaluation, model: str) -> DataFrame:
    return evaluation.summary.select(
        F.lit(model).alias("model"),
        *[F.round(c, 4).alias(c) for c in ("macro_f1", "weighted_f1", "accuracy")],
        "support",
    )


def tfidf_logreg_eval(spark, folder):
    return _rounded_summary(
        jobs.train_linear(_texts(spark, folder), "lang"), "tfidf + linear"
    )


def class_probabilities(spark, folder):
    evaluation = jobs.train_linear(_texts(spark, folder), "lang")
    return evaluation.predictions.select(
        "doc_id",
        "actual",
        "pred",
        F.round(F.array_max("probabilities"), 4).alias("confidence"),
    )


def saved_model_eval(spark, folder):
    """A model is fitted, saved, loaded and evaluated: test rows and what it agrees on."""
    path = shared_folder(spark, "model")
    texts = _texts(spark, folder)
    fitted = jobs.train_linear(texts, "lang")
    writers.save_model(fitted.model, path)
    test = texts.where(F.col("split") == "test").drop("split")
    loaded = jobs.evaluate_model(writers.load_model(path), test, "lang")
    before = fitted.predictions.select("doc_id", F.col("pred").alias("pred_before"))
    both = loaded.predictions.join(before, "doc_id")
    return both.agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(F.col("pred") == F.col("pred_before")).alias("agreeing"),
        F.lit(",".join(loaded.classes)).alias("classes"),
    ).crossJoin(loaded.summary.select("support"))


def w2v_mlp_eval(spark, folder):
    return _rounded_summary(
        jobs.train_pooled_embedding(_texts(spark, folder), "lang", "doc_id"),
        "pooled embedding",
    )


def select_best_val(spark, folder):
    texts = _texts(spark, folder)
    train = texts.where(F.col("split") == "train").drop("split")
    val = texts.where(F.col("split") == "val").drop("split")
    tfidf = models.fit_tfidf(train)
    featured = models.written_features(tfidf, train, "lang")
    featured_val = models.written_features(tfidf, val, "lang")
    _, _, rows = models.select_best(
        {
            f"C={c}": lambda c=c: models.fit_linear(featured, "lang", c=c)
            for c in (0.5, fixed.LINEAR_C, 4.5)
        },
        featured_val,
        "lang",
        metrics.class_list(train, "lang"),
    )
    return spark.createDataFrame(
        [(name, round(score, 4), best) for name, score, best in rows],
        "candidate string, val_macro_f1 double, selected boolean",
    )


def binary_heads_fit(spark, folder):
    """Fit one head per label column, then score all documents with the weights."""
    docs = documents(spark, folder).select(
        "doc_id", T.model_text(F.col("text")).alias("text")
    )
    labelled = read_table(spark, folder, "labels").join(docs, "doc_id")
    tfidf = models.fit_tfidf(labelled)
    terms = models.tfidf_terms(tfidf)
    heads = ["toxic", "quality"]
    weights, bias = models.fit_binary_heads(
        models.add_features(tfidf, labelled), heads, terms
    )
    scored = scoring.linear_scores(
        docs,
        models.sparse_features(models.add_features(tfidf, docs), "doc_id", terms),
        weights,
        bias,
        ["doc_id"],
        labels=heads,
    )
    return scored.select("doc_id", *[F.round(h, 4).alias(h) for h in heads])


# ---- streaming -------------------------------------------------------------

_DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _scored_stream(spark, folder) -> DataFrame:
    stream = streaming.comment_stream(
        spark, f"{folder}/documents.parquet*", _DOCUMENT_SCHEMA
    )
    return streaming.score_comments(stream, "text", keep=["doc_id"])


def stream_score(spark, folder):
    base = shared_folder(spark, "stream-score")
    streaming.write_reports(
        _scored_stream(spark, folder), ["doc_id"], f"{base}/rows", f"{base}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def stream_summary(spark, folder):
    base = shared_folder(spark, "stream-summary")
    streaming.write_summaries(
        _scored_stream(spark, folder), f"{base}/summary", f"{base}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/summary")


QUERIES = {
    f.__name__: f
    for f in (
        profile_nulls,
        dedupe_keep_first,
        dedupe_counts,
        class_distribution,
        min_length_filter,
        stratified_split,
        split_summary,
        lines_to_rows,
        csv_roundtrip,
        split_roundtrip,
        report_roundtrip,
        vocab_roundtrip,
        non_string_text,
        blank_guard,
        matrix_roundtrip,
        metrics_document,
        saved_model_eval,
        detect_text_column,
        url_mention_mask,
        mention_mask,
        collapse_repeats,
        squash_whitespace,
        lowercase_fold,
        html_unescape,
        leet_decode,
        clean_text,
        clean_pages,
        token_frequency,
        encode_tokens,
        decode_tokens,
        masked_mean_pool,
        bigram_counts,
        tfidf_terms,
        label_index,
        balanced_weights,
        inverse_freq_weights,
        multilabel_scores,
        flag_categories,
        primary_category,
        severity,
        argmax_label,
        category_breakdown,
        threshold_sweep,
        prediction_record,
        occlusion_highlights,
        trigger_words,
        batch_report,
        heads_report,
        heads_highlights,
        batch_summary,
        toxic_rows,
        category_metadata,
        expected_vs_predicted,
        confusion_matrix,
        confusion_wide,
        class_report,
        summary_metrics,
        log_loss,
        model_compare,
        tfidf_logreg_eval,
        class_probabilities,
        w2v_mlp_eval,
        select_best_val,
        binary_heads_fit,
        stream_score,
        stream_summary,
    )
}
QUERIES["vocab_topk"] = lambda spark, folder: vocab_topk(spark, folder)
