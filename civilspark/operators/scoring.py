"""Multi-label scoring and the prediction record.

Two scorers with the same meaning (z = bias + sum of value * weight, then a
sigmoid per label):

* :class:`Lexicon` for a bounded list of terms: a pure projection, so it runs
  on batch and stream alike and never shuffles a text;
* :func:`linear_scores` for weight tables of any size: a join on the term and
  one aggregation per document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from civilspark import fixed_values as fixed
from civilspark.functions import scores as S
from civilspark.functions.regex import WORD
from civilspark.functions.text import clean_text, decode_leet, is_blank, let
from civilspark.functions.tokens import whitespace_tokens
from civilspark.operators.sizes import broadcast_if_small

Scorer = Callable[[Column], Column]


@dataclass(frozen=True)
class Lexicon:
    """Term weights that live inside the expression.

    Any number of terms is right; every text is searched term by term, so a weight
    table of thousands of terms is faster through ``linear_scores``.
    """

    weights: Mapping[str, Sequence[float]]
    bias: Mapping[str, float]
    labels: Sequence[str] = field(default=fixed.LABELS)

    def __post_init__(self):
        for term, row in self.weights.items():
            if term != term.lower() or not re.fullmatch(r"\w+", term):
                raise ValueError(f"not a lower-case word: {term!r}")
            if len(row) != len(self.labels):
                raise ValueError(f"{term!r} needs one weight per label")

    def logits(self, text: Column) -> Column:
        """``array<double>`` of logits in label order."""
        return self._add_up(
            F.array(*[F.lit(float(self.bias.get(l, 0.0))) for l in self.labels]), text
        )

    def contributions(self, word: Column) -> Column:
        """What one word adds to each logit."""
        return self._add_up(F.array(*[F.lit(0.0) for _ in self.labels]), word)

    def __call__(self, text: Column) -> Column:
        """Scores of a text: ``array<struct<label, score>>``."""
        return S.score_array(
            self.labels, F.transform(self.logits(text), lambda z: S.sigmoid(z))
        )

    def _add_up(self, start: Column, text: Column) -> Column:
        if not self.weights:
            return start
        pattern = f"(?<!{WORD})(?:{'|'.join(self.weights)})(?!{WORD})"

        def find(t: Column) -> Column:
            # Most texts hold no term at all, which a substring search tells
            # sooner than the pattern.
            tests = [t.contains(term) for term in self.weights]
            while len(tests) > 1:  # by pairs, so the tree of many terms stays flat
                odd = tests[len(tests) - len(tests) % 2 :]
                tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + odd
            return F.when(tests[0], F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(
                F.array().cast("array<string>")
            )

        hits = let(F.lower(text), find)
        table = F.create_map(
            *[
                part
                for term, row in self.weights.items()
                for part in (
                    F.lit(term),
                    F.array(*[F.lit(float(w)) for w in row]),
                )
            ]
        )
        return F.aggregate(
            hits,
            start,
            lambda acc, hit: F.zip_with(acc, table[hit], lambda a, w: a + w),
        )


def default_lexicon() -> Lexicon:
    return Lexicon(fixed.LEXICON_WEIGHTS, fixed.LEXICON_BIAS)


def network_scorer(
    make_predict_fn: Callable, labels: Sequence[str] = fixed.LABELS, batch_size: int = 128
) -> Scorer:
    """Scorer around a user-supplied network.

    ``make_predict_fn`` loads the model once per worker and returns a function
    from an array of texts to an array of shape (n, labels) of probabilities.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size
    )
    return lambda text: S.score_array(labels, predict(text))


def linear_scores(
    documents: DataFrame,
    features: DataFrame,
    weights: DataFrame,
    bias: Mapping[str, float],
    ids: Sequence[str],
    labels: Sequence[str] = fixed.LABELS,
) -> DataFrame:
    """Relational linear scorer: ``ids`` plus one probability column per label.

    ``features(ids..., term, value)`` is joined to ``weights(term, label,
    weight)`` on the term.  Weights are turned to one row per term first, so the
    join does not fan out by label.  Documents without any known term enter the
    same aggregation as a row of zeros, which saves a join back.
    """
    ids, labels = list(ids), list(labels)
    per_term = weights.groupBy("term").agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col("label") == l, F.col("weight"))), F.lit(0.0)
            ).alias(l)
            for l in labels
        ]
    )
    hits = features.join(broadcast_if_small(per_term), "term").select(
        *ids, *[(F.col("value") * F.col(l)).alias(l) for l in labels]
    )
    everyone = documents.select(*ids, *[F.lit(0.0).alias(l) for l in labels])
    return (
        hits.unionByName(everyone)
        .groupBy(*ids)
        .agg(
            *[
                S.sigmoid(F.sum(l) + F.lit(float(bias.get(l, 0.0)))).alias(l)
                for l in labels
            ]
        )
    )


def wide_to_scores(df: DataFrame, labels: Sequence[str] = fixed.LABELS) -> Column:
    """Score array from one column per label."""
    return F.array(
        *[
            F.struct(F.lit(l).alias("label"), F.col(l).cast("double").alias("score"))
            for l in labels
        ]
    )


def _with_scores(
    df: DataFrame, text_col: str, scorer: Scorer, labels: Sequence[str]
) -> DataFrame:
    """Add ``_cleaned``, ``_model_text`` and ``_scores``; blank text scores 0.

    The three leave through a one-row generator.  A later filter on a verdict
    would otherwise be pushed below the projection, and the text normalised and
    scored once for the filter and once for the result.
    """
    text = F.col(text_col)
    blank = is_blank(text)
    ready = (
        df.withColumn("_cleaned", F.when(blank, "").otherwise(clean_text(text)))
        .withColumn("_model_text", decode_leet(F.col("_cleaned")))
    )
    if hasattr(scorer, "add_scores"):
        ready = scorer.add_scores(ready, "_model_text", "_given")
        given = F.col("_given")
    else:
        given = scorer(F.col("_model_text"))
    ready = ready.withColumn(
        "_scores", F.when(blank, S.zero_scores(labels)).otherwise(given)
    )
    return ready.select(
        *df.columns, F.inline(F.array(F.struct("_cleaned", "_model_text", "_scores")))
    )


def judge(df: DataFrame, threshold: float | Column = fixed.THRESHOLD) -> DataFrame:
    """Verdict columns from a ``scores`` column."""
    scores = F.col("scores")
    return (
        df.withColumn("flagged_categories", S.flagged_categories(scores, threshold))
        .withColumn("is_toxic", F.size("flagged_categories") > 0)
        .withColumn("overall_score", S.overall_score(scores))
        .withColumn("primary_category", S.primary_category(scores, threshold))
        .withColumn("severity_level", S.severity_level(scores, F.col("is_toxic")))
    )


PREDICTION_FIELDS = (
    "original_text",
    "cleaned_text",
    "is_toxic",
    "overall_score",
    "primary_category",
    "severity_level",
    "scores",
    "flagged_categories",
    "token_highlights",
)


def predict(
    df: DataFrame,
    text_col: str = "text",
    scorer: Lexicon | Scorer | None = None,
    threshold: float = fixed.THRESHOLD,
    highlight_tokens: bool | None = None,
    keep: Sequence[str] = (),
    labels: Sequence[str] = fixed.LABELS,
) -> DataFrame:
    """Prediction record per comment (nine fixed fields plus ``keep``).

    One projection over the input: no shuffle, one Python crossing at most.
    A scorer is a :class:`Lexicon`, fitted heads (``heads.LinearHeads``) or a column
    function.  A lexicon explains toxic comments in place unless told not to; with the
    others ``jobs.explained_records`` attaches the highlights.
    """
    scorer = scorer or default_lexicon()
    if hasattr(scorer, "labels"):
        labels = scorer.labels
    if highlight_tokens is None:
        highlight_tokens = isinstance(scorer, Lexicon)
    elif highlight_tokens and not isinstance(scorer, Lexicon):
        raise ValueError("highlights in place need a Lexicon; see jobs.explained_records")
    scored = judge(
        _with_scores(df, text_col, scorer, labels).withColumnRenamed("_scores", "scores"),
        threshold,
    )
    if highlight_tokens:
        words = whitespace_tokens(F.col("_model_text"))
        explained = F.when(
            F.col("is_toxic"),
            linear_highlights(words, F.col("overall_score"), F.col("_model_text"), scorer),
        )
    else:
        explained = F.lit(None)
    empty = F.array().cast(
        "array<struct<pos:int,word:string,importance:double,is_toxic_token:boolean>>"
    )
    return (
        scored.withColumn("token_highlights", F.coalesce(explained, empty))
        .withColumn("original_text", F.col(text_col))
        .withColumnRenamed("_cleaned", "cleaned_text")
        .select(*keep, *PREDICTION_FIELDS)
    )


def predict_batch(
    df: DataFrame,
    text_col: str = "text",
    scorer: Lexicon | Scorer | None = None,
    threshold: float = fixed.THRESHOLD,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Prediction records without highlights."""
    return predict(
        df, text_col, scorer, threshold, highlight_tokens=False, keep=keep
    )


def linear_highlights(
    words: Column, baseline: Column, text: Column, lexicon: Lexicon
) -> Column:
    """Leave-one-out importance of every word, inside the row.

    For a linear scorer dropping a word subtracts its contribution from the
    logits, so no variant text has to be built or scored.
    """

    def one(word: Column, pos: Column, logits: Column) -> Column:
        remaining = F.zip_with(
            logits, lexicon.contributions(word), lambda z, c: S.sigmoid(z - c)
        )
        return let(
            F.greatest(F.lit(0.0), baseline - F.array_max(remaining)),
            lambda importance: S.highlight(
                pos, word, F.round(importance, 4), S.is_trigger(importance, baseline)
            ),
        )

    return let(
        F.struct(words.alias("words"), lexicon.logits(text).alias("logits")),
        lambda v: F.when(
            F.size(v["words"]).between(
                fixed.EXPLAIN_MIN_WORDS, fixed.EXPLAIN_MAX_WORDS
            ),
            F.transform(v["words"], lambda w, i: one(w, i, v["logits"])),
        ).otherwise(S.plain_highlights(v["words"])),
    )


def category_breakdown(
    df: DataFrame,
    ids: Sequence[str],
    threshold: float = fixed.THRESHOLD,
) -> DataFrame:
    """One row per comment and category from a ``scores`` column."""
    score = F.col("s.score")
    return df.select(*ids, F.posexplode("scores").alias("category_no", "s")).select(
        *ids,
        "category_no",
        F.col("s.label").alias("label"),
        S.display_name(F.col("s.label")).alias("category"),
        F.round(score * 100, 2).alias("score_pct"),
        F.when(score >= threshold, "FLAGGED").otherwise("Normal").alias("flag"),
        score.alias("raw_score"),
    )


def threshold_sweep(
    df: DataFrame, thresholds: Sequence[float] = fixed.THRESHOLD_SWEEP
) -> DataFrame:
    """Toxic counts for every threshold, in one pass and one aggregation.

    A threshold flags a comment iff its best score reaches it, so the sweep needs
    no row per (comment, threshold): one conditional count per threshold.
    """
    best = S.overall_score(F.col("scores"))
    counted = df.select(best.alias("best")).agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("best") >= F.lit(t)).alias(f"_t{i}")
            for i, t in enumerate(thresholds)
        ],
    )
    return counted.select(
        "total",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(float(t)).alias("threshold"),
                        F.col(f"_t{i}").alias("toxic_count"),
                    )
                    for i, t in enumerate(thresholds)
                ]
            )
        ),
    ).select(
        "threshold",
        "total",
        "toxic_count",
        (F.col("total") - F.col("toxic_count")).alias("clean_count"),
        F.round(
            F.coalesce(F.try_divide(F.col("toxic_count") * 100.0, F.col("total")), F.lit(0.0)),
            1,
        ).alias("toxic_pct"),
    )


def batch_report(predictions: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Flat report: eleven columns, percentages with one decimal."""

    def percent(value: Column) -> Column:
        return F.round(value * 100, 1)

    return predictions.select(
        *ids,
        F.col("original_text").alias("Comment"),
        F.when(F.col("is_toxic"), fixed.STATUS_TOXIC)
        .otherwise(fixed.STATUS_CLEAN)
        .alias("Status"),
        F.col("primary_category").alias("Primary Category"),
        F.col("severity_level").alias("Severity"),
        percent(F.col("overall_score")).alias("Confidence (%)"),
        *[
            percent(S.score_of(F.col("scores"), label)).alias(heading)
            for label, heading in fixed.REPORT_COLUMNS.items()
        ],
    )


def batch_summary(predictions: DataFrame) -> DataFrame:
    """One row: total, clean and toxic counts with their shares."""
    counts = predictions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_toxic")).alias("toxic_count"),
    ).withColumn("clean_count", F.col("total") - F.col("toxic_count"))

    def share(name: str) -> Column:
        ratio = F.try_divide(F.col(name) * 100.0, F.col("total"))
        return F.round(F.coalesce(ratio, F.lit(0.0)), 1)

    return counts.select(
        "total",
        "clean_count",
        share("clean_count").alias("clean_pct"),
        "toxic_count",
        share("toxic_count").alias("toxic_pct"),
    )


def categories_table(spark) -> DataFrame:
    """Dimension table of the categories."""
    return spark.createDataFrame(
        [(label, *meta) for label, meta in fixed.CATEGORIES.items()],
        "label string, display string, description string",
    )
