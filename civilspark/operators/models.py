"""Fitting and applying classifiers with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
    Word2Vec,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from civilspark import fixed_values as fixed
from civilspark.functions.regex import WORD
from civilspark.functions.scores import argmax_index
from civilspark.operators import metrics
from civilspark.operators.features import (
    balanced_weights,
    term_occurrences,
    tfidf_vocabulary,
)
from civilspark.operators.sizes import broadcast_if_small
from civilspark.operators.vocabulary import build_vocabulary, decode, encode
from civilspark.session import materialise


class SublinearTf(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Replace every count in a sparse vector by ``1 + ln(count)``.

    Runs in the JVM: the vector is opened as a struct, its values are mapped, and
    reading the struct back under the vector type closes it again.
    """

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        opened = F.unwrap_udt(F.col(self.getInputCol()))
        mapped = F.struct(
            F.struct(
                F.lit(0).cast("byte").alias("type"),
                opened["size"].alias("size"),
                opened["indices"].alias("indices"),
                F.transform(opened["values"], lambda v: 1.0 + F.log(v)).alias("values"),
            ).alias("v")
        )
        schema = StructType([StructField("v", VectorUDT())])
        closed = F.from_json(F.to_json(mapped), schema)["v"]
        return dataset.withColumn(self.getOutputCol(), closed)


def fit_tfidf(
    train: DataFrame,
    text_col: str = "text",
    output_col: str = "features",
    max_features: int = fixed.TFIDF_MAX_FEATURES,
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> PipelineModel:
    """TF-IDF pipeline: 1- and 2-grams, sublinear tf, smoothed idf, unit rows.

    The vocabulary and its idf come from one aggregation, the same as in
    ``features.tfidf``; features are in alphabetical order of the terms.
    """
    counted = term_occurrences(train, [], text_col, stop_words=stop_words)
    n_docs = train.agg(F.count(F.lit(1)).alias("n_docs"))
    # At most max_features rows, which the model holds anyway.
    kept = sorted(tfidf_vocabulary(counted, n_docs, max_features).collect())
    return PipelineModel(
        [
            RegexTokenizer(
                inputCol=text_col,
                outputCol="_words",
                pattern=f"{WORD}{{2,}}",
                gaps=False,
                toLowercase=True,
            ),
            StopWordsRemover(
                inputCol="_words",
                outputCol="_kept",
                stopWords=list(stop_words),
                caseSensitive=True,
            ),
            NGram(n=2, inputCol="_kept", outputCol="_bigrams"),
            SQLTransformer(
                statement="SELECT *, concat(_kept, _bigrams) AS _terms FROM __THIS__"
            ),
            CountVectorizerModel.from_vocabulary(
                [row.term for row in kept], inputCol="_terms", outputCol="_counts"
            ),
            SublinearTf(inputCol="_counts", outputCol="_tf"),
            ElementwiseProduct(
                inputCol="_tf",
                outputCol="_weighted",
                scalingVec=Vectors.dense([row.idf for row in kept]),
            ),
            Normalizer(inputCol="_weighted", outputCol=output_col, p=2.0),
        ]
    )


def tfidf_terms(model: PipelineModel) -> list[str]:
    """Terms of a fitted TF-IDF pipeline, in feature order."""
    return next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))


# Every gradient step sends one copy of the coefficients per task, so a task
# should bring enough rows to be worth it.
ROWS_PER_FIT_TASK = 5000
# Row groups of written features: a task holds one or two of them.
FEATURE_GROUP_BYTES = 16 << 20


def _for_fitting(df: DataFrame, rows: int) -> DataFrame:
    """Merge the tasks of a small training set; a large one stays as it is."""
    wanted = max(1, -(-rows // ROWS_PER_FIT_TASK))
    return df.coalesce(wanted) if wanted < df.rdd.getNumPartitions() else df


def add_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply a TF-IDF pipeline and drop its intermediate columns."""
    return model.transform(df).select(*df.columns, "features")


def written_features(model: PipelineModel, df: DataFrame, label_col: str) -> DataFrame:
    """``(label, features)``, written down without the texts.

    A fit keeps its own copy of the features in memory and on disk; a second one held by
    executors, with texts, would leave their tasks too little memory.
    """
    featured = add_features(model, df).select(label_col, "features")
    return materialise(featured, "features", group_bytes=FEATURE_GROUP_BYTES)


def with_class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Add the balanced class weight as ``weight``."""
    weights = broadcast_if_small(
        balanced_weights(df, label_col).select(F.col(label_col), "weight")
    )
    return df.join(weights, label_col)


def fit_linear(
    featured: DataFrame,
    label_col: str,
    c: float = fixed.LINEAR_C,
    max_iter: int = fixed.LINEAR_MAX_ITER,
) -> PipelineModel:
    """Multinomial L2 logistic regression on ``features``, balanced classes.

    ``c`` weighs the summed loss while Spark's ``regParam`` weighs the mean loss;
    balanced weights sum to the row count, hence 1 / (c * rows).
    """
    weighted = with_class_weights(featured, label_col)
    indexer = StringIndexer(
        inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(featured)
    rows = featured.count()
    ready = indexer.transform(weighted).select("_label", "weight", "features")
    model = LogisticRegression(
        family="multinomial",
        featuresCol="features",
        labelCol="_label",
        weightCol="weight",
        regParam=1.0 / (c * max(rows, 1)),
        standardization=False,
        maxIter=max_iter,
        tol=fixed.LINEAR_TOLERANCE,
    ).fit(_for_fitting(ready, rows))
    back = IndexToString(inputCol="prediction", outputCol="pred", labels=indexer.labels)
    return PipelineModel([indexer.setHandleInvalid("keep"), model, back])


def fit_baseline(
    train: DataFrame, label_col: str, text_col: str = "text", **linear
) -> PipelineModel:
    """TF-IDF and linear model as one pipeline, ready to save."""
    tfidf = fit_tfidf(train, text_col)
    featured = written_features(tfidf, train.select(label_col, text_col), label_col)
    linear_model = fit_linear(featured, label_col, **linear)
    return PipelineModel([*tfidf.stages, *linear_model.stages])


def class_labels(model: PipelineModel) -> list[str]:
    """Classes in index order, as stored with the model."""
    return next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()


def predict_classes(model: PipelineModel, df: DataFrame, label_col: str) -> DataFrame:
    """Add ``actual``, ``pred`` and the probability array ``probabilities``."""
    out = model.transform(df)
    return out.select(
        *df.columns,
        F.col(label_col).cast("string").alias("actual"),
        "pred",
        vector_to_array("probability").alias("probabilities"),
    )


def argmax_class(probabilities: Column, classes: Sequence[str]) -> Column:
    """Class of the largest probability, the first on ties."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, (argmax_index(probabilities) + 1).cast("int"))


def evaluate(predictions: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Summary metrics of ``(actual, pred)`` rows."""
    return metrics.summary_metrics(metrics.confusion_matrix(predictions, classes))


def tokens_with_unknown(
    df: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame
) -> DataFrame:
    """Leading tokens of each document, words outside the vocabulary as unknown."""
    encoded = encode(df, [id_col], text_col, vocabulary)
    decoded = decode(encoded, [id_col], vocabulary)
    return decoded.select(
        id_col, F.filter("tokens", lambda t: t != fixed.PAD_TOKEN).alias("tokens")
    )


def fit_pooled_embedding(
    tokens: DataFrame,
    label_col: str,
    vector_size: int = fixed.EMBEDDING_SIZE,
    hidden: int = fixed.HIDDEN_SIZE,
    max_iter: int = 100,
    seed: int = fixed.SEED,
    partitions: int = 4,
) -> PipelineModel:
    """Embedding, mean pooling over tokens, one hidden layer.

    ``tokens`` holds the label and ``tokens``; the words come from a size-limited
    vocabulary, so the embedding table on the driver is limited too.
    """
    indexer = StringIndexer(
        inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(tokens)
    embedding = Word2Vec(
        vectorSize=vector_size,
        minCount=0,
        numPartitions=partitions,
        seed=seed,
        inputCol="tokens",
        outputCol="features",
    ).fit(tokens)
    pooled = embedding.transform(indexer.transform(tokens)).select("_label", "features")
    pooled = pooled.persist()
    try:
        network = MultilayerPerceptronClassifier(
            layers=[vector_size, hidden, len(indexer.labels)],
            labelCol="_label",
            featuresCol="features",
            maxIter=max_iter,
            seed=seed,
        ).fit(pooled)
    finally:
        pooled.unpersist()
    back = IndexToString(inputCol="prediction", outputCol="pred", labels=indexer.labels)
    return PipelineModel([indexer.setHandleInvalid("keep"), embedding, network, back])


def training_vocabulary(train: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return build_vocabulary(
        train, text_col, id_col, fixed.VOCAB_TRAINING_SIZE, fixed.VOCAB_MIN_FREQ
    )


def select_best(
    candidates: dict[str, Callable[[], PipelineModel]],
    validation: DataFrame,
    label_col: str,
    classes: Sequence[str],
) -> tuple[str | None, PipelineModel | None, list[tuple[str, float, bool]]]:
    """Keep the candidate with the best validation macro-F1.

    Only a strictly better score replaces the holder and the bar starts at 0, so
    the first of equals wins.  Returns name, model and one row per candidate.
    """
    best_name, best_model, best_score, scores = None, None, 0.0, []
    for name, fit in candidates.items():
        model = fit()
        score = evaluate(predict_classes(model, validation, label_col), classes)
        macro_f1 = score.first()["macro_f1"]
        scores.append((name, macro_f1))
        if macro_f1 > best_score:
            best_name, best_model, best_score = name, model, macro_f1
    return best_name, best_model, [(n, s, n == best_name) for n, s in scores]


def fit_binary_heads(
    featured: DataFrame,
    label_cols: Sequence[str],
    terms: Sequence[str],
    c: float = fixed.LINEAR_C,
    max_iter: int = 100,
) -> tuple[DataFrame, dict[str, float]]:
    """One binary model per 0/1 label column over shared ``features``.

    Features are computed once and kept while the heads are fitted.  Returns the
    weights as ``(label, term, weight)``, at most labels * features rows, and the
    bias per label: the input of ``scoring.linear_scores``.
    """
    featured = featured.select(*label_cols, "features").persist()
    spark = featured.sparkSession
    weights, bias = None, {}
    try:
        rows = featured.count()
        for label in label_cols:
            weighted = with_class_weights(featured, label)
            model = LogisticRegression(
                family="binomial",
                labelCol=label,
                weightCol="weight",
                regParam=1.0 / (c * max(rows, 1)),
                standardization=False,
                maxIter=max_iter,
                tol=fixed.LINEAR_TOLERANCE,
            ).fit(_for_fitting(weighted, rows))
            bias[label] = float(model.intercept)
            values = model.coefficients.toArray()
            head = spark.createDataFrame(
                [(label, terms[i], float(values[i])) for i in values.nonzero()[0]],
                "label string, term string, weight double",
            )
            weights = head if weights is None else weights.unionByName(head)
    finally:
        featured.unpersist()
    return weights, bias


def sparse_features(df: DataFrame, id_col: str, terms: Sequence[str]) -> DataFrame:
    """``features`` vectors as ``(id, term, value)`` rows."""
    spark = df.sparkSession
    names = spark.createDataFrame(list(enumerate(terms)), "_i int, term string")
    opened = df.select(id_col, F.unwrap_udt("features").alias("_v"))
    pairs = opened.select(
        id_col, F.inline(F.arrays_zip("_v.indices", "_v.values")).alias("_i", "value")
    )
    return pairs.join(broadcast_if_small(names), "_i").select(id_col, "term", "value")
