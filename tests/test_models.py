import math

import pytest
from pyspark.sql import functions as F

from civilspark.operators import features, metrics, models, scoring
from civilspark.plans import jobs, registry
from civilspark.sources import writers


@pytest.fixture(scope="module")
def texts(spark):
    """Two easy classes and their split."""
    data = []
    for i in range(60):
        topic = ["apple pear plum fruit", "engine wheel brake car"][i % 2]
        split = "train" if i < 44 else "val" if i < 52 else "test"
        data.append((i, f"{topic} number {i % 9} word", ["food", "cars"][i % 2], split))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, split string")


@pytest.fixture(scope="module")
def evaluation(texts):
    return jobs.train_linear(texts, "lang", max_iter=50)


def test_pipeline_features_equal_relational_tfidf(spark, texts):
    train = texts.where("split = 'train'")
    model = models.fit_tfidf(train)
    rows = models.sparse_features(
        models.add_features(model, train), "doc_id", models.tfidf_terms(model)
    )
    ours = {(r.doc_id, r.term): r.value for r in rows.collect()}
    relational = {
        (r.doc_id, r.term): r.weight
        for r in features.tfidf(train, "doc_id", "text").collect()
    }
    assert ours == pytest.approx(relational)


def test_sublinear_counts(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame(
        [(Vectors.sparse(4, {0: 1.0, 2: 3.0}),), (Vectors.sparse(4, {}),)], ["a"]
    )
    out = models.SublinearTf(inputCol="a", outputCol="b").transform(df).collect()
    assert out[0].b.toArray().tolist() == pytest.approx([1.0, 0.0, 1 + math.log(3), 0.0])
    assert out[1].b.size == 4 and out[1].b.numNonzeros() == 0


def test_linear_model(evaluation):
    assert evaluation.classes == ["cars", "food"]
    summary = evaluation.summary.first()
    assert summary.accuracy == 1.0 and summary.support == 8
    row = evaluation.predictions.first()
    assert sum(row.probabilities) == pytest.approx(1.0)
    named = evaluation.predictions.select(
        "pred", models.argmax_class(F.col("probabilities"), evaluation.classes).alias("a")
    )
    assert all(r.pred == r.a for r in named.collect())


def test_fit_holds_no_second_copy_of_features(texts, monkeypatch):
    def refused(*_):
        raise AssertionError("the fit keeps its own copy")

    monkeypatch.setattr(type(texts), "persist", refused)
    train = texts.where("split = 'train'").unionByName(
        texts.limit(1).withColumns({"lang": F.lit(None), "text": F.lit("")})
    )
    model = models.fit_baseline(train, "lang", "text", max_iter=5)
    assert models.class_labels(model) == ["cars", "food"]
    tfidf = models.fit_tfidf(train)
    written = models.written_features(tfidf, train, "lang")
    assert written.columns == ["lang", "features"]
    want = models.add_features(tfidf, train).select("lang", "features")
    key = lambda r: (str(r.lang), str(r.features))
    assert sorted(written.collect(), key=key) == sorted(want.collect(), key=key)


def test_save_and_evaluate_again(texts, evaluation, tmp_path):
    writers.save_model(evaluation.model, str(tmp_path / "model"))
    loaded = writers.load_model(str(tmp_path / "model"))
    test = texts.where("split = 'test'")
    again = jobs.evaluate_model(loaded, test, "lang")
    assert again.classes == evaluation.classes
    assert again.summary.collect() == evaluation.summary.collect()
    first = {r.doc_id: r.probabilities for r in evaluation.predictions.collect()}
    second = {r.doc_id: r.probabilities for r in again.predictions.collect()}
    assert second == first


def test_unseen_label_does_not_stop_evaluation(spark, evaluation):
    df = spark.createDataFrame([(1, "apple pear", "other")], "doc_id long, text string, lang string")
    out = jobs.evaluate_model(evaluation.model, df, "lang")
    assert out.predictions.first().pred in evaluation.classes


def test_pooled_embedding(texts):
    out = jobs.train_pooled_embedding(
        texts, "lang", "doc_id", vector_size=8, hidden=4, max_iter=40, partitions=1
    )
    assert out.classes == ["cars", "food"]
    assert out.summary.first().support == 8


def test_unknown_words(spark, texts):
    vocabulary = models.training_vocabulary(texts, "text", "doc_id")
    df = spark.createDataFrame([(1, "apple zebra")], "doc_id long, text string")
    tokens = models.tokens_with_unknown(df, "doc_id", "text", vocabulary).first().tokens
    assert tokens == ["apple", "<unk>"]


def test_select_best_keeps_the_first_of_equals(texts, evaluation):
    model = evaluation.model
    val = texts.where("split = 'val'")
    name, best, rows = models.select_best(
        {"one": lambda: model, "two": lambda: model}, val, "lang", evaluation.classes
    )
    assert name == "one" and best is model
    assert rows == [("one", 1.0, True), ("two", 1.0, False)]


def test_select_best_query_holds_no_second_copy_of_features(spark, texts, monkeypatch, tmp_path):
    docs = texts.select("doc_id", "text", "lang").withColumns(
        {"text": F.concat("text", F.lit(" "), "doc_id"), "source": F.lit("s"), "n_chars": F.lit(1)}
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    def refused(*_):
        raise AssertionError("the query keeps its own copy")

    monkeypatch.setattr(type(texts), "persist", refused)
    rows = registry.select_best_val(spark, str(tmp_path)).collect()
    assert [r.candidate for r in rows] == ["C=0.5", "C=1.5", "C=4.5"]
    assert [r.selected for r in rows] == [True, False, False]


def test_binary_heads_feed_the_relational_scorer(spark, texts):
    df = texts.select(
        "doc_id",
        "text",
        (F.col("lang") == "food").cast("int").alias("food"),
        (F.col("doc_id") % 3 == 0).cast("int").alias("third"),
    )
    tfidf = models.fit_tfidf(df)
    terms = models.tfidf_terms(tfidf)
    featured = models.add_features(tfidf, df)
    weights, bias = models.fit_binary_heads(featured, ["food", "third"], terms)
    assert set(bias) == {"food", "third"}
    scores = scoring.linear_scores(
        df,
        models.sparse_features(featured, "doc_id", terms),
        weights,
        bias,
        ["doc_id"],
        labels=["food", "third"],
    )
    joined = scores.join(df.select("doc_id", F.col("food").alias("is_food")), "doc_id")
    assert all((r.food > 0.5) == (r.is_food == 1) for r in joined.collect())


def test_balanced_weights_sum_to_rows(texts):
    total = models.with_class_weights(texts, "lang").agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(60)


def test_report_from_predictions(evaluation):
    report = {r.label: r.support for r in evaluation.report.collect()}
    assert report == {"cars": 4, "food": 4}
    assert metrics.class_list(evaluation.predictions, "actual") == ["cars", "food"]
