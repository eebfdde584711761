import json
import math

import pytest
from pyspark.sql import functions as F

from civilspark.operators import metrics
from civilspark.sources import writers

# Published results to reproduce (fixed values).
CLASSES = [
    "age",
    "ethnicity",
    "gender",
    "not_cyberbullying",
    "other_cyberbullying",
    "religion",
]
PUBLISHED = {
    "linear": {
        "matrix": [
            [779, 2, 0, 9, 9, 1],
            [2, 763, 4, 7, 20, 0],
            [3, 1, 676, 52, 54, 3],
            [19, 3, 29, 487, 234, 21],
            [4, 2, 23, 156, 434, 5],
            [1, 1, 0, 40, 14, 744],
        ],
        "headline": (0.8387, 0.8469, 0.8438),
        "f1": [0.9689, 0.9732, 0.8889, 0.6308, 0.6249, 0.9454],
    },
    "recurrent": {
        "matrix": [
            [772, 6, 1, 11, 9, 1],
            [1, 764, 6, 5, 17, 3],
            [2, 2, 669, 38, 78, 0],
            [13, 7, 33, 364, 357, 19],
            [7, 5, 28, 85, 496, 3],
            [2, 2, 8, 21, 22, 745],
        ],
        "headline": (0.8208, 0.8287, 0.8279),
        "f1": [0.9668, 0.9659, 0.8722, 0.5528, 0.6188, 0.9484],
    },
}


def predictions(spark, matrix):
    """One row per prediction, as a model would give them."""
    cells = [
        (a, p, n) for a, row in zip(CLASSES, matrix) for p, n in zip(CLASSES, row)
    ]
    df = spark.createDataFrame(cells, "actual string, pred string, n int")
    return df.where("n > 0").select(
        "actual", "pred", F.explode(F.sequence(F.lit(1), "n")).alias("i")
    )


@pytest.mark.parametrize("name", PUBLISHED)
def test_published_results(spark, name):
    published = PUBLISHED[name]
    df = predictions(spark, published["matrix"])
    assert df.count() == 4602
    assert metrics.class_list(df, "actual", "pred") == CLASSES
    matrix = metrics.confusion_matrix(df, CLASSES)
    cells = {(r.actual, r.pred): r.n for r in matrix.collect()}
    assert [[cells[a, p] for p in CLASSES] for a in CLASSES] == published["matrix"]
    s = metrics.summary_metrics(matrix).first()
    rounded = tuple(round(x, 4) for x in (s.macro_f1, s.weighted_f1, s.accuracy))
    assert rounded == published["headline"]
    report = {r.label: r for r in metrics.class_report(matrix).collect()}
    assert [round(report[c].f1, 4) for c in CLASSES] == published["f1"]
    if name == "linear":
        assert report["age"].precision == pytest.approx(0.9641089108910891)
        assert report["age"].recall == pytest.approx(0.97375)
        assert report["religion"].support == 800
        assert s.macro_precision == pytest.approx(0.842162904577802)
        assert s.macro_recall == pytest.approx(0.8381183084208478)
        assert s.weighted_precision == pytest.approx(0.8526472092961)


def test_missing_classes_count_as_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "actual string, pred string")
    matrix = metrics.confusion_matrix(df, ["a", "b", "c"])
    assert matrix.count() == 9
    report = {r.label: tuple(r)[1:] for r in metrics.class_report(matrix).collect()}
    assert report["a"] == (1.0, 0.5, pytest.approx(2 / 3), 2)
    assert report["b"] == (0.0, 0.0, 0.0, 0)
    assert report["c"] == (0.0, 0.0, 0.0, 0)


def test_no_row_is_left_out(spark):
    df = spark.createDataFrame(
        [("a", "a"), ("b", "b"), ("a", "new"), (None, "b"), ("a", None)],
        "actual string, pred string",
    )
    matrix = metrics.confusion_matrix(df, ["a", "b"])
    cells = {(r.actual, r.pred): r.n for r in matrix.collect()}
    assert sum(cells.values()) == 5 and cells["a", "new"] == 1 and cells[None, "b"] == 1
    summary = metrics.summary_metrics(matrix).first()
    assert summary.accuracy == 0.4 and summary.support == 5
    report = {r.label: r for r in metrics.class_report(matrix).collect()}
    assert set(report) == {"a", "b", "new"} and report["b"].precision == 0.5


def test_compare_models(spark):
    summaries = {
        name: metrics.summary_metrics(
            metrics.confusion_matrix(predictions(spark, p["matrix"]), CLASSES)
        )
        for name, p in PUBLISHED.items()
    }
    out = {r.model: r for r in metrics.compare_models(summaries, "linear").collect()}
    assert out["linear"].macro_f1_delta == 0.0
    assert out["recurrent"].macro_f1_delta == pytest.approx(0.8208266 - 0.8386849, abs=1e-6)


def test_log_loss(spark):
    df = spark.createDataFrame([(0.5,), (0.25,), (0.0,)], "p double")
    loss = metrics.log_loss(df, F.col("p")).first().log_loss
    assert loss == pytest.approx(-(math.log(0.5) + math.log(0.25) + math.log(1e-15)) / 3)


def test_metrics_document_and_matrix_files(spark, tmp_path):
    df = predictions(spark, PUBLISHED["linear"]["matrix"])
    matrix = metrics.confusion_matrix(df, CLASSES)
    document = metrics.metrics_document(matrix, CLASSES, "linear")
    writers.write_metrics(document, str(tmp_path / "metrics"))
    (path,) = (tmp_path / "metrics").glob("*.txt")
    written = json.loads(path.read_text())
    assert list(written) == [
        "model", "macro_f1", "weighted_f1", "accuracy", "classes",
        "confusion_matrix", "classification_report",
    ]
    assert written["macro_f1"] == 0.8387
    assert written["classes"] == CLASSES
    assert written["confusion_matrix"] == PUBLISHED["linear"]["matrix"]
    report = written["classification_report"]
    assert list(report) == [*CLASSES, "accuracy", "macro avg", "weighted avg"]
    assert report["gender"]["f1-score"] == pytest.approx(0.8888888888888888)
    assert report["weighted avg"]["support"] == 4602.0

    writers.write_confusion_matrix(matrix, CLASSES, str(tmp_path / "matrix"))
    (path,) = (tmp_path / "matrix").glob("*.csv")
    lines = path.read_text().splitlines()
    assert lines[0].split(",")[1:] == [f"Pred_{c}" for c in CLASSES]
    assert lines[1] == "Actual_age,779,2,0,9,9,1"
    assert len(lines) == 7


def test_no_row_is_lost_in_wide_form_and_document(spark, tmp_path):
    rows = [("a", "a"), ("a", "new"), (None, "b"), ("b", None), ("gone", "gone")]
    df = spark.createDataFrame(rows, "actual string, pred string")
    matrix = metrics.confusion_matrix(df, ["a", "b"])
    wide = {r["class"]: tuple(r)[1:] for r in metrics.confusion_wide(matrix, ["a", "b"]).collect()}
    assert wide == {"Actual_a": (1, 0, 1), "Actual_b": (0, 0, 1), "Actual_(other)": (0, 1, 1)}
    writers.write_confusion_matrix(matrix, ["a", "b"], str(tmp_path / "matrix"))
    (path,) = (tmp_path / "matrix").glob("*.csv")
    assert len(path.read_text().splitlines()) == 4
    document = json.loads(metrics.metrics_document(matrix, ["a", "b"], 'quo"ted').first().document)
    assert document["classes"] == ["a", "b", "(other)", "gone", "new"] and document["model"] == 'quo"ted'
    assert sum(map(sum, document["confusion_matrix"])) == len(rows)
    assert document["confusion_matrix"][0] == [1, 0, 0, 0, 1]


def test_many_models_in_one_aggregation(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.6), ("b", 0.95), (None, 0.7)], "actual string, p double")
    preds = {str(t): F.when(F.col("p") >= t, "b").otherwise("a") for t in (0.5, 0.9)}
    cells = metrics.confusion_matrices(df, ["a", "b"], preds)
    for t in (0.5, 0.9):
        one = df.withColumn("pred", preds[str(t)])
        want = metrics.confusion_matrix(one, ["a", "b"]).collect()
        got = cells.where(F.col("model") == str(t)).drop("model").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
