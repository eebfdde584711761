"""Classification metrics over ``(actual, pred)``.

Rows are reduced to at most k*k cells in one aggregation; everything after that
works on the cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _class_table(spark, classes: Sequence) -> DataFrame:
    return spark.createDataFrame(
        [(i, c) for i, c in enumerate(classes)], "class_no int, label string"
    )


def class_list(df: DataFrame, *columns: str) -> list[str]:
    """Sorted classes found in the columns; a class list is driver-sized."""
    found = None
    for name in columns:
        part = df.where(F.col(name).isNotNull()).select(
            F.col(name).cast("string").alias("label")
        )
        found = part if found is None else found.unionByName(part)
    return sorted(row.label for row in found.distinct().collect())


def confusion_matrix(
    df: DataFrame, classes: Sequence[str], actual: str = "actual", pred: str = "pred"
) -> DataFrame:
    """``(actual, pred, n)``: all k*k cells, zeros included, and no row left out.

    Classes outside the list and missing ones follow in cells of their own, only
    where rows have them, so that totals and accuracy cover every row.
    """
    spark = df.sparkSession
    cells = df.groupBy(
        F.col(actual).cast("string").alias("actual"),
        F.col(pred).cast("string").alias("pred"),
    ).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame(
        [(a, p) for a in classes for p in classes], "actual string, pred string"
    )
    # One aggregation of zeros and counts; a null class groups like any other.
    zeros = grid.withColumn("n", F.lit(0).cast("long"))
    return zeros.unionByName(cells).groupBy("actual", "pred").agg(F.sum("n").alias("n"))


def confusion_matrices(
    df: DataFrame, classes: Sequence[str], preds: Mapping[str, Column], actual: str = "actual"
) -> DataFrame:
    """``(model, actual, pred, n)`` of many models or thresholds in one aggregation.

    ``preds`` has the predicted class of each model, as a column of ``df``; rows are
    combined per task before they move, so a model costs a few counters.
    """
    verdicts = F.array(
        *[F.struct(F.lit(m).alias("model"), p.cast("string").alias("pred")) for m, p in preds.items()]
    )
    cells = (
        df.select(F.col(actual).cast("string").alias("actual"), F.inline(verdicts))
        .groupBy("model", "actual", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = [(m, a, p, 0) for m in preds for a in classes for p in classes]
    zeros = df.sparkSession.createDataFrame(
        grid, "model string, actual string, pred string, n long"
    )
    cells = zeros.unionByName(cells).groupBy("model", "actual", "pred")
    return cells.agg(F.sum("n").alias("n"))


OTHER = "(other)"


def grouped_classes(matrix: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The matrix with classes outside the list, and missing ones, as one class."""

    def known(column: str) -> Column:
        return F.when(F.col(column).isin(list(classes)), F.col(column)).otherwise(F.lit(OTHER))

    return (
        matrix.select(known("actual").alias("actual"), known("pred").alias("pred"), "n")
        .groupBy("actual", "pred")
        .agg(F.sum("n").alias("n"))
    )


def confusion_wide(matrix: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Rows ``Actual_*``, columns ``Pred_*``, both in class order.

    Every row of the data is counted: classes outside the list and missing ones are in the
    row and column ``(other)``, which come last.
    """
    every = [*classes, OTHER]
    order = _class_table(matrix.sparkSession, every).withColumnRenamed("label", "actual")
    wide = grouped_classes(matrix, classes).groupBy("actual").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("pred") == c, F.col("n"))), F.lit(0)).alias(
                f"Pred_{c}"
            )
            for c in every
        ]
    )
    return (
        order.join(wide, "actual", "left")
        .orderBy("class_no")
        .select(
            F.concat(F.lit("Actual_"), "actual").alias("class"),
            *[F.coalesce(f"Pred_{c}", F.lit(0)).alias(f"Pred_{c}") for c in every],
        )
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def class_report(matrix: DataFrame) -> DataFrame:
    """``(label, precision, recall, f1, support)``; 0/0 counts as 0.

    A class outside the list has a row of its own; a missing class counts for the
    class on the other side only.
    """
    n = F.col("n")
    # Every cell counts for its row (actual) and its column (predicted).
    sides = matrix.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("label"),
                    F.when(F.col("actual") == F.col("pred"), n)
                    .otherwise(F.lit(0))
                    .alias("tp"),
                    n.alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                ),
                F.struct(
                    F.col("pred").alias("label"),
                    F.lit(0).cast("long").alias("tp"),
                    F.lit(0).cast("long").alias("support"),
                    n.alias("predicted"),
                ),
            )
        )
    )
    summed = sides.where("label is not null").groupBy("label").agg(
        F.sum("tp").alias("tp"),
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
    )
    return summed.select(
        "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def summary_metrics(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted averages, support.

    Accuracy and support cover all rows of the matrix; rows without a class count
    as wrong.
    """
    report = class_report(matrix)
    n = F.col("n")
    rows = matrix.agg(
        F.sum("n").alias("_rows"),
        F.sum(F.when(F.col("actual") == F.col("pred"), n).otherwise(0)).alias("_right"),
    )

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    averages = report.agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
    )
    # One row on either side.
    return averages.join(F.broadcast(rows)).select(
        _ratio(F.col("_right"), F.col("_rows")).alias("accuracy"),
        *averages.columns,
        F.coalesce("_rows", F.lit(0)).alias("support"),
    )


def log_loss(df: DataFrame, probability_of_actual: Column) -> DataFrame:
    """Mean cross-entropy over rows."""
    clipped = F.greatest(probability_of_actual, F.lit(1e-15))
    return df.agg(F.avg(-F.log(clipped)).alias("log_loss"))


def compare_models(summaries: Mapping[str, DataFrame], baseline: str) -> DataFrame:
    """Headline metrics per model and the distance to the score to beat."""
    rows = None
    for name, summary in summaries.items():
        row = summary.select(
            F.lit(name).alias("model"), "macro_f1", "weighted_f1", "accuracy"
        )
        rows = row if rows is None else rows.unionByName(row)
    to_beat = summaries[baseline].select("macro_f1").scalar()
    return rows.select(
        "model",
        "macro_f1",
        "weighted_f1",
        "accuracy",
        (F.col("macro_f1") - to_beat).alias("macro_f1_delta"),
    )


def metrics_document(
    matrix: DataFrame, classes: Sequence[str], model: str
) -> DataFrame:
    """One row of one JSON text, ``document``: headline metrics, classes, matrix, report.

    The matrix is read once, as its cells; classes outside the list that rows have follow
    the listed ones by name, missing classes count as ``(other)``.
    """
    listed = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>")
    named = matrix.select(
        F.coalesce("actual", F.lit(OTHER)).alias("actual"),
        F.coalesce("pred", F.lit(OTHER)).alias("pred"),
        "n",
    )
    cells = named.groupBy("actual", "pred").agg(F.sum("n").alias("n"))
    # k * k rows meet in one row each.
    matrix_row = cells.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.struct("actual", "pred").alias("k"), F.col("n").alias("v")))
        ).alias("cells"),
        F.array_distinct(F.flatten(F.collect_list(F.array("actual", "pred")))).alias("found"),
    )
    every = F.concat(listed, F.array_sort(F.array_except("found", listed)))
    matrix_row = matrix_row.select("cells", every.alias("classes"))
    grid = F.transform(
        "classes",
        lambda a: F.transform(
            "classes",
            lambda p: F.coalesce(
                F.try_element_at(F.col("cells"), F.struct(a.alias("actual"), p.alias("pred"))),
                F.lit(0),
            ),
        ),
    )
    report, summary = class_report(named), summary_metrics(matrix)
    rates = ("precision", "recall", "f1")

    def entry(columns: Sequence[str]) -> Column:
        names = ("precision", "recall", "f1-score")
        return F.struct(
            *[F.col(c).alias(n) for c, n in zip(columns, names)],
            F.col("support").cast("double").alias("support"),
        )

    per_class = report.agg(
        F.map_from_entries(F.collect_list(F.struct("label", entry(rates).alias("e")))).alias("by")
    )
    both = matrix_row.crossJoin(per_class).crossJoin(summary)  # one row each
    nothing = F.struct(
        *[F.lit(0.0).alias(n) for n in ("precision", "recall", "f1-score", "support")]
    )

    def quoted(text: Column) -> Column:
        return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)

    def pair(key: Column, value: Column) -> Column:
        return F.concat(quoted(key), F.lit(":"), value)

    classes_part = F.transform(
        "classes", lambda c: pair(c, F.to_json(F.coalesce(F.try_element_at(F.col("by"), c), nothing)))
    )
    averages = [
        pair(F.lit(f"{kind} avg"), F.to_json(entry([f"{kind}_{x}" for x in rates])))
        for kind in ("macro", "weighted")
    ]
    report_part = F.concat(
        classes_part,
        F.array(pair(F.lit("accuracy"), F.col("accuracy").cast("string")), *averages),
    )
    braces = lambda parts: F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    headline = [
        pair(F.lit(x), F.round(x, 4).cast("string")) for x in ("macro_f1", "weighted_f1", "accuracy")
    ]
    document = braces(
        F.array(
            pair(F.lit("model"), quoted(F.lit(model))),
            *headline,
            pair(F.lit("classes"), F.to_json("classes")),
            pair(F.lit("confusion_matrix"), F.to_json(grid)),
            pair(F.lit("classification_report"), braces(report_part)),
        )
    )
    return both.select(document.alias("document"))
