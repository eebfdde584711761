"""Writers: splits, scored batches, metrics, vocabulary, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.operators.metrics import OTHER, confusion_wide
from civilspark.session import materialise

_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "escapeQuotes": True,
    # Spark trims fields when writing unless told not to.
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_splits(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """One folder per split, so a reader of one split scans only that folder."""
    writer = df.write.mode(mode).partitionBy("split")
    if fmt == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(fmt).save(path)


def read_split(
    spark: SparkSession, path: str, split: str, fmt: str = "parquet"
) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(multiLine=True, **_CSV)
    return reader.load(path).where(F.col("split") == split).drop("split")


def write_report(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists"
) -> None:
    """Flat table as CSV with header, or any other Spark format."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(fmt).save(path)


def write_metrics(document: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The one row of ``metrics.metrics_document`` as one JSON file."""
    document.coalesce(1).write.mode(mode).text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace("value", "\n$", "").alias("document")
    )


def write_confusion_matrix(
    matrix: DataFrame, classes: Sequence[str], path: str, mode: str = "errorifexists"
) -> None:
    """Labelled matrix: blank first heading, ``Pred_*`` columns, ``Actual_*`` rows.

    The row and column of other classes are there only where rows have such classes.
    """
    wide = materialise(confusion_wide(matrix, classes), "matrix")
    others = wide.agg(F.sum(f"`Pred_{OTHER}`") + F.sum(
        F.when(F.col("class") == f"Actual_{OTHER}", sum(F.col(f"`Pred_{c}`") for c in classes)).otherwise(0)
    )).first()[0]
    if not others:
        wide = wide.where(F.col("class") != f"Actual_{OTHER}").drop(f"Pred_{OTHER}")
    wide = wide.withColumnRenamed("class", " ")
    wide.coalesce(1).write.mode(mode).option("header", True).csv(path)


def save_vocabulary(
    vocabulary: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    vocabulary.write.mode(mode).parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_vocabulary_document(
    vocabulary: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """The vocabulary, which has a bounded size, as one JSON object without frequencies."""
    in_order = F.array_sort(F.collect_list(F.struct("idx", "token")))
    entries = F.transform(in_order, lambda e: F.struct(e["token"], e["idx"]))
    document = vocabulary.agg(
        F.to_json(
            F.struct(
                F.map_from_entries(entries).alias("word2idx"),
                F.lit(fixed.PAD_TOKEN).alias("pad_token"),
                F.lit(fixed.UNK_TOKEN).alias("unk_token"),
            )
        ).alias("document")
    )
    document.write.mode(mode).text(path)


def read_vocabulary_document(spark: SparkSession, path: str) -> DataFrame:
    """``(token, idx)`` of a vocabulary document; the reverse map follows from it."""
    parsed = F.from_json("value", "struct<word2idx map<string, int>>")
    return spark.read.text(path, wholetext=True).select(
        F.explode(parsed["word2idx"]).alias("token", "idx")
    )


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    """Fitted pipeline; the class list travels inside its label stages."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
