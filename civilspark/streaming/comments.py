"""Moderation of comments as they arrive.

The stream runs the same projection as the batch report, so it keeps no state;
only the running summary does, and its state is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civilspark import fixed_values as fixed
from civilspark.functions.text import is_blank
from civilspark.operators.scoring import (
    Lexicon,
    Scorer,
    batch_report,
    batch_summary,
    predict_batch,
)


def comment_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options
) -> DataFrame:
    """File source with an explicit schema; ``path`` may be a glob."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def score_comments(
    comments: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] = (),
    scorer: Lexicon | Scorer | None = None,
    threshold: float = fixed.THRESHOLD,
) -> DataFrame:
    """Prediction records of the non-blank comments; batch or stream."""
    present = comments.where(~is_blank(F.col(text_col)))
    return predict_batch(present, text_col, scorer, threshold, keep)


def write_reports(
    scored: DataFrame, ids: Sequence[str], output: str, checkpoint: str
) -> StreamingQuery:
    """Append flat report rows to a parquet folder until the input is drained."""
    return (
        batch_report(scored, ids)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_summaries(scored: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Running totals: every batch replaces the one-row summary in ``output``."""

    def replace(summary: DataFrame, _batch_id: int) -> None:
        summary.coalesce(1).write.mode("overwrite").parquet(output)

    return (
        batch_summary(scored)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )
