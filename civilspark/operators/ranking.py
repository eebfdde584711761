"""The first rows of a large table, without one task that sees them all."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civilspark.session import materialise

ROWS_PER_RANGE = 100_000


def first_rows(df: DataFrame, order: Sequence[str], n: int, rows: int) -> DataFrame:
    """The first ``n`` of about ``rows`` rows in an order without ties.

    Rows are dealt to ranges of the order and written; the sizes of the ranges say which
    one the cut lies in, and only that one is ranked.
    """
    if n <= 0:
        return df.limit(0)
    parts = max(1, math.ceil(rows / ROWS_PER_RANGE))
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    ahead = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    cut = sizes.withColumn("_ahead", ahead).where(F.col("_ahead") < n).orderBy(F.desc("_part")).first()
    if cut is None:
        return dealt.drop("_part")
    last = dealt.where(F.col("_part") == cut["_part"])
    rank = F.row_number().over(Window.orderBy(*order))
    last = last.withColumn("_rank", rank).where(F.col("_rank") <= n - cut["_ahead"])
    whole = dealt.where(F.col("_part") < cut["_part"])
    return whole.drop("_part").unionByName(last.drop("_part", "_rank"))
