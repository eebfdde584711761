"""Helpers shared by the operators: word hashes, gapless ranks, components."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilspark.session import materialise

WHITESPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANK_TASK = 50_000

_SEED = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word of ``text`` after lower-casing A-Z; empty for null."""
    if not text:
        return np.empty(0, np.uint64)
    # bytes.lower() and bytes.split() know ASCII only, as the words are defined
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes (int64) of the ``width``-word shingles of a whole text.

    A text with fewer words gives one shingle of all its words, a text without
    words none.
    """
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    length = min(width, n)
    hashes = np.full(n - length + 1, np.uint64(length), np.uint64)
    for offset in range(length):  # odd multipliers keep the order of the words
        factor = np.uint64((int(_SEED) * (2 * offset + 3)) % 2**64 | 1)
        hashes += words[offset : offset + n - length + 1] * factor
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(29)
    return np.unique(hashes.view(np.int64))


def rank_parts(rows: int, per_task: int = ROWS_PER_RANK_TASK) -> int:
    """Number of buckets that keeps about ``per_task`` rows in each."""
    return max(1, math.ceil(rows / per_task))


def gapless_rank(
    df: DataFrame, keys: list[str], order: list[str], parts: int, name: str
) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in column ``name``.

    The rows of a key are dealt to ``parts`` hash buckets of their order columns and
    numbered there; running totals of the bucket sizes give each bucket its start.
    So a key with a third of all rows is numbered by many tasks.  Null keys form a
    key of their own, repeated rows get numbers of their own.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sizes.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_part").alias("_key_part"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    same = F.col("_part") == F.col("_key_part")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return (
        dealt.withColumn("_row", F.row_number().over(within))
        .join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_row") - 1)
        .select(*df.columns, name)
    )


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    parts: int,
    purpose: str,
    totals: dict[str, str] | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each key in the given order, in column ``nth`` from 0.

    ``totals`` maps new columns to those whose running sum, the row included, they hold.
    ``per_key`` has the keys and further columns that the rows of the key get.

    The rows are dealt to ``parts`` ranges of (keys, order) and written with the number
    of their range; sums per range and key place the ranges one after the other.  A key
    with a third of all rows lies in many ranges, and columns of ``per_key`` reach its
    rows through its ranges.  Null keys form a key of their own.  Ranges cannot part
    rows with equal keys and order: end the order with a column that tells them apart.
    """
    totals = totals or {}
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn(
        "_part", F.spark_partition_id()
    )
    dealt = materialise(dealt, purpose)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = dealt.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(column).alias(f"_sum_{name}") for name, column in totals.items()],
    )
    starts = starts.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_part").alias("_key_part"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
            for name in totals
        ],
    )
    added = []
    if per_key is not None:
        added = [c for c in per_key.columns if c not in keys]
        named = per_key.select(*[F.col(k).alias(f"_own_{k}") for k in keys], *added)
        same = F.lit(True)
        for key in keys:
            same &= F.col(f"_key_{key}").eqNullSafe(F.col(f"_own_{key}"))
        starts = starts.join(named, same).drop(*[f"_own_{k}" for k in keys])
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = dealt.withColumn("_row", F.row_number().over(within))
    for name, column in totals.items():
        numbered = numbered.withColumn(f"_upto_{name}", F.sum(column).over(running))
    same = F.col("_part") == F.col("_key_part")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    return numbered.join(starts, same).select(
        *df.columns,
        (F.col("_first") + F.col("_row") - 1).alias("nth"),
        *[(F.col(f"_before_{n}") + F.col(f"_upto_{n}")).alias(n) for n in totals],
        *added,
    )


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``.

    ``component`` is the smallest node of the component.  Alternates the large-star
    and small-star steps; every round is written to the shared folder, so lost
    executors never replay earlier rounds.  Only nodes with an edge are returned.
    """
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now = materialise(edges.where("a <> b").select(*pair).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        state, before = _checksum(now), state
        if state == before:
            leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = now.select("b").distinct()
            return leaves.union(roots.select("b", "b"))
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.where("b > a")
            .join(low, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.where("low < a").select("a", "low"))
            .distinct()
        )
        large = materialise(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.select("a", "low"))
            .where("a <> b")
            .select(*pair)
            .distinct()
        )
        now = materialise(small, "edges")
    raise RuntimeError("components did not settle")


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ... and the new name of each old one.

    For operators that return the columns of their input beside their own: no name of the
    input clashes then.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(reversed(docs.columns), reversed(names)))


def sample_texts(rows: DataFrame, per_group: int, group: str, text: str) -> DataFrame:
    """``(group, text)``: about ``per_group`` distinct texts of each group, by their hashes.

    The ``per_group`` smallest hashes of a group's distinct texts are drawn, so copies weigh
    nothing, every group has its texts, and the same rows give the same sample.  Only hashes
    move until the drawn ones are known; of each, one text per task moves.
    """
    rows = rows.select(F.col(group).alias("group"), F.col(text).alias("text"))
    rows = rows.where("group is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("group").agg(F.approx_count_distinct("h").alias("texts"))
    # Twice what is wanted, in case the estimate is off; all of a small group.
    share = F.when(F.col("texts") > 2 * per_group, 2.0 * per_group / F.col("texts"))
    sizes = sizes.select(F.col("group").alias("_group"), F.coalesce(share, F.lit(2.0)).alias("share"))
    spread = (F.pmod("h", F.lit(1 << 40)) / F.lit(1 << 40)).alias("at")
    hashes = rows.select("group", "h", spread).join(
        sizes, F.col("group") == F.col("_group")
    ).where("at < share").select("group", "h", "at").distinct()
    first = F.row_number().over(Window.partitionBy("group").orderBy("at", "h"))
    drawn = hashes.withColumn("_nth", first).where(F.col("_nth") <= per_group)
    drawn = materialise(drawn.select(F.col("group").alias("_group"), F.col("h").alias("_h")), "sample")
    same = (F.col("group") == F.col("_group")) & (F.col("h") == F.col("_h"))
    # At most per_group rows per group.
    found = rows.join(F.broadcast(drawn), same, "left_semi")
    return found.groupBy("group", "h").agg(F.min("text").alias("text")).select("group", "text")
