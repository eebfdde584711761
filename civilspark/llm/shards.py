"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group.  Groups sorted by falling size enter the bin
with the tightest remaining capacity that holds them; open bins sit in a balanced
(bisected) order.  Only the histogram of group sizes comes to the driver: groups of one
size are alike, so a whole run of them enters a bin at once.  The number of distinct
sizes D is bounded by sqrt(2 * total size), and does not depend on the number of groups.

A group that is larger than a bin cannot stay whole; it is dealt evenly to the fewest
pieces that fit.  Null texts count as empty ones, of size 1.  Null ids and repeated
rows are rows like any other.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.llm.common import gapless_rank, plain_names, rank_parts, text_or_empty
from civilspark.session import materialise


def best_fit_decreasing(
    histogram: list[tuple[int, int]], capacity: int
) -> list[tuple[int, int, int, int]]:
    """Place ``(size, count)`` items: runs ``(size, first, count, bin)``.

    ``first`` counts the items of a size from 0.  Sizes above ``capacity`` are refused.
    """
    open_bins: list[tuple[int, int]] = []  # (remaining, bin), ordered
    runs, bins = [], 0
    for size, count in sorted(histogram, reverse=True):
        if size > capacity:
            raise ValueError(f"an item of {size} does not fit into {capacity}")
        first = 0
        while first < count:
            at = bisect.bisect_left(open_bins, (size, -1))
            if at < len(open_bins):
                remaining, number = open_bins.pop(at)
            else:
                remaining, number, bins = capacity, bins, bins + 1
            many = min(count - first, remaining // size)
            runs.append((size, first, many, number))
            bisect.insort(open_bins, (remaining - many * size, number))
            first += many
    return runs


def least_capacity(histogram: list[tuple[int, int]], bins: int) -> int:
    """Smallest capacity found by bisection at which the items take ``bins`` bins."""
    total = sum(s * n for s, n in histogram)
    low = max([1, math.ceil(total / bins), *(s for s, _ in histogram)])
    high = low + max([0, *(s for s, _ in histogram)])

    def fits(capacity: int) -> bool:
        return max((r[3] for r in best_fit_decreasing(histogram, capacity)), default=0) < bins

    while not fits(high):
        high *= 2
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, digest)``; size is UTF-8 bytes plus one."""
    value = text_or_empty(text)
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(value) + 1).cast("bigint").alias("size"),
        F.crc32(value).alias("text_crc32"),
        F.unhex(F.md5(value)).alias("digest"),
    )


def pack(
    spark: SparkSession,
    docs: DataFrame,
    bins: int | None = None,
    capacity: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, size, text_crc32, digest, shard, slot)``.

    Give ``capacity`` for the fewest shards of a fixed capacity, or ``bins`` for that
    many shards of the least capacity.  ``slot`` numbers the rows of a shard.
    """
    if (bins is None) == (capacity is None):
        raise ValueError("give either bins or capacity")
    rows = materialise(sized(docs, doc_id, text), "sizes")
    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")
    )
    groups = materialise(groups, "groups").withColumn("weight", F.col("copies") * F.col("size"))
    totals = groups.agg(F.sum("weight"), F.sum("copies"), F.count(F.lit(1)), F.max("size")).first()
    total, n_rows, n_groups, largest = (int(x or 0) for x in totals)
    if capacity is None:
        ceiling = max(math.ceil(total / bins), largest, 1)
    else:
        ceiling = max(capacity, 1)
        if largest > ceiling:
            raise ValueError(f"a document of {largest} does not fit into {ceiling}")
    # Groups above a bin are dealt to pieces of nearly equal row counts.
    per_piece = F.floor(F.lit(ceiling) / F.col("size"))
    pieces = F.when(
        F.col("weight") > ceiling, F.ceil(F.col("copies") / per_piece)
    ).otherwise(F.lit(1))
    groups = groups.withColumn("pieces", pieces.cast("bigint"))
    split = groups.where("pieces > 1")
    parts = rank_parts(n_rows)
    large = rows.join(split.select("digest", "copies", "pieces"), "digest")
    large = gapless_rank(large, ["digest"], ["doc_id"], parts, "nth").withColumn(
        "piece", F.floor(F.col("nth") * F.col("pieces") / F.col("copies"))
    )
    items = (
        large.groupBy("digest", "piece")
        .agg(F.sum("size").alias("weight"))
        .union(
            groups.where("pieces = 1").select("digest", F.lit(0).cast("bigint"), "weight")
        )
    )
    items = materialise(items, "items")
    histogram = [
        (int(r.weight), int(r.n))
        for r in items.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).collect()
    ]
    room = ceiling if capacity is not None else least_capacity(histogram, bins)
    runs = best_fit_decreasing(histogram, room)
    table = spark.createDataFrame(
        [(s, f, f + n, b) for s, f, n, b in runs] or [(0, 0, 0, 0)],
        "weight bigint, first bigint, stop bigint, shard int",
    )
    ranked = gapless_rank(items, ["weight"], ["digest", "piece"], rank_parts(n_groups), "nth")
    placed = ranked.join(
        table.withColumnRenamed("weight", "run_weight"),
        (F.col("weight") == F.col("run_weight"))
        & (F.col("nth") >= F.col("first"))
        & (F.col("nth") < F.col("stop")),
    ).select("digest", "piece", "shard")
    whole = rows.join(split.select("digest"), "digest", "left_anti").withColumn(
        "piece", F.lit(0).cast("bigint")
    )
    dealt = whole.select(*rows.columns, "piece").union(large.select(*rows.columns, "piece"))
    out = materialise(dealt.join(placed, ["digest", "piece"]).drop("piece"), "placed")
    slots = gapless_rank(out, ["shard"], ["doc_id", "digest"], parts, "slot")
    return slots.select("doc_id", "size", "text_crc32", "digest", "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write whole documents below ``path/shard=N`` (ids must be unique)."""
    where = placed.select(F.col("doc_id").alias("_id"), "shard", "slot").hint("shuffle_hash")
    docs = docs.drop(*[c for c in ("shard", "slot") if c != doc_id])
    plain, name = plain_names(docs)
    placed_docs = plain.join(where, F.col(name[doc_id]) == F.col("_id")).drop("_id")
    placed_docs.toDF(*docs.columns, "shard", "slot").write.partitionBy("shard").parquet(path)


__all__ = ["best_fit_decreasing", "least_capacity", "pack", "sized", "write_shards"]
