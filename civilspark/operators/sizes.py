"""Size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
# Of the rows written as text; well under the memory of any executor.
MAX_BROADCAST_BYTES = 64 << 20
SLOTS = 1 << 20  # of hashed keys; that many numbers are broadcast at most


def broadcast_if_small(
    df: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    as_literals: bool = True,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Broadcast ``df`` when it provably has at most ``max_rows`` rows and ``max_bytes``.

    The check reads at most ``max_rows + 1`` rows.  A small table comes back as
    literal rows, so joining it neither shuffles the big side nor computes the
    table again; a larger one comes back unchanged and is joined the way Spark
    chooses.  Meant for class-level and vocabulary-level tables with narrow rows;
    with ``as_literals=False`` rows are only measured and stay in the JVM, which
    suits wide rows of a table that is cheap to read.
    """
    head = df.limit(max_rows + 1)
    if not as_literals:
        width = F.octet_length(F.to_json(F.struct("*")))
        size = head.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("width")).first()
        return F.broadcast(df) if size.n <= max_rows and (size.width or 0) <= max_bytes else df
    rows = head.collect()
    if len(rows) > max_rows or sum(len(str(tuple(r))) for r in rows) > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def likely_in(df: DataFrame, key: str, wanted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among those of ``wanted``: all that are, few others.

    Keys are hashed to ``slots`` numbers, which are broadcast, so no row is moved.  For
    use ahead of a costly projection whose result is joined to ``wanted`` afterwards.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    there = wanted.select(slot.alias("_slot")).distinct()
    return df.join(F.broadcast(there), slot == F.col("_slot"), "left_semi")


def lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    rank: str,
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = 1 << 16,
) -> DataFrame:
    """Left join of ``df`` with ``table`` on ``key``, whatever the size of the table.

    A small table is broadcast.  Of a larger one, which has unique keys, the rows with
    ``rank`` below ``max_rows`` are: with ranks by falling frequency these hold the hot
    keys.  What they do not answer meets the rest of the table in a shuffle; rows that are
    answered are dealt evenly meanwhile.
    """
    if table.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(table), key, "left")
    value = next(c for c in table.columns if c != key)
    hot = table.where(F.col(rank) < max_rows)
    hot = hot.select(F.col(key).alias("_hot_key"), F.struct(value).alias("_hot"))
    rest = table.where(F.col(rank) >= max_rows).select(
        F.col(key).alias("_key"), F.lit(0).alias("_salt"), F.struct(value).alias("_rest")
    )
    found = df.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    # Nothing in the table has a salt above 0.
    dealt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)) + 1
    answered = F.col("_hot").isNotNull() | F.col(key).isNull()
    found = found.withColumn("_own_salt", F.when(answered, dealt).otherwise(F.lit(0)).cast("int"))
    same = (F.col(key) == F.col("_key")) & (F.col("_own_salt") == F.col("_salt"))
    joined = found.join(rest, same, "left")
    return joined.select(
        key, *[c for c in df.columns if c != key], F.coalesce("_hot", "_rest")[value].alias(value)
    )
