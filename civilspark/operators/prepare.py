"""Data preparation: profile, keep-first dedupe, length filter, stratified split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.functions.text import has_min_length
from civilspark.operators.sizes import broadcast_if_small
from civilspark.session import materialise


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, row count, null count. One pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.count_if(F.col(f"`{name}`").isNull()).alias(f"_nulls{i}")
            for i, name in enumerate(df.columns)
        ],
    )
    return counted.select(
        F.col("_rows").alias("row_count"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(name).alias("column_name"),
                        F.col(f"_nulls{i}").alias("null_count"),
                    )
                    for i, name in enumerate(df.columns)
                ]
            )
        ),
    ).select("position", "column_name", "row_count", "null_count")


def text_key(text: Column) -> Column:
    """Short stand-in for a text in shuffles; NULL stays NULL."""
    return F.sha2(text, 256)


def copy_ids(keyed: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """Ids of all rows of ``keyed`` but the first, by unique id, of every key.

    A missing key counts as one key.  Rows without an id have no order among copies: none
    of them is a copy, so all stay, here and wherever this list is applied.  Map-side
    aggregation leaves one row per task for a key that fills a third of the table.
    """
    known = keyed.where(F.col(id_col).isNotNull())
    first = known.groupBy(key_col).agg(F.min(id_col).alias(id_col)).select(id_col)
    return known.select(id_col).join(first, id_col, "left_anti")


def drop_duplicate_texts(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Keep the first row (by unique id) of every distinct text.

    Digests and ids are written once; the ids to remove come from them.  Few of them are
    broadcast, so that no text moves and texts are read once more; many are joined on the
    id, which is unique, so a text with many copies makes no hot key.
    """
    keyed = materialise(df.select(F.col(id_col), text_key(F.col(text_col)).alias("_key")), "keys")
    gone = materialise(copy_ids(keyed, "_key", id_col), "copies")
    return df.join(broadcast_if_small(gone, as_literals=False), id_col, "left_anti").select(
        *df.columns
    )


def duplicate_counts(df: DataFrame, text_col: str) -> DataFrame:
    """One row: total, removed, remaining."""
    per_text = (
        df.select(text_key(F.col(text_col)).alias("_key"))
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return per_text.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("remaining"),
    ).select(
        "total_rows",
        (F.col("total_rows") - F.col("remaining")).alias("removed"),
        "remaining",
    )


def class_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """Count and percentage per class, most frequent first; NULL is no class."""
    counts = (
        df.where(F.col(label_col).isNotNull())
        .groupBy(label_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per class reaches the unpartitioned total.
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.select(label_col, "n", F.round(share, 2).alias("pct")).orderBy(
        F.desc("n"), label_col
    )


def min_length_filter(
    df: DataFrame, text_col: str, length: int = fixed.MIN_TEXT_LENGTH
) -> DataFrame:
    """Rows whose stripped text has at least ``length`` characters."""
    return df.where(has_min_length(F.col(text_col), length))


def split_key(id_col: str, seed: int = fixed.SEED) -> Column:
    """Seeded pseudo-random order of the rows, reproducible in plain SQL.

    Rows without an id have one place in it, so a class has them all in one part.
    """
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), text))


def stratified_split(
    df: DataFrame,
    label_col: str,
    id_col: str,
    seed: int = fixed.SEED,
    parts: Sequence[tuple[str, int]] = (("train", 8), ("val", 1), ("test", 1)),
    prefix_length: int = 4,
) -> DataFrame:
    """Exact stratified split: adds ``split``.

    Within a class, rows ordered by (seeded hash, id) are cut at whole fractions
    of the class size.  No class is ever sorted as a whole: rows are counted per
    (class, hash prefix), running totals over that small table show which prefix
    holds each cut, and only those prefixes are ranked.  The rows themselves are
    compared with the cut of their class and never shuffled.  The cuts are
    computed when this function is called (a few rows per class).
    """
    whole = sum(share for _, share in parts)
    names = [name for name, _ in parts]
    cuts_at, upto = [], 0
    for _, share in parts[:-1]:
        upto += share
        cuts_at.append(upto)

    keyed = df.select(
        F.col(label_col).alias("_label"),
        F.col(id_col).alias("_id"),
        split_key(id_col, seed).alias("_h"),
    ).withColumn("_bucket", F.substring("_h", 1, prefix_length))

    # At most 16^prefix_length rows per class.
    in_class = Window.partitionBy("_label")
    running = in_class.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    buckets = (
        keyed.groupBy("_label", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(in_class))
    )
    wanted = buckets.select(
        "_label",
        "_bucket",
        (F.col("_upto") - F.col("_n")).alias("_before"),
        "_upto",
        F.posexplode(
            F.array(
                *[F.floor(F.col("_total") * c / whole).cast("long") for c in cuts_at]
            )
        ).alias("_cut", "_rank"),
    ).where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_upto")))
    wanted = broadcast_if_small(
        wanted.select(
            "_label", "_bucket", "_cut", (F.col("_rank") - F.col("_before")).alias("_rank")
        )
    )
    hits = keyed.join(
        wanted.withColumnsRenamed({"_label": "_wl", "_bucket": "_wb"}),
        F.col("_label").eqNullSafe(F.col("_wl")) & (F.col("_bucket") == F.col("_wb")),
    )
    ranked = hits.withColumn(
        "_rn",
        F.row_number().over(
            Window.partitionBy("_label", "_bucket", "_cut").orderBy("_h", "_id")
        ),
    ).where(F.col("_rn") == F.col("_rank"))
    cut_rows = ranked.groupBy("_label").agg(
        *[
            F.max(F.when(F.col("_cut") == i, F.struct("_h", "_id"))).alias(f"_cut{i}")
            for i in range(len(cuts_at))
        ]
    )
    cut_rows = broadcast_if_small(cut_rows.withColumnRenamed("_label", "_wl"))

    me = F.struct(split_key(id_col, seed).alias("_h"), F.col(id_col).alias("_id"))
    choice = F.lit(names[-1])
    for i in reversed(range(len(cuts_at))):
        choice = F.when(me <= F.col(f"_cut{i}"), names[i]).otherwise(choice)
    return (
        df.join(cut_rows, F.col(label_col).eqNullSafe(F.col("_wl")), "left")
        .withColumn("split", choice)
        .select(*df.columns, "split")
    )


def split_summary(df: DataFrame) -> DataFrame:
    """Rows and percentage per split."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.select("split", "n", F.round(share, 1).alias("pct"))
