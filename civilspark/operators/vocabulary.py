"""Token frequencies, vocabulary, encoding and decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from civilspark import fixed_values as fixed
from civilspark.functions.tokens import word_tokens
from civilspark.operators.ranking import first_rows
from civilspark.operators.sizes import broadcast_if_small, lookup
from civilspark.session import materialise

# Token positions per document fit in 31 bits, as array sizes do.
_POSITIONS = 2**31


def token_frequency(df: DataFrame, text_col: str) -> DataFrame:
    """Occurrences of every token; counted map-side before the shuffle."""
    return (
        df.select(F.explode(word_tokens(F.col(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def build_vocabulary(
    df: DataFrame,
    text_col: str,
    id_col: str,
    max_vocab_size: int = fixed.VOCAB_MAX_SIZE,
    min_freq: int = fixed.VOCAB_MIN_FREQ,
) -> DataFrame:
    """``(token, idx, freq)``: most frequent first, ties in order of first sight.

    First sight is the pair (id, position); ids may have any type with an order.  Whole
    numbers are packed with the position into one decimal, which keeps the aggregation a
    hash aggregation with map-side combining.  A row without an id comes first.

    The counts are written once.  The histogram of frequencies says which frequency the
    size cuts; more frequent tokens are all in, and of those with that frequency the first
    seen, found by range (``ranking.first_rows``).  So no task gets more than the result.
    """
    spark = df.sparkSession
    if isinstance(df.schema[id_col].dataType, IntegralType):
        seen = (
            F.col("_id").cast("decimal(20,0)") * F.lit(_POSITIONS).cast("decimal(10,0)")
            + F.col("_pos")
        ).cast("decimal(38,0)")
    else:
        seen = F.struct("_id", "_pos")
    counted = (
        df.select(
            F.col(id_col).alias("_id"),
            F.posexplode(word_tokens(F.col(text_col))).alias("_pos", "token"),
        )
        .select("token", seen.alias("_seen"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("freq"), F.min("_seen").alias("_seen"))
        .where(F.col("freq") >= min_freq)
    )
    counted = materialise(counted, "token-counts")
    wanted = max(max_vocab_size - 2, 0)
    histogram = counted.groupBy("freq").agg(F.count(F.lit(1)).alias("tokens"))
    ahead = F.sum("tokens").over(Window.orderBy(F.desc("freq")))  # one row per frequency
    cut = histogram.withColumn("ahead", ahead).where(F.col("ahead") > wanted)
    cut = cut.orderBy(F.desc("freq")).first()
    top = counted
    if cut is not None:
        tied = counted.where(F.col("freq") == cut.freq)
        left = wanted - (cut.ahead - cut.tokens)
        top = counted.where(F.col("freq") > cut.freq).unionByName(
            first_rows(tied, ["_seen", "token"], left, cut.tokens)
        )
    order = [F.desc("freq"), F.asc("_seen"), F.asc("token")]
    ranked = top.select(
        "token",
        (F.row_number().over(Window.orderBy(*order)) + fixed.UNK_INDEX).alias("idx"),
        "freq",
    )
    reserved = spark.createDataFrame(
        [
            (fixed.PAD_TOKEN, fixed.PAD_INDEX, 0),
            (fixed.UNK_TOKEN, fixed.UNK_INDEX, 0),
        ],
        "token string, idx int, freq long",
    )
    return materialise(reserved.unionByName(ranked), "vocabulary")


def _regroup(rows: DataFrame, ids: Sequence[str], value: str) -> DataFrame:
    """Arrays of ``value`` in ``_pos`` order; rows without position are empty."""
    pairs = F.collect_list(
        F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.col(value).alias("v")))
    )
    return (
        rows.groupBy(*ids)
        .agg(F.array_sort(pairs).alias("_pairs"))
        .select(*ids, F.transform("_pairs", lambda p: p["v"]).alias("_values"))
    )


def encode(
    df: DataFrame,
    ids: Sequence[str],
    text_col: str,
    vocabulary: DataFrame,
    max_length: int = fixed.ENCODE_LENGTH,
) -> DataFrame:
    """``ids`` plus ``token_ids``: fixed length, unknown 1, right-padded with 0.

    Tokens are cut to ``max_length`` before the fan-out, so a document makes at
    most that many rows.
    """
    tokens = F.slice(word_tokens(F.col(text_col)), 1, max_length)
    tokens_of = df.select(*ids, F.posexplode_outer(tokens).alias("_pos", "token"))
    # The first tokens of a vocabulary are the frequent ones.
    rows = lookup(tokens_of, vocabulary.select("token", "idx"), "token", "idx").withColumn(
        "_idx", F.coalesce("idx", F.lit(fixed.UNK_INDEX))
    )
    padding = F.array_repeat(
        F.lit(fixed.PAD_INDEX), F.lit(max_length) - F.size("_values")
    )
    return _regroup(rows, ids, "_idx").select(
        *ids, F.concat("_values", padding).alias("token_ids")
    )


def decode(
    df: DataFrame, ids: Sequence[str], vocabulary: DataFrame, ids_col: str = "token_ids"
) -> DataFrame:
    """``ids`` plus ``tokens``: the reverse lookup of ``encode``."""
    rows = df.select(*ids, F.posexplode_outer(ids_col).alias("_pos", "idx"))
    rows = lookup(rows, vocabulary.select("idx", "token"), "idx", "idx")
    return _regroup(rows, ids, "token").select(*ids, F.col("_values").alias("tokens"))


def masked_mean_pool(
    encoded: DataFrame,
    ids: Sequence[str],
    vectors: DataFrame,
    size: int,
    ids_col: str = "token_ids",
    idx_col: str = "idx",
    vector_col: str = "embedding",
) -> DataFrame:
    """Mean vector of the non-pad tokens as ``(ids, dim, mean)``.

    One aggregate per dimension keeps a token one row instead of ``size`` rows.
    A document without tokens gets zeros (its length counts as 1).
    """
    known = broadcast_if_small(
        vectors.select(F.col(idx_col).cast("int").alias("_idx"), vector_col),
        as_literals=False,
    )
    rows = _non_pad_rows(encoded, ids, ids_col).join(known, "_idx", "left")
    sums = rows.groupBy(*ids).agg(
        F.count("_idx").alias("_n"),
        *[
            F.sum(F.get(F.col(vector_col), F.lit(i)).cast("double")).alias(f"_s{i}")
            for i in range(size)
        ],
    )
    length = F.greatest(F.col("_n"), F.lit(1))
    means = F.array(
        *[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) / length for i in range(size)]
    )
    return sums.select(*ids, F.posexplode(means).alias("dim", "mean"))


def _non_pad_rows(encoded: DataFrame, ids: Sequence[str], ids_col: str) -> DataFrame:
    """One row per non-pad token; a document of pads keeps one empty row."""
    kept = F.filter(F.col(ids_col), lambda i: i != fixed.PAD_INDEX)
    return encoded.select(*ids, F.explode_outer(kept).alias("_idx"))
