"""Mixing of sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, passed over ``passes`` times at
most.  A document's virtual finish time is the running total of words of its source, itself
included, divided by the source's target.  The mix is all queues merged by finish time: the
entries are sorted by range over all tasks and cut where their running total reaches the
budget.  At virtual time 1 each source has given its target, so an entry that starts before
1 and ends after it gives only the words up to 1; no source then depends on how long its
next document happens to be.

Targets share the budget by weight; a source whose share would exceed ``passes`` times its
words stops there, and the excess is shared by weight among the others.  That is the one
level at which all targets add up to the budget; running sums over the sources in order of
(limit / weight) find it without repeating.

The shuffle is a digest of the id and a seed, with equal ids in order of size and text, so
reruns agree.  All of it is DataFrame functions.  A source with a third of all rows lies in
many ranges (``common.ordered``); nothing is collected but the number of rows and words.

Null and empty texts have no words and give none.  A null source is a source like any other,
the last one.  Null ids are ids of their own.  Repeated rows stand side by side in the
queue, each with words of its own; where the cut falls between two equal rows, either may
give the words.  Very long texts are cut like short ones.  Ties of finish times go by
source, then by place in the queue.  An empty table gives an empty mix.  Only the named
columns are used, so columns of other names may be there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.llm.common import WORD, ordered, rank_parts
from civilspark.session import materialise

CYCLE = (5, 2, 1)
SHARE = (3, 2)  # 150 % of all words
PASSES = 2
SEED = "mix"


def sized(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = SEED,
) -> DataFrame:
    """``(doc_id, source, size, draw, tie, row)``: words of each text and its drawn place."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0))
        .cast("bigint")
        .alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("draw"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``sources`` with ``weight``: the cycle repeats along the sources by code point, null last."""
    parts = rank_parts(sources.count())
    numbered = ordered(sources, [], [F.asc_nulls_last("source")], parts, "sources")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    place = F.pmod("nth", F.lit(len(cycle))).cast("int")
    return numbered.select(*sources.columns, F.get(weights, place).alias("weight"))


def with_targets(sources: DataFrame, budget: float, passes: int = PASSES) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``, for positive weights.

    In order of (limit / weight), the sources before the first one whose share of what the
    earlier ones leave is within its limit stop at their limits.
    """
    rows = sources.withColumn("_limit", (passes * F.col("source_size")).cast("double"))
    rows = materialise(rows.withColumn("_ratio", F.col("_limit") / F.col("weight")), "sources")
    order = [F.col("_ratio"), F.asc_nulls_last("source")]
    sums = {"_limits": "_limit", "_weights": "weight"}
    placed = ordered(rows, [], order, rank_parts(rows.count()), "limits", totals=sums)
    everything = rows.agg(F.sum("weight").alias("all_weights"))
    # What a unit of weight gets if exactly the sources before this one stop.
    level = (F.lit(float(budget)) - (F.col("_limits") - F.col("_limit"))) / (
        everything.scalar() - (F.col("_weights") - F.col("weight"))
    )
    placed = placed.withColumn("_level", level)
    found = placed.where("_level <= _ratio").agg(F.min_by("_level", "nth").alias("level"))
    share = F.coalesce(F.col("weight") * found.scalar(), F.col("_limit"))
    return rows.select(*sources.columns, F.least("_limit", share).alias("target"))


def placed(docs: DataFrame, sources: DataFrame, parts: int) -> DataFrame:
    """``docs`` with ``place`` (running words of the queue), ``source_size`` and ``target``."""
    order = ["draw", "doc_id", "size", "tie", "row"]
    per_key = sources.select("source", "source_size", "target")
    out = ordered(docs, ["source"], order, parts, "queues", totals={"place": "size"}, per_key=per_key)
    return out.drop("nth")


def source_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("size").alias("source_size"))


def mix(queues: DataFrame, budget: int, passes: int = PASSES) -> DataFrame:
    """Entries ``(source, place, pass, doc_id, start, finish, words, upto)`` of the mix.

    ``queues`` is a written table of ``placed``.  An entry gives the first ``words`` words
    of a document; ``place`` is the document's running total in its queue, ``upto`` that of
    the mix in order of ``finish``.
    """
    n_rows = queues.count()
    begin = F.col("pass") * F.col("source_size") + F.col("place") - F.col("size")
    entries = (
        queues.where("size > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
        .withColumn("begin", begin)
        .withColumn("given", F.least(F.col("size"), F.ceil("target") - F.col("begin")))
        .where("given > 0")
        .select(
            "source",
            "place",
            "pass",
            "doc_id",
            (F.col("begin") / F.col("target")).alias("start"),
            ((F.col("begin") + F.col("size")) / F.col("target")).alias("finish"),
            "given",
        )
    )
    order = [F.col("finish"), F.asc_nulls_last("source"), F.col("pass"), F.col("place")]
    merged = ordered(entries, [], order, rank_parts(n_rows), "entries", totals={"upto": "given"})
    words = F.least(F.col("given"), F.lit(budget) - (F.col("upto") - F.col("given")))
    return (
        merged.withColumn("words", words)
        .where("words > 0")
        .select(
            "source",
            "place",
            "pass",
            "doc_id",
            "start",
            "finish",
            "words",
            F.least(F.col("upto"), F.lit(budget)).alias("upto"),
        )
    )


def taken(
    spark: SparkSession,
    documents: DataFrame,
    cycle: tuple[int, ...] = CYCLE,
    share: tuple[int, int] = SHARE,
    passes: int = PASSES,
    **columns: str,
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)`` for every row of ``documents``."""
    docs = materialise(sized(documents, **columns), "words")
    sources = materialise(source_sizes(docs), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = total * share[0] / share[1]
    sources = materialise(with_targets(cyclic_weights(sources, cycle), budget, passes), "targets")
    queues = materialise(placed(docs, sources, rank_parts(docs.count())), "queues")
    entries = mix(queues, int(budget), passes)
    words = entries.groupBy("source", "place").agg(F.sum("words").alias("words"))
    words = words.select(
        F.col("source").alias("_source"), F.col("place").alias("_place"), "words"
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("place") == F.col("_place"))
    found = F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(F.lit(0))
    return queues.join(words, same, "left").select(
        "doc_id", "size", "source", "source_size", "target", found.cast("bigint").alias("taken")
    )
