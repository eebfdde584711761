"""Secret scan over an incremental ledger of blobs.

Every historical version ``(path, text)`` is addressed by the SHA-256 of its content.
The ledger holds one row for each (blob, rule version) pair that was scanned, found
or not.  A scan takes only the pairs the ledger lacks, reads each blob once whatever
the number of its paths, and joins the findings back to all paths.

Null texts are empty texts.  A null path is a path like any other.  Repeated rows are
scanned once and returned as often as they came; an empty table gives an empty result.
Only the named columns of the input are used, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilspark.llm.common import text_or_empty

SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """A pattern; ``least`` is the number of characters that ``group`` must have."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds, then what is added to them.  Letters of the words may have
# either case; written as classes, since engines differ in what ignoring case means.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]"""
        r"""|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
RULES = (*BASE_RULES, Rule("private_key", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"))


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches and the matches themselves alternate, so running
    lengths give the positions.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def step(state: Column, at: Column) -> Column:
        start = state["stop"] + F.element_at(pieces, at)
        stop = start + F.length(F.element_at(found, at))
        span = F.struct(
            start.cast("bigint").alias("start"),
            F.lit(rank).alias("rank"),
            stop.cast("bigint").alias("stop"),
            F.lit(rule.kind).alias("kind"),
        )
        long_enough = F.length(F.element_at(values, at)) >= rule.least
        return F.struct(
            stop.alias("stop"),
            F.when(long_enough, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    nothing = F.array().cast(SPAN)
    spans = F.aggregate(
        F.sequence(F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("stop"), nothing.alias("spans")),
        step,
        lambda state: state["spans"],
    )
    return F.when(text.rlike(rule.pattern), spans).otherwise(nothing)


def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, text, blob)`` of each version."""
    return versions.select(
        F.col(path).alias("path"), text_or_empty(text).alias("text")
    ).withColumn("blob", F.sha2("text", 256))


def scan_unseen(
    versions: DataFrame,
    ledger: DataFrame | None,
    path: str = "path",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """New ledger rows ``(blob, rule, spans)`` for pairs that ``ledger`` lacks.

    Digests and paths decide what is unseen; texts move once, to the one path chosen
    for their blob.  That join is on the path, which has no hot value, and the narrow
    side is the hashed one, so texts are not sorted.
    """
    source = addressed(versions, path, text)
    blobs = source.groupBy("blob").agg(F.min("path").alias("one_path"))
    pairs = blobs.select(
        "blob", "one_path", F.explode(F.array(*[F.lit(r.name) for r in rules])).alias("rule")
    )
    if ledger is not None:
        pairs = pairs.join(ledger.select("blob", "rule"), ["blob", "rule"], "left_anti")
    unseen = pairs.groupBy("blob", "one_path").agg(F.collect_set("rule").alias("todo"))
    unseen = unseen.withColumnRenamed("blob", "unseen_blob").hint("shuffle_hash")
    texts = source.join(
        unseen,
        F.col("path").eqNullSafe(F.col("one_path")) & (F.col("blob") == F.col("unseen_blob")),
    )
    todo = F.col("todo")
    scanned = F.array(
        *[
            F.when(
                F.array_contains(todo, r.name),
                F.struct(
                    F.lit(r.name).alias("rule"),
                    rule_spans(F.col("text"), r, rank).alias("spans"),
                ),
            )
            for rank, r in enumerate(rules)
        ]
    )
    return (
        texts.select("blob", F.explode(scanned).alias("row"))
        .where("row is not null")
        .select("blob", "row.rule", "row.spans")
        .groupBy("blob", "rule")  # the same path and text may come several times
        .agg(F.first("spans").alias("spans"))
    )


def findings(
    versions: DataFrame,
    ledger: DataFrame,
    path: str = "path",
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``(path, blob, spans)`` for every version, spans sorted by start and rule.

    Blobs without findings never enter the join; a blob with very many paths is a
    skewed key of the outer side, which adaptive execution splits.
    """
    wanted = [r.name for r in rules]
    by_blob = (
        ledger.where(F.col("rule").isin(wanted) & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    return (
        addressed(versions, path, text)
        .select("path", "blob")
        .join(by_blob, "blob", "left")
        .select(
            "path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")
        )
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )
