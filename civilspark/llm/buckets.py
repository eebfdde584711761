"""Packing into optimal length buckets.

The global histogram of lengths goes through a dynamic programme that chooses at most
``buckets`` boundaries with the least total padding.  Inside a bucket, documents form
batches of ``budget`` tokens, padding included.  Only the histogram comes to the
driver; its number of distinct lengths D is bounded by sqrt(2 * total tokens).

Null and empty texts have no tokens and are padded like any other row.  A document
above the budget is a batch of its own.  Null ids and repeated rows are rows like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.llm.common import WORD, gapless_rank, rank_parts, text_or_empty
from civilspark.session import materialise


def word_count(text: Column) -> Column:
    """Number of words between ASCII whitespace."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Bucket ends with the least padding for ``(length, count)`` pairs.

    A bucket that ends at length L and starts after the i-th length pads
    L * (count so far - count up to i) - (tokens so far - tokens up to i).  For a
    fixed number of buckets the best i is the lowest of lines in L, kept as a convex
    hull, so each round over the lengths is linear.  Integers keep it exact.
    """
    lengths = sorted(histogram)
    n = len(lengths)
    if not n:
        return []
    count, tokens = [0], [0]
    for length, many in lengths:
        count.append(count[-1] + many)
        tokens.append(tokens[-1] + length * many)
    best = [lengths[j][0] * count[j + 1] - tokens[j + 1] for j in range(n)]
    best = [0, *best]  # best[j]: padding of the first j lengths in one bucket
    froms = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        now, origin = best[:], [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i), slopes fall
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            line = (-count[i], best[i] + tokens[i], i)
            while len(hull) - head >= 2 and _useless(hull[-2], hull[-1], line):
                hull.pop()
            hull.append(line)
            head = min(head, len(hull) - 1)
            length = lengths[j - 1][0]
            while head + 1 < len(hull) and _at(hull[head + 1], length) <= _at(hull[head], length):
                head += 1
            value = _at(hull[head], length) + length * count[j] - tokens[j]
            if value < now[j]:
                now[j], origin[j] = value, hull[head][2]
            else:
                origin[j] = -1  # as with one bucket fewer
        froms.append(origin)
        best = now
    ends, j, k = [], n, len(froms) - 1
    while j > 0:
        while k > 0 and froms[k][j] == -1:
            k -= 1
        ends.append(lengths[j - 1][0])
        j = froms[k][j] if k > 0 else 0
        k -= 1
    return ends[::-1]


def _at(line: tuple[int, int, int], x: int) -> int:
    return line[0] * x + line[1]


def _useless(a, b, c) -> bool:
    """Whether line b lies nowhere below both a and c; slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def padding(histogram: list[tuple[int, int]], ends: list[int]) -> int:
    """Padded tokens when every length goes up to the next bucket end."""
    total, at = 0, 0
    for length, many in sorted(histogram):
        while ends[at] < length:
            at += 1
        total += (ends[at] - length) * many
    return total


def pack(
    spark: SparkSession,
    docs: DataFrame,
    buckets: int = 16,
    budget: int = 65_536,
    doc_id: str = "doc_id",
    text: str = "text",
    length=word_count,
) -> DataFrame:
    """``(doc_id, n_tokens, bucket, padded_to, batch, slot)`` for every row.

    ``length`` turns the text column into a token count.  ``batch`` numbers the
    batches of a bucket, ``slot`` the rows of a batch.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), length(text_or_empty(text)).alias("n_tokens")
    )
    rows = materialise(rows, "lengths")
    counts = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = [(int(r.n_tokens), int(r.n)) for r in counts]
    ends = boundaries(histogram, buckets)
    if not ends:
        ends = [0]
    # One literal expression: the first end that is not below the length.
    known = F.array(*[F.lit(e).cast("bigint") for e in ends])
    bucket = F.size(F.filter(known, lambda e: e < F.col("n_tokens")))
    dealt = rows.withColumn("bucket", bucket).withColumn(
        "padded_to", F.element_at(known, F.col("bucket") + 1)
    )
    parts = rank_parts(sum(n for _, n in histogram))
    ranked = gapless_rank(dealt, ["bucket"], ["doc_id", "n_tokens"], parts, "nth")
    per_batch = F.greatest(
        F.lit(1).cast("bigint"),
        F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1))),
    )
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_to",
        F.floor(F.col("nth") / per_batch).alias("batch"),
        (F.col("nth") % per_batch).alias("slot"),
    )
