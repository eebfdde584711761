"""Benchmark decontamination by spaced-seed hashing.

A fixed mask looks at some positions of a window of words and ignores the others, so a
window with substituted words at ignored positions still hits.  Hashes of all windows
of the documents meet the hashes of the benchmark items; around a hit the item is laid
along the document and its words are compared one by one.  A document is contaminated
if ``share`` percent of the words agree in some ``stretch`` consecutive words of the item (in the
whole item if it is shorter).

The masks are chosen by a search that ends when every placement of the allowed
substitutions leaves one of them whole, for items of 5, 10, 15 and 20 words and with them
for all longer ones; so no overlap is lost.  Items below 5 words must agree as a whole.

Words are maximal runs of letters and digits in lower case.  Items without words are not
searched.  Of equally good alignments of an item, the first in the document is returned.  Null and empty texts have no words.  Null ids pass through as null.  Rows
that repeat an id are one document with several texts, repeated items are several
items.  An empty table on either side gives an empty result.  Only the named columns
are used.

All of it is DataFrame functions.  Windows leave their text in chunks of bounded size
and as narrow rows; texts move only for documents with hits, after a first look at
their hashed ids.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilspark.llm.common import plain_names
from civilspark.session import materialise

# Weight of the masks and their longest span, by the least words of an item.  Items below
# the first row are looked for as a whole.
CLASSES = {5: (4, 5), 10: (5, 9), 15: (5, 9), 20: (6, 10)}
STRETCH = 20
SHARE = 80
CHUNK = 4096  # windows that are taken apart at once
SLOTS = 1 << 20  # of the hashed ids that texts are looked up in before they are moved
MAX_BROADCAST_SEEDS = 500_000  # narrow rows; more of them are joined by shuffles


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@cache
def masks(words: int, substitutions: int, weight: int, span: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which one fits beside any ``substitutions`` in ``words`` consecutive words.

    Masks look at ``weight`` positions of ``span`` words at most and may lie anywhere in the
    stretch.  The one that catches most of the remaining placements is taken until none is
    left, widest first, so nothing is lost.
    """
    places = [sum(1 << i for i in c) for c in combinations(range(words), substitutions)]
    left = np.array(places, np.int64)
    options = []
    for width in range(span, weight - 1, -1):
        for inner in combinations(range(1, width - 1), weight - 2):
            options.append((0, *inner, width - 1))

    def missed(mask):
        bits = sum(1 << i for i in mask)
        caught = np.zeros(len(left), bool)
        for at in range(words - mask[-1]):
            caught |= (left & (bits << at)) == 0
        return ~caught

    chosen = []
    while len(left):
        best = min(options, key=lambda mask: missed(mask).sum())
        chosen.append(best)
        rest = missed(best)
        if rest.all():
            raise ValueError("no mask of this weight fits")
        left = left[rest]
    return tuple(chosen)


def item_class(n: int, share: int = SHARE) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """Least words of the class of an item of ``n`` words, and the masks of the class.

    A class holds the items that allow as many substitutions as its least one.
    """
    least = max((k for k in CLASSES if k <= n), default=n)
    weight, span = CLASSES.get(least, (n, n))
    allowed = least * (100 - share) // 100
    if least not in CLASSES or weight > least - allowed:
        # All of a short item, or as much as is left of it in one piece.
        weight = max(1, least // (allowed + 1))
        span = weight
    return least, masks(least, allowed, weight, span) if weight > 1 else ((0,),)


def _windows(table: DataFrame, key: str, wanted: dict, of_class: bool) -> DataFrame:
    """``(key, n_words, at, seed)`` of the masks of every class, at every place they fit.

    With ``of_class``, rows have a ``class`` and use its masks only.  Texts leave in chunks
    of ``CHUNK`` places, once for all masks.
    """
    span = 1 + max(mask[-1] for own in wanted.values() for mask in own)
    starts = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(CHUNK)))
    extra = ["class"] if of_class else []
    chunks = table.select(key, "h", *extra, F.explode(starts).alias("begin")).select(
        key,
        *extra,
        F.size("h").alias("n_words"),
        "begin",
        F.least(F.lit(CHUNK), F.size("h") - F.col("begin")).alias("many"),
        F.slice("h", F.col("begin") + 1, CHUNK + span - 1).alias("c"),
    )
    # The shorter columns are filled with nulls, where no mask fits.
    columns = [F.slice("c", F.lit(p + 1), F.col("many")).alias(f"w{p}") for p in range(span)]
    rows = chunks.select(key, *extra, "n_words", "begin", F.posexplode(F.arrays_zip(*columns)))

    def seed(least: int, number: int, mask: tuple[int, ...]) -> Column:
        fits = F.col("col")[f"w{mask[-1]}"].isNotNull()
        if of_class:
            fits &= F.col("class") == least
        own = [F.col("col")[f"w{p}"] for p in mask]
        return F.when(fits, F.xxhash64(F.lit(least), F.lit(number), *own))

    seeds = F.array(
        *[seed(least, k, mask) for least, own in wanted.items() for k, mask in enumerate(own)]
    )
    rows = rows.select(
        key, "n_words", (F.col("begin") + F.col("pos")).alias("at"), F.explode(seeds).alias("seed")
    )
    return rows.where("seed is not null")


def _hashed(table: DataFrame, key: str, text: str, name: str) -> DataFrame:
    rows = table.select(F.col(key).alias(name), words(F.col(text)).alias("w"))
    return rows.select(name, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    stretch: int = STRETCH,
    share: int = SHARE,
) -> DataFrame:
    """``(doc_id, item_id, doc_start, n_words, n_equal, best, length)`` of each overlap.

    ``doc_start`` is the word position where the item begins (negative if its begin is
    missing), ``n_equal`` of its ``n_words`` words agree, ``best`` of the best
    ``length`` consecutive ones.  The best alignment of each item is returned.
    """
    known = _hashed(items, item_id, item_text, "item_id").where(F.size("h") > 0)
    known = known.withColumnRenamed("h", "item")
    texts = _hashed(docs, doc_id, text, "doc_id")
    sizes = known.select(F.least(F.size("item"), F.lit(max(CLASSES))).alias("n")).distinct()
    found_classes = {r.n: item_class(r.n, share) for r in sizes.collect()}  # 20 sizes at most
    wanted = {least: own for least, own in sorted(found_classes.values())}
    hits = None
    if wanted:
        least = F.create_map(*[F.lit(x) for n, (k, _) in found_classes.items() for x in (n, k)])
        size = F.least(F.size("item"), F.lit(max(CLASSES)))
        same = known.select("item_id", F.col("item").alias("h"), least[size].alias("class"))
        seeds = _windows(same, "item_id", wanted, True)
        seeds = seeds.withColumnRenamed("at", "item_at").withColumnRenamed("seed", "item_seed")
        if seeds.limit(MAX_BROADCAST_SEEDS + 1).count() <= MAX_BROADCAST_SEEDS:
            seeds = F.broadcast(seeds)
        hits = (
            _windows(texts, "doc_id", wanted, False)
            .drop("n_words")
            .join(seeds, F.col("seed") == F.col("item_seed"))
            .select(
                "doc_id", "item_id", "n_words", (F.col("at") - F.col("item_at")).alias("doc_start")
            )
            .distinct()
        )
    if hits is None:
        return docs.select(F.col(doc_id).alias("doc_id")).where(F.lit(False)).select(
            "doc_id",
            F.lit(None).cast(items.schema[item_id].dataType).alias("item_id"),
            *[F.lit(None).cast("int").alias(c) for c in ("doc_start", "n_words", "n_equal", "best", "length")],
        )
    hits = materialise(hits, "hits")
    by_doc = hits.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set(F.struct("item_id", "n_words", "doc_start")).alias("hits")
    )
    slot = lambda column: F.pmod(F.xxhash64(column), F.lit(SLOTS))
    slots = hits.select(slot("doc_id").alias("_slot")).distinct()  # SLOTS rows at most
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(slots), slot("doc_id") == F.col("_slot"), "left_semi")
    rows = rows.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")))
    rows = rows.select("doc_id", "hits", words(F.col("text")).alias("w")).select(
        "doc_id", "hits", F.transform("w", lambda w: F.xxhash64(w)).alias("h")
    )

    def beside(hit: Column) -> Column:
        """The part of the document that lies beside the item."""
        first = F.greatest(hit["doc_start"], F.lit(0))
        missing = first - hit["doc_start"]
        return F.struct(
            hit["item_id"].alias("item_id"),
            hit["doc_start"].alias("doc_start"),
            missing.alias("missing"),
            F.slice("h", first + 1, F.greatest(hit["n_words"] - missing, F.lit(0))).alias("part"),
        )

    laid = rows.select("doc_id", F.inline(F.transform("hits", beside)))
    items_there = known.withColumnRenamed("item_id", "_item_id")
    laid = laid.join(items_there, F.col("item_id").eqNullSafe(F.col("_item_id")))
    agree = F.transform(
        "item",
        lambda word, k: F.when(F.get(F.col("part"), k - F.col("missing")) == word, 1).otherwise(0),
    )
    laid = laid.select(
        "doc_id", "item_id", "doc_start", F.size("item").alias("n_words"), agree.alias("agree")
    )
    total = lambda flags: F.aggregate(flags, F.lit(0), lambda a, b: a + b)
    length = F.least(F.col("n_words"), F.lit(stretch))
    stretches = F.transform(
        F.sequence(F.lit(1), F.col("n_words") - length + 1),
        lambda at: total(F.slice("agree", at, length)),
    )
    judged = laid.select(
        "doc_id",
        "item_id",
        "doc_start",
        "n_words",
        total(F.col("agree")).alias("n_equal"),
        F.array_max(stretches).alias("best"),
        length.alias("length"),
    ).where(F.col("best") * 100 >= F.col("length") * share)
    best = F.max(F.struct("best", "n_equal", (-F.col("doc_start")).alias("back"), "doc_start", "n_words", "length"))
    return judged.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.doc_start", "b.n_words", "b.n_equal", "b.best", "b.length"
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows without id stay."""
    found = overlaps(docs, items, doc_id=doc_id, **options).select(F.col("doc_id").alias("_id"))
    found = found.distinct().hint("shuffle_hash")
    plain, name = plain_names(docs)
    kept = plain.join(found, F.col(name[doc_id]) == F.col("_id"), "left_anti")
    return kept.toDF(*docs.columns)
