"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles.  Under one global order of the
shingles, two sets of similarity t share at least l tokens of their prefixes when each
prefix has n - ceil(t * n) + l tokens.  A longer prefix costs more postings, but asks
for more shared tokens before a pair is verified; every document takes the l that is
cheapest by the posting lengths of its own tokens.  A pair of an l and an m document
needs min(l, m) shared tokens, and enough of them that the rest can still make up the
overlap that the similarity asks for.

What keeps large groups of copies from becoming all pairs:

* equal sets are one node, their documents are members of it;
* each token's documents are first compared with one of them only; pairs that share
  many tokens are verified and joined to components;
* what is left of contested tokens is compared by difference: near documents are laid
  beside a central one, as a family, and only those that differ from it in the same
  tokens, of which a link needs a number, are paired, asked for their shared prefix
  tokens, and verified.  Near copies that miss the similarity narrowly share nearly all
  of their tokens but few of their differences, so they seldom meet;
* documents of different families are first judged by how far the centres of both families
  are apart: two documents cannot be nearer than that less their distances from their own
  centres, so most members of a large family meet none of the other families;
* the others are counted against the other family as a whole, the smaller one first; only
  those that share enough with it are taken apart into pairs.

No link between components is lost, since no two documents of different components
skip the comparison.  The global order comes from a sketch of shingle frequencies of a
fixed size, so frequent shingles stand last.  Any order gives the same result.

Texts without words are empty, have no shingles and link with nothing.  A null id
links with nothing.  Rows that repeat an id are one document with several texts.  An
empty table gives an empty result.  Only the named columns are used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civilspark.llm.common import components, shingle_set
from civilspark.session import materialise

SKETCH_BITS = 20
SKETCH_CHUNKS = 16
SKETCH_FANIN = 64
LONGEST = 4  # largest number of prefix tokens asked for
VERIFY_SHARE = 1 / 16  # cost of verifying one shingle, in postings
STAR_ROUNDS = 1
SLICE = 1000  # rows of a batch whose shingles are held at once
BATCH = 250  # rows whose texts go to a worker at once
SLOTS = 1 << 20  # of the hashed ids that texts are looked up in before they are moved


def _slices(batches, rows: int = SLICE):
    """Few rows at a time, so that a worker never holds the shingles of a whole batch."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """A row ``(doc_id, n, sig)`` per text; sketch rows ``(part, counts)`` per task."""
    buckets = 1 << SKETCH_BITS

    def profile(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in _slices(batches):
            sizes, sigs, pending = [], [], []
            for text in batch["text"]:
                tokens = shingle_set(text, width)
                sizes.append(len(tokens))
                sigs.append(hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest())
                pending.append(tokens)
            all_tokens = np.concatenate(pending) if pending else np.empty(0, np.int64)
            counts += np.bincount(all_tokens & (buckets - 1), minlength=buckets)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n": sizes, "sig": sigs, "part": -1, "counts": None}
            )
        for part, chunk in enumerate(np.split(counts, SKETCH_CHUNKS)):
            if chunk.any():
                row = {"doc_id": [None], "n": [0], "sig": [None], "part": [part]}
                yield pd.DataFrame(row | {"counts": [chunk.tobytes()]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, sig binary, part int, counts binary"
    return docs.mapInPandas(profile, schema)


def _sketch(profile: DataFrame) -> np.ndarray:
    """Sum of all tasks' sketches, added up in two levels."""
    chunk = (1 << SKETCH_BITS) // SKETCH_CHUNKS

    def add(key, group):
        total = np.zeros(chunk, np.int64)
        for data in group["counts"]:
            total += np.frombuffer(data, np.int64)
        return pd.DataFrame({"part": [int(key[0])], "counts": [total.tobytes()]})

    rows = profile.where("part >= 0").select("part", "counts")
    rows = rows.withColumn("some", F.spark_partition_id() % SKETCH_FANIN)
    schema = "part int, counts binary"
    once = rows.groupBy("part", "some").applyInPandas(add, schema)
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in once.groupBy("part").applyInPandas(add, schema).collect():
        sketch[row.part * chunk : (row.part + 1) * chunk] = np.frombuffer(row.counts, np.int64)
    return sketch


def _prefixes(docs: DataFrame, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """``(doc_id, sig, n, prefix)``: the longest prefix that may be asked for, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    mask = (1 << SKETCH_BITS) - 1

    def prefixes(batches):
        order = shared.value
        for batch in _slices(batches):
            ids, sigs, sizes, out = [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                tokens = shingle_set(text, width)
                n = len(tokens)
                if not n:
                    continue
                need = -(-percent * n // 100)
                take = n - need + min(LONGEST, need)
                ranked = np.lexsort((tokens, order[tokens & mask]))[:take]
                ids.append(doc_id)
                sigs.append(hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest())
                sizes.append(n)
                out.append(tokens[ranked])
            yield pd.DataFrame({"doc_id": ids, "sig": sigs, "n": sizes, "prefix": out})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(
        prefixes, f"doc_id {kind}, sig binary, n bigint, prefix array<bigint>"
    )


def _need(n: Column, percent: int) -> Column:
    """ceil(t * n)"""
    return F.floor((n * percent + 99) / 100)


def _need_as_shorter(n: Column, percent: int) -> Column:
    """Least overlap of a set of n tokens with a similar one that is not smaller."""
    return F.ceil(2 * n * percent / F.lit(100 + percent))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of two sets of n and m tokens with the similarity."""
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def _adapted(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of the cheapest prefix of each document, with ``ell``.

    Filtering costs the postings that share a token; at most a 1/l of them are pairs
    that share l tokens, and each of those costs a verification.
    """
    base = F.col("n") - _need(F.col("n"), percent)
    costs = []
    for ell in range(1, LONGEST + 1):
        reach = F.sum(F.when(F.col("pos") < base + ell, F.col("df") - 1).otherwise(0))
        costs.append(reach.alias(f"reach_{ell}"))
    chosen = postings.groupBy("doc", "n").agg(*costs)
    options = F.array(
        *[
            F.when(
                F.lit(ell) <= _need(F.col("n"), percent),
                F.struct(
                    (F.col(f"reach_{ell}") * (1 + F.col("n") * VERIFY_SHARE / ell)).alias("cost"),
                    F.lit(ell).alias("ell"),
                ),
            )
            for ell in range(1, LONGEST + 1)
        ]
    )
    chosen = chosen.select(
        F.col("doc").alias("_doc"), F.col("n").alias("_n"), F.array_min(options)["ell"].alias("ell")
    )
    same = (F.col("doc") == F.col("_doc")) & (F.col("n") == F.col("_n"))
    return postings.join(chosen, same).where(F.col("pos") < base + F.col("ell")).select(
        "token", "doc", "n", "ell", "pos"
    )


def _promising(x: str, y: str, shared: Column, percent: int) -> Column:
    """Whether two documents with ``shared`` prefix tokens can be similar.

    All common tokens up to the end of the prefix that ends first are counted; the
    others lie behind that prefix.
    """
    nx, ny, lx, ly = (F.col(c) for c in (f"n_{x}", f"n_{y}", f"ell_{x}", f"ell_{y}"))
    behind = F.greatest(_need(nx, percent) - lx, _need(ny, percent) - ly)
    return (
        (shared >= F.least(lx, ly))
        & (shared + behind >= _overlap(nx, ny, percent))
        & (nx * 100 >= ny * percent)
        & (ny * 100 >= nx * percent)
    )


def _token_sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(doc, sig, tokens)`` of the wanted ``doc``, written."""
    wanted = wanted.select(F.col("doc").alias("_doc")).distinct()
    # Hashed ids, SLOTS rows at most, keep most other texts from being moved.
    slot = lambda column: F.pmod(F.xxhash64(column), F.lit(SLOTS))
    slots = wanted.select(slot("_doc").alias("_slot")).distinct()
    texts = docs.join(F.broadcast(slots), slot("doc_id") == F.col("_slot"), "left_semi").join(
        wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("_doc"), "left_semi"
    )

    def sets(batches):
        for batch in _slices(batches):
            tokens = [shingle_set(text, width) for text in batch["text"]]
            sigs = [hashlib.md5(t.tobytes(), usedforsecurity=False).digest() for t in tokens]
            yield pd.DataFrame({"doc": batch["doc_id"], "sig": sigs, "tokens": tokens})

    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = texts.mapInPandas(sets, f"doc {kind}, sig binary, tokens array<bigint>").distinct()
    return materialise(tokens, "sets", BATCH)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(x, y, ...)`` with ``tokens_x`` and ``tokens_y``."""
    one = sets.select(F.col("doc").alias("x"), F.col("tokens").alias("tokens_x"))
    two = sets.select(F.col("doc").alias("y"), F.col("tokens").alias("tokens_y"))
    return pairs.join(one, "x").join(two, "y")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``(x, y)`` whose whole sets have the similarity."""
    ends = pairs.select(F.col("x").alias("doc")).union(pairs.select("y"))
    both = F.size(F.array_intersect("tokens_x", "tokens_y"))
    either = F.size("tokens_x") + F.size("tokens_y") - both
    return (
        _with_sets(pairs, _token_sets(ends, docs, width))
        .where((both > 0) & (both * 100 >= either * percent))
        .select("x", "y")
    )


def _star_pairs(active: DataFrame, percent: int, seed: int) -> DataFrame:
    """Each token's documents against one of them, where much of a prefix is shared."""
    drawn = F.xxhash64("doc", F.lit(seed)) if seed else F.lit(0).cast("bigint")
    one = F.struct(drawn.alias("drawn"), "doc", "n", "ell", "comp")
    pivots = active.groupBy("token").agg(F.min(one).alias("p"))
    pairs = (
        active.join(pivots, "token")
        .where("comp <> p.comp")
        .select(
            F.col("p.doc").alias("x"),
            F.col("doc").alias("y"),
            F.col("p.n").alias("n_x"),
            F.col("n").alias("n_y"),
            F.col("p.ell").alias("ell_x"),
            F.col("ell").alias("ell_y"),
        )
        .groupBy("x", "y", "n_x", "n_y", "ell_x", "ell_y")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    # Tokens with another pivot are not counted here: half of what is needed will do.
    pairs = pairs.where(_promising("x", "y", F.col("shared") * 2, percent))
    return pairs.select("x", "y").distinct()


def _contested(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Postings with components, of the tokens that several components share."""
    placed = postings.join(
        found.select(F.col("node").alias("doc"), "component"), "doc", "left"
    ).withColumn("comp", F.coalesce("component", "doc"))
    spread = placed.groupBy("token").agg(
        F.min("comp").alias("least"), F.max("comp").alias("most")
    )
    spread = spread.where("least < most").select("token")
    return materialise(placed.drop("component").join(spread, "token"), "contested")


def _families(active: DataFrame, percent: int) -> DataFrame:
    """``(x, y)``: documents ``y`` that may be near the central document ``x`` of a token.

    Central is who has the fewest tokens that nobody shares, for the size of its prefix:
    among near copies, one with few changes, the same for nearly all of their tokens.
    A document goes with the one that it shares most tokens with, if these are half of
    what a link needs.  The family is a matter of cost; any choice gives the same links.
    """
    shared = F.count(F.lit(1)) / F.col("n")
    alone = active.groupBy("doc", "n").agg((-shared).alias("alone")).drop("n")
    alone = alone.groupBy(F.col("doc").alias("_doc")).agg(F.min("alone").alias("alone"))
    placed = active.join(alone, F.col("doc") == F.col("_doc"))
    one = F.struct("alone", "doc", "n", "ell")
    pivots = placed.groupBy("token").agg(F.min(one).alias("p"))
    pairs = active.join(pivots, "token").select(
        F.col("p.doc").alias("x"),
        F.col("doc").alias("y"),
        F.col("p.n").alias("n_x"),
        F.col("n").alias("n_y"),
        F.col("p.ell").alias("ell_x"),
        F.col("ell").alias("ell_y"),
    )
    pairs = pairs.groupBy("x", "y", "n_x", "n_y", "ell_x", "ell_y").agg(
        F.count(F.lit(1)).alias("shared")
    )
    pairs = pairs.where(_promising("x", "y", F.col("shared") * 2, percent))
    best = F.max(F.struct("shared", F.col("x") == F.col("y"), "x")).alias("b")
    return pairs.groupBy("y").agg(best).select(F.col("b.x").alias("x"), "y")


def _differences(families: DataFrame, percent: int) -> DataFrame:
    """``(pivot, doc, node, n, tokens)`` of near members: what only one of both has.

    ``pivot`` and ``node`` are digests of the sets, since an id may have several texts.
    """

    def differences(batches):
        for batch in _slices(batches):
            rows = []
            for doc, old, new in zip(batch["y"], batch["tokens_x"], batch["tokens_y"]):
                tokens = np.setxor1d(old, new, assume_unique=True)
                if len(tokens) * (100 + percent) > 2 * (len(old) + len(new)) * (100 - percent):
                    continue  # not near
                rows.append((digest(old), doc, digest(new), len(new), tokens))
            yield pd.DataFrame(rows, columns=["pivot", "doc", "node", "n", "tokens"])

    def digest(tokens):
        return hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest()

    kind = families.schema["x"].dataType.simpleString()
    return families.select("y", "tokens_x", "tokens_y").mapInPandas(
        differences,
        f"pivot binary, doc {kind}, node binary, n bigint, tokens array<bigint>",
    )


def _deltas(rows: DataFrame, percent: int) -> DataFrame:
    """How each member of a family differs from its centre, as far as links depend on it.

    The centre is the pivot with all tokens changed in which most members differ from
    it; it need not be a document.  D(y) has the tokens that only one of y and the centre
    has.  Members y and z differ in |D(y)| + |D(z)| - 2 |D(y) & D(z)| tokens, and link if
    that is at most c = (100 - percent) / (100 + percent) of the sum of their sizes.

    The hub m has the least score |D| - c * n.  ``linked`` says who links with it.  Members
    that both do are in one component.  If z does not, |D(z)| > c * (n(z) + n(m)) - |D(m)|,
    so a link needs |D(y) & D(z)| > (score(y) - score(m)) / 2, which is 0 at least; and
    |D(z)| - c * (n(y) + n(z)) at least.  Hence any y has a token of the link among its
    first ``as_y`` in any common order of the tokens, and z among its first ``as_x``.
    """
    many = rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("many"))
    common = rows.select("pivot", F.explode("tokens").alias("token")).groupBy("pivot", "token")
    common = common.agg(F.count(F.lit(1)).alias("df")).join(many, "pivot")
    common = common.where(F.col("df") * 2 > F.col("many")).groupBy("pivot")
    common = materialise(common.agg(F.collect_list("token").alias("changed")), "centres")
    changed = F.coalesce("changed", F.array().cast("array<bigint>"))
    moved = F.concat(F.array_except("tokens", changed), F.array_except(changed, "tokens"))
    score = F.col("size") * (100 + percent) - F.col("n") * (100 - percent)
    rows = rows.join(common, "pivot", "left").select("pivot", "doc", "node", "n", moved.alias("tokens"))
    rows = rows.withColumn("size", F.size("tokens").cast("bigint")).withColumn("score", score)
    rows = materialise(rows, "centred")
    hubs = rows.groupBy("pivot").agg(F.min(F.struct("score", "node", "doc")).alias("h"))
    hubs = hubs.select(F.col("pivot").alias("_pivot"), F.col("h.doc").alias("hub"), F.col("h.node").alias("_node"))
    same = (F.col("pivot") == F.col("_pivot")) & (F.col("doc") == F.col("hub")) & (F.col("node") == F.col("_node"))
    hubs = rows.join(hubs, same).select(
        "pivot", "hub", *[F.col(c).alias(f"hub_{c}") for c in ("n", "size", "score", "tokens")]
    )
    rows = rows.join(materialise(hubs, "hubs"), "pivot")
    apart = F.col("size") + F.col("hub_size") - 2 * F.size(F.array_intersect("tokens", "hub_tokens"))
    total = F.col("n") + F.col("hub_n")
    linked = (apart < total) & (apart * (100 + percent) <= total * (100 - percent))
    most = F.floor(F.col("n") * (100 - percent) / F.lit(percent))
    as_x = F.col("size") - F.greatest(F.lit(1), F.col("size") - most) + 1
    ahead = F.floor((F.col("score") - F.col("hub_score")) / F.lit(2 * (100 + percent)))
    return rows.select(
        "pivot",
        "doc",
        "node",
        "n",
        "size",
        "hub",
        linked.alias("linked"),
        F.when(linked, F.lit(0)).otherwise(as_x).cast("bigint").alias("as_x"),
        (F.col("size") - ahead).cast("bigint").alias("as_y"),
        "tokens",
    )


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows(doc, ...)`` with their component, ``comp``."""
    comps = found.select(F.col("node").alias("_doc"), "component")
    return rows.join(comps, F.col("doc") == F.col("_doc"), "left").withColumn(
        "comp", F.coalesce("component", "doc")
    ).drop("_doc", "component")


def _delta_pairs(deltas: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(x, y)`` of members in different components that share differing tokens.

    Tokens stand in order of their number in the family; those of one member come first
    and need no row.
    """
    of = ["pivot", "token"]
    rows = deltas.select(
        "pivot", "doc", "node", "n", "size", "comp", "as_x", "as_y",
        F.explode("tokens").alias("token"),
    )
    rows = materialise(rows, "differing")
    counted = rows.groupBy(*of).agg(
        F.count(F.lit(1)).alias("df"), F.min("comp").alias("least"), F.max("comp").alias("most")
    )
    shared = rows.join(counted.where("df > 1"), of)
    in_order = Window.partitionBy("pivot", "doc", "node").orderBy("df", "token")
    everywhere = Window.partitionBy("pivot", "doc", "node")
    own = F.col("size") - F.count(F.lit(1)).over(everywhere)
    rows = shared.withColumn("pos", own + F.row_number().over(in_order) - 1).where(
        (F.col("least") < F.col("most")) & (F.col("pos") < F.greatest("as_x", "as_y"))
    )
    rows = materialise(rows, "deltas")

    def side(name: str) -> DataFrame:
        own = rows.where(F.col("pos") < F.col(f"as_{name}"))
        columns = [F.col(c).alias(f"{c}_{name}") for c in ("n", "size", "comp")]
        return own.select(*of, F.col("doc").alias(name), *columns)

    total, apart = F.col("n_x") + F.col("n_y"), F.abs(F.col("size_x") - F.col("size_y"))
    return (
        side("x")
        .join(side("y"), of)
        .where("comp_x <> comp_y")
        .where(F.col("n_x") * 100 >= F.col("n_y") * percent)
        .where(F.col("n_y") * 100 >= F.col("n_x") * percent)
        .where(apart * (100 + percent) <= total * (100 - percent))
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )


def _with_enough_shared(pairs: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Pairs that share as many prefix tokens as their prefixes ask for."""
    lists = postings.groupBy("doc", "n", "ell").agg(F.collect_set("token").alias("prefix"))

    def side(name: str) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{name}") for c in ("n", "ell", "prefix")]
        return lists.select(F.col("doc").alias(name), *columns)

    shared = F.size(F.array_intersect("prefix_x", "prefix_y"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    return both.where(_promising("x", "y", shared, percent)).select("x", "y").distinct()


def _apart(pairs: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """``pairs(family_x, family_y)`` with ``apart``, how far the centres are from each other.

    Two sets link if they differ in at most (100 - percent) / (100 + percent) of the sum of
    their sizes.  Sets that are ``off`` their centres by so many tokens differ in at least
    the distance of the centres less both, so a link needs ``apart``, which is 100 + percent
    times that distance, to be within the sum of both ``reach`` (see ``_reach``).  Families
    with several centres count with the nearest, those without one as not apart.
    """

    def side(name: str) -> DataFrame:
        return centres.select(F.col("family").alias(f"family_{name}"), F.col("tokens").alias(f"tokens_{name}"))

    key = ["family_x", "family_y"]
    both = pairs.select(*key).join(side("x"), "family_x").join(side("y"), "family_y")
    shared = F.size(F.array_intersect("tokens_x", "tokens_y"))
    differing = (F.size("tokens_x") + F.size("tokens_y") - 2 * shared).cast("bigint")
    nearest = both.groupBy(*key).agg((F.min(differing) * (100 + percent)).alias("apart"))
    return pairs.join(nearest, key, "left").withColumn("apart", F.coalesce("apart", F.lit(0)))


def _reach(off: Column, n: Column, percent: int) -> Column:
    """How much of ``apart`` a set of n tokens that is ``off`` its centre may make up."""
    return off * (100 + percent) + n * (100 - percent)


def _centres(pairs: DataFrame, placed: DataFrame, near: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``(family, tokens)`` of the families in ``pairs``: the pivot's set, or a lone document's."""
    wanted = pairs.select(F.col("family_x").alias("family")).union(pairs.select("family_y")).distinct()
    pivots = near.select(F.hex("sig").alias("family"), "tokens").join(wanted, "family", "left_semi")
    alone = placed.where("off is null").select("family", "doc").distinct()
    alone = materialise(alone.join(wanted, "family", "left_semi"), "lone")
    own = _token_sets(alone, docs, width).join(alone, "doc").select("family", "tokens")
    return pivots.dropDuplicates(["family"]).union(own)


def _cross_pairs(
    placed: DataFrame, near: DataFrame, docs: DataFrame, width: int, percent: int
) -> DataFrame:
    """Promising pairs of documents in different families and components.

    ``near`` has the sets of the families' pivots; ``placed`` tells in ``off`` in how many
    tokens a document differs from its pivot, null for families of one document.
    """
    off = F.coalesce("off", F.lit(0)).cast("bigint")
    placed = placed.withColumn("reach", _reach(off, F.col("n"), percent))
    # A family whose members are all linked needs no comparison with its own component.
    inside = placed.groupBy("family").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    whole = F.when(F.col("least") == F.col("most"), F.col("least")).alias("whole")
    whole = inside.select(F.col("family").alias("_family"), whole)
    placed = placed.join(whole, F.col("family") == F.col("_family")).drop("_family")
    sides = {}
    shorter = F.col("pos") < F.col("n") - _need_as_shorter(F.col("n"), percent) + F.col("ell")
    for name, rows in (("x", placed.where(shorter)), ("y", placed)):
        sides[name] = rows.groupBy("token", F.col("family").alias(f"family_{name}")).agg(
            F.min("n").alias(f"least_{name}"),
            F.max("n").alias(f"most_{name}"),
            F.min("ell").alias(f"ell_{name}"),
            F.max("whole").alias(f"whole_{name}"),
        )
    apart = F.col("whole_x").isNull() | F.col("whole_y").isNull() | (F.col("whole_x") != F.col("whole_y"))
    lx, ly, mx, my = (F.col(c) for c in ("least_x", "least_y", "most_x", "most_y"))
    in_order = (lx < my) | ((lx == my) & (F.col("family_x") < F.col("family_y")))
    behind = F.greatest(
        _need_as_shorter(mx, percent) - F.col("ell_x"), _need(my, percent) - F.col("ell_y")
    )
    pairs = (
        sides["x"]
        .join(sides["y"], "token")
        .where((F.col("family_x") != F.col("family_y")) & in_order & apart)
        .where((mx * 100 >= ly * percent) & (my * 100 >= lx * percent))
        .groupBy("family_x", "family_y")
        .agg(
            F.count(F.lit(1)).alias("shared"),
            *[F.min(c).alias(c) for c in ("least_x", "least_y", "ell_x", "ell_y")],
            *[F.max(c).alias(c) for c in ("most_x", "most_y")],
        )
        .where(
            (F.col("shared") >= F.least("ell_x", "ell_y"))
            & (F.col("shared") + behind >= _overlap(lx, ly, percent))
        )
        .select(
            F.least("family_x", "family_y").alias("family_x"),
            F.greatest("family_x", "family_y").alias("family_y"),
        )
        .distinct()
    )
    sizes = placed.groupBy("family").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.min("ell").alias("ell"),
        F.max("reach").alias("far"),
    )

    def of_family(name: str) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{name}") for c in ("rows", "least", "most", "ell", "far")]
        return sizes.select(F.col("family").alias(f"family_{name}"), *columns)

    # The smaller family of a pair is x, and is asked first.
    pairs = pairs.join(of_family("x"), "family_x").join(of_family("y"), "family_y")
    turned = F.col("rows_x") > F.col("rows_y")
    names = [(f"{c}_x", f"{c}_y") for c in ("family", "least", "most", "ell", "far")]
    straight = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in names]
    crossed = [F.when(turned, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in names]
    pairs = materialise(pairs.select(*straight, *crossed), "family-pairs")
    pairs = _apart(pairs, _centres(pairs, placed, near, docs, width), percent)
    pairs = materialise(pairs.where(F.col("apart") <= F.col("far_x") + F.col("far_y")), "near-families")

    def members(name: str, other: str, pairs: DataFrame) -> DataFrame:
        """Documents that reach far enough for one of the pairs of their family."""
        family = F.col(f"family_{name}").alias("_family")
        least = pairs.groupBy(family).agg(F.min(F.col("apart") - F.col(f"far_{other}")).alias("_least"))
        own = placed.join(least, F.col("family") == F.col("_family")).where("reach >= _least")
        return own.select(
            "token",
            F.col("family").alias(f"family_{name}"),
            F.col("comp").alias(f"comp_{name}"),
            F.col("doc").alias(name),
            F.col("n").alias(f"n_{name}"),
            F.col("ell").alias(f"own_{name}"),
            F.col("reach").alias(f"reach_{name}"),
        )

    def asked(pairs: DataFrame, own: str, other: str) -> DataFrame:
        """``(pair, token, member)`` of members that share enough tokens with the other family.

        Tokens are counted in the family as a whole, so the rows are the member's tokens
        and not pairs; what a link with any size that the family has would need is asked.
        """
        theirs = placed.select("token", F.col("family").alias(f"family_{other}")).distinct()
        if own == "x":  # from the smaller family on
            rows = pairs.join(members("x", "y", pairs), "family_x").join(theirs, ["token", "family_y"])
        else:
            rows = pairs.join(theirs, "family_x").join(members("y", "x", pairs), ["family_y", "token"])
        rows = rows.where(F.col("apart") <= F.col(f"reach_{own}") + F.col(f"far_{other}"))
        n, ell = F.col(f"n_{own}"), F.col(f"own_{own}")
        low = F.greatest(F.col(f"least_{other}"), F.ceil(n * percent / F.lit(100)))
        high = F.least(F.col(f"most_{other}"), F.floor(n * 100 / F.lit(percent)))
        behind = F.greatest(_need(n, percent) - ell, _need(high, percent) - F.col(f"ell_{other}"))
        key = ["family_x", "family_y", own, f"n_{own}", f"own_{own}"]
        counted = rows.groupBy(*key, "least_x", "most_x", "least_y", "most_y", "ell_x", "ell_y").agg(
            F.count(F.lit(1)).alias("shared")
        )
        enough = (low <= high) & (F.col("shared") >= F.least(ell, F.col(f"ell_{other}")))
        enough &= F.col("shared") + behind >= _overlap(n, low, percent)
        kept = counted.where(enough).select(*key)
        return materialise(rows.join(kept, key, "left_semi"), f"asked-{own}")

    asked_x = asked(pairs, "x", "y")
    # From here on, the family on the first side is what has been left of it.
    of = ["family_x", "family_y"]
    left = asked_x.groupBy(*of).agg(F.max("reach_x").alias("far_x"))
    left = pairs.drop("far_x").join(left, of).where(F.col("apart") <= F.col("far_x") + F.col("far_y"))
    asked_y = asked(left, "y", "x")
    key = ["family_x", "family_y", "token"]
    taken = asked_x.select(*key, "apart", "x", "comp_x", "n_x", "reach_x", F.col("own_x").alias("ell_x")).join(
        asked_y.select(*key, "y", "comp_y", "n_y", "reach_y", F.col("own_y").alias("ell_y")), key
    ).where("comp_x <> comp_y and apart <= reach_x + reach_y")
    counted = (
        taken.where(F.col("n_x") * 100 >= F.col("n_y") * percent)
        .where(F.col("n_y") * 100 >= F.col("n_x") * percent)
        .groupBy("x", "y", "n_x", "n_y", "ell_x", "ell_y")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    counted = counted.where(_promising("x", "y", F.col("shared"), percent))
    return counted.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_components(
    spark: SparkSession,
    documents: DataFrame,
    width: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row.

    Documents link when 100 * intersection >= percent * union of their shingle sets.
    ``component_id`` is the smallest id reachable by links.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    profile = materialise(_profile(docs, width), "profile", BATCH)
    texts = profile.where("part = -1")
    with_words = texts.where("n > 0 and doc_id is not null")
    nodes = with_words.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    nodes = materialise(nodes, "nodes")
    sketch = _sketch(profile)
    prefixes = _prefixes(docs.where("doc_id is not null"), width, percent, sketch)
    chosen = nodes.withColumnRenamed("sig", "_sig").hint("shuffle_hash")
    prefixes = prefixes.join(
        chosen, (F.col("doc_id") == F.col("rep")) & (F.col("sig") == F.col("_sig")), "left_semi"
    )
    tokens = materialise(
        prefixes.select(
            F.col("doc_id").alias("doc"), "n", F.posexplode("prefix").alias("pos", "token")
        ).distinct(),
        "prefixes",
        BATCH,
    )
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    postings = materialise(tokens.join(shared, "token"), "postings")
    postings = materialise(_adapted(postings, percent), "adapted")
    # An id with several texts links what its texts link.
    of_id = F.xxhash64("sig")
    several = with_words.groupBy("doc_id").agg(F.min(of_id).alias("low"), F.max(of_id).alias("high"))
    several = with_words.join(several.where("low <> high"), "doc_id", "left_semi")
    several = several.join(nodes, "sig").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    active = postings.withColumn("comp", F.col("doc"))
    links, found = several, None

    def joined(pairs: DataFrame) -> bool:
        """Verify pairs and extend the components; whether there were any pairs."""
        nonlocal found
        pairs = materialise(pairs, "pairs")
        if found is not None and pairs.isEmpty():
            return False
        more = _verified(pairs, docs, width, percent).toDF("a", "b")
        # components stand for the links they came from
        found = components((links if found is None else found.toDF("a", "b")).union(more))
        return True

    for seed in range(STAR_ROUNDS):
        if not joined(_star_pairs(active, percent, seed)):
            break
        active = _contested(postings, found)
    families = materialise(_families(active, percent), "families")
    ends = families.select(F.col("x").alias("doc")).union(families.select("y"))
    near = _token_sets(ends, docs, width)
    members = _with_sets(families, near)
    differences = materialise(_differences(members, percent), "differences", BATCH)
    deltas = materialise(_deltas(differences, percent), "family-deltas")
    hub_links = deltas.where("linked").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    found = components(found.toDF("a", "b").union(hub_links))
    inside = _with_enough_shared(_delta_pairs(_placed(deltas, found), percent), postings, percent)
    # An id with several texts may be near two pivots or none; it is a family of its own.
    whole = differences.groupBy("doc").agg(
        F.min("pivot").alias("family"),
        F.count(F.lit(1)).alias("texts"),
        F.max(F.size("tokens")).alias("off"),
    )
    several_texts = several.select(F.col("a").alias("doc")).distinct()
    whole = whole.where("texts = 1").join(several_texts, "doc", "left_anti")
    whole = whole.select(F.col("doc").alias("_doc"), F.hex("family").alias("_family"), "off")
    family = F.coalesce("_family", F.concat(F.lit("="), F.col("doc").cast("string")))
    active = _contested(postings, found).join(whole, F.col("doc") == F.col("_doc"), "left")
    active = materialise(active.withColumn("family", family).drop("_doc", "_family"), "contested")
    joined(inside.union(_cross_pairs(active, near, docs, width, percent)).distinct())
    placed = nodes.join(found, F.col("rep") == F.col("node"), "left").select(
        "sig", F.coalesce("component", "rep").alias("found")
    )
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("found"))
    return texts.join(placed, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(linked, F.col("doc_id")).alias("component_id"),
    )
