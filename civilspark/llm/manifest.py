"""Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf: the SHA-256 of its fields, each with its length.  The leaves of a tree
(a language) ascend by id, every two consecutive nodes become one until one is left; the
roots of the trees, ordered by key, become the root of the dataset in the same way.  A
proof is the list of siblings from a leaf to the root.

A tree is cut into superblocks of ``2 ** BITS`` consecutive leaves.

* Up: each superblock is reduced to its one node in a task; these nodes are the leaves of
  the next, ``2 ** BITS`` times smaller tier, until a tree is one node.
* Down: the path above a superblock (its outer nodes) comes from the tier above.
* Exchange: leaves and outer nodes are cogrouped by superblock; the task finishes the local
  reduction, joins the proof and folds the leaf at hand up to the root.

So each task holds one superblock, however many rows a tree has, and a proof costs no join
per level.  Places of leaves come from ``common.ordered``.

Nulls: a missing field counts as ``-``, a null tree key is a tree of its own, the first
one; null ids come first in their tree.  Rows with equal ids ascend by their leaf, so
repeated rows are leaves side by side.  Empty texts have length 0, very long texts are
hashed in the row and never moved.  An empty table gives an empty manifest.  Only the named
columns are used, so columns of other names may be there.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.llm.common import ordered, rank_parts
from civilspark.session import materialise

BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# A path is a row of records: on which side the sibling stands, then its digest.
RIGHT, LEFT, ALONE = 0, 1, 2
RECORD = 33
_NODES = "tree binary, nth bigint, n bigint, digest binary"


def field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]), 256))


def parent(nodes: list[bytes]) -> bytes:
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels_of(nodes: list[bytes], height: int | None) -> list[list[bytes]]:
    """All levels from ``nodes`` up, ``height`` steps high or until one node is left."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([parent(below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def path_in(levels: list[list[bytes]], at: int) -> bytes:
    """Records of the siblings of node ``at`` of the lowest level, from below."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        if other < len(level):
            out.append(bytes([RIGHT if other > at else LEFT]) + level[other])
        else:
            out.append(bytes([ALONE]) + bytes(RECORD - 1))
        at >>= 1
    return b"".join(out)


def records(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[i], path[i + 1 : i + RECORD]) for i in range(0, len(path), RECORD)]


def step(node: bytes, side: int, sibling: bytes) -> bytes:
    if side == ALONE:
        return parent([node])
    return parent([node, sibling] if side == RIGHT else [sibling, node])


def fold(node: bytes, path: list[tuple[int, bytes]], known: dict) -> bytes:
    """The root that a node and its path give; equal steps are taken once."""
    trail = []
    for at, (side, sibling) in enumerate(path):
        key = (len(path) - at, side, sibling, node)
        if key in known:
            node = known[key]
            break
        trail.append(key)
        node = step(node, side, sibling)
    for key in trail:
        known[key] = node
    return node


def _height(n: int, bits: int) -> int | None:
    return bits if n > 1 << bits else None


def _in_order(group: pd.DataFrame) -> pd.DataFrame:
    return group.sort_values("nth", kind="stable")


def _tiers(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """``nodes`` and the tiers above it, each of one node per superblock below."""
    width = 1 << bits

    def reduce(key, group):
        group = _in_order(group)
        n = int(group["n"].iloc[0])
        top = levels_of(list(group["digest"]), _height(n, bits))[-1][0]
        out = {"tree": [key[0]], "nth": [int(key[1])], "n": [-(-n // width)], "digest": [top]}
        return pd.DataFrame(out)

    tiers, largest = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        block = F.shiftright("nth", bits).alias("block")
        rows = tiers[-1].where("n > 1").select("tree", "nth", "n", "digest", block)
        above = rows.groupBy("tree", "block").applyInPandas(reduce, _NODES)
        tiers.append(materialise(above, "tier"))
        largest = -(-largest // width)
    return tiers


def _tops(tiers: list[DataFrame]) -> DataFrame:
    """``(tree, digest)``: the one node that each tree ends in."""
    done = [tier.where("n = 1").select("tree", "digest") for tier in tiers]
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _cogrouped(nodes: DataFrame, outer: DataFrame, bits: int):
    block = F.shiftright("nth", bits).alias("block")
    return nodes.select("*", block).groupBy("tree", "block").cogroup(
        outer.groupBy("tree", "block")
    )


def _outer(tiers: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """``(tree, block, path)`` of each superblock of the lowest tier.

    ``above`` has ``(tree, path)``, the path over the top of each tree.
    """

    def descend(key, nodes, outer):
        if not len(nodes):
            return pd.DataFrame({"tree": [], "block": [], "path": []})
        nodes = _in_order(nodes)
        levels = levels_of(list(nodes["digest"]), _height(int(nodes["n"].iloc[0]), bits))
        rest = outer["path"].iloc[0]
        return pd.DataFrame(
            {
                "tree": [key[0]] * len(nodes),
                "block": nodes["nth"],
                "path": [path_in(levels, i) + rest for i in range(len(nodes))],
            }
        )

    # In the last tier every tree is one node already.
    lower = tiers[:-1] or tiers
    outer = None
    for k in reversed(range(len(lower))):
        sizes = lower[k].groupBy("tree").agg(F.max("n").alias("n"))
        whole = sizes.where(F.col("n") <= 1 << bits).select("tree")
        block = F.lit(0).cast("bigint").alias("block")
        own = above.join(whole, "tree").select("tree", block, "path")
        if outer is None:
            outer = own
            continue
        # Trees of several superblocks here have several nodes in the tier above.
        nodes = lower[k + 1].where("n > 1")
        reached = outer.join(nodes.select("tree").distinct(), "tree", "left_semi")
        paths = _cogrouped(nodes, reached, bits).applyInPandas(
            descend, "tree binary, block bigint, path binary"
        )
        outer = materialise(own.unionByName(paths), "outer")
    return outer


def leaves(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    doc_id: str = "doc_id",
    tree: str = "lang",
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """``(doc_id, tree, leaf, altered, row)``; null trees have an empty key.

    ``altered`` replaces fields; its leaf is null where it changes nothing.
    """
    key = F.coalesce(F.concat(F.lit(b"="), F.col(tree).cast("binary")), F.lit(b""))
    changed = F.lit(None).cast("binary")
    if altered:
        differs = F.lit(False)
        for name, value in altered.items():
            differs |= ~value.eqNullSafe(F.col(name))
        changed = F.when(differs, leaf([altered.get(f, F.col(f)) for f in fields]))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        key.alias("tree"),
        leaf([F.col(f) for f in fields]).alias("leaf"),
        changed.alias("altered"),
        F.monotonically_increasing_id().alias("row"),
    )


def manifest(spark: SparkSession, leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """``(doc_id, tree, nth, leaf, altered, subroot, root, path, proof_sha256, folded_root)``.

    ``path`` has the siblings (see ``records``); ``proof_sha256`` hashes their hex digits
    from below; ``folded_root`` is what the altered leaf, else the leaf, leads to.
    """
    leaves = materialise(leaves, "leaves")
    counts = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    parts = rank_parts(leaves.count())
    order = [F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("row")]
    placed = ordered(leaves, ["tree"], order, parts, "leaf-ranges", per_key=counts)
    # pandas has no whole numbers with nulls: ids travel as text.
    kind = leaves.schema["doc_id"].dataType
    placed = placed.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "tree",
        F.col("leaf").alias("digest"),
        "altered",
        "nth",
        "n",
    )
    placed = materialise(placed, "placed-leaves")
    tiers = _tiers(placed, bits)
    tops = materialise(_tops(tiers), "subroots")
    n_trees = tops.count()
    if not n_trees:
        return spark.createDataFrame([], _manifest_schema(kind.simpleString()))
    trees = ordered(
        tops.withColumnRenamed("tree", "key"), [], ["key"], rank_parts(n_trees), "trees"
    )
    nodes = trees.select(
        F.lit(b"").alias("tree"), "nth", F.lit(n_trees).cast("bigint").alias("n"), "digest", "key"
    )
    nodes = materialise(nodes, "trees")
    forest = _tiers(nodes, bits)
    root = bytes(_tops(forest).first()["digest"])  # one digest
    none = spark.createDataFrame([(b"", b"")], "tree binary, path binary")

    def over_trees(key, group, outer):
        group = _in_order(group)
        levels = levels_of(list(group["digest"]), _height(int(group["n"].iloc[0]), bits))
        rest = outer["path"].iloc[0]
        paths = [path_in(levels, i) + rest for i in range(len(group))]
        return pd.DataFrame({"tree": group["key"], "path": paths, "subroot": group["digest"]})

    above = _cogrouped(nodes, _outer(forest, none, bits), bits).applyInPandas(
        over_trees, "tree binary, path binary, subroot binary"
    )
    above = materialise(above, "tree-paths")
    outer = _outer(tiers, above.select("tree", "path"), bits)
    outer = outer.join(above.select("tree", "subroot"), "tree")

    def finish(key, group, outer):
        group = _in_order(group)
        levels = levels_of(list(group["digest"]), _height(int(group["n"].iloc[0]), bits))
        rest, subroot = outer["path"].iloc[0], outer["subroot"].iloc[0]
        paths, proofs, folded, known = [], [], [], {}
        for i, (own, other) in enumerate(zip(group["digest"], group["altered"])):
            path = path_in(levels, i) + rest
            steps = records(path)
            siblings = "".join(s.hex() for side, s in steps if side != ALONE)
            paths.append(path)
            proofs.append(sha256(siblings.encode()).digest())
            folded.append(fold(own if other is None else other, steps, known))
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"],
                "tree": group["tree"],
                "nth": group["nth"],
                "leaf": group["digest"],
                "altered": group["altered"],
                "subroot": subroot,
                "root": root,
                "path": paths,
                "proof_sha256": proofs,
                "folded_root": folded,
            }
        )

    proofs = _cogrouped(placed, outer, bits).applyInPandas(finish, _manifest_schema("string"))
    return proofs.withColumn("doc_id", F.col("doc_id").cast(kind))


def _manifest_schema(kind: str) -> str:
    digests = ", ".join(
        f"{c} binary"
        for c in ("leaf", "altered", "subroot", "root", "path", "proof_sha256", "folded_root")
    )
    return f"doc_id {kind}, tree binary, nth bigint, {digests}"
