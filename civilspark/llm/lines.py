"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A line's key is the line without ASCII whitespace at both ends and with A-Z in lower
case.  Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
documents are *common*: their lines go everywhere but in the largest document id that
holds them.

The index has two tables, both dealt to shards by key:

* ``refs(shard, key, doc_id)``: which document holds which key, exactly;
* ``filters(shard, filter)``: a cuckoo filter of the shard's common keys.

Inserting or deleting documents changes the rows of ``refs``; keys that become common
enter their shard's filter and keys that stop being common leave it, so undoing an
insertion restores the earlier state.  A line is looked up in the counts only if the
filter of its shard lets it pass; the counts have the last word.

Null texts are one empty line.  Rows without an id are no holders and keep all their
lines.  Rows that repeat an id belong to one document.  An empty table gives an empty
index and an empty result.  Only the named columns are used.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.llm.common import plain_names
from civilspark.llm.cuckoo import CuckooFilter, built
from civilspark.session import materialise

KEYS_PER_SHARD = 50_000
LINES_PER_PROBE = 100_000
BLANKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit digest of a line's key; None if the key is too short."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars:  # bytes, at least as many as code points
        return None
    if sum((byte & 0xC0) != 0x80 for byte in key[: 4 * min_chars]) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def line_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Distinct ``(doc_id, key)``."""

    def keys(batches):
        for batch in batches:
            ids, out = [], []
            for i, value in zip(batch["doc_id"], batch["text"]):
                found = {
                    line_key(line, min_chars)
                    for line in value.encode("utf-8", "surrogatepass").split(b"\n")
                }
                found.discard(None)
                ids += [i] * len(found)
                out += found
            yield pd.DataFrame({"doc_id": ids, "key": out})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.where("doc_id is not null and text is not null")
    return rows.mapInPandas(keys, f"doc_id {kind}, key binary").distinct()


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")


def _common(refs: DataFrame, min_docs: int) -> DataFrame:
    """``(shard, key, holder)`` of common keys; ``holder`` keeps its lines."""
    counts = refs.groupBy("shard", "key").agg(
        F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("holder")
    )
    return counts.where(F.col("docs") >= min_docs).drop("docs")


def _numbers(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2]


def build(
    spark: SparkSession,
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
) -> LineIndex:
    """Index of a first set of documents."""
    keys = materialise(line_keys(docs, doc_id, text, min_chars), "line-keys")
    shards = max(1, math.ceil(keys.count() / KEYS_PER_SHARD))
    refs = keys.select(_shard(shards), "key", "doc_id")

    def filters(key, group):
        made = built(_numbers(group["key"]))
        return pd.DataFrame({"shard": [key[0]], "filter": [made.to_bytes()]})

    common = _common(refs, min_docs)
    made = common.groupBy("shard").applyInPandas(filters, "shard bigint, filter binary")
    return LineIndex(refs, materialise(made, "line-filters"), shards, min_docs, min_chars)


def update(
    index: LineIndex,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> LineIndex:
    """Index after adding documents and deleting the documents of some ids.

    ``removed`` has the ids to delete.  An added id that the index knows already gets
    the union of its lines.  Only shards with changes are touched.
    """
    refs = index.refs
    if removed is not None:
        gone = removed.select(F.col(doc_id).alias("doc_id")).distinct()
        refs = refs.join(gone, "doc_id", "left_anti").select(*index.refs.columns)
    if added is not None:
        new = line_keys(added, doc_id, text, index.min_chars)
        refs = refs.union(new.select(_shard(index.shards), "key", "doc_id")).distinct()
    refs = materialise(refs, "line-refs")
    before = _common(index.refs, index.min_docs).select("shard", "key", F.lit(-1).alias("step"))
    after = _common(refs, index.min_docs).select("shard", "key", F.lit(1).alias("step"))
    changes = (
        before.union(after)
        .groupBy("shard", "key")
        .agg(F.sum("step").alias("step"))
        .where("step <> 0")
    )

    def change(key, filters, changed):
        gone = _numbers(changed["key"][changed["step"] < 0])
        new = _numbers(changed["key"][changed["step"] > 0])
        data = filters["filter"].iloc[0] if len(filters) else built(new[:0]).to_bytes()
        now = CuckooFilter.from_bytes(data)
        now.delete(gone)
        if not now.insert(new):
            return pd.DataFrame({"shard": [key[0]], "filter": [None]})
        return pd.DataFrame({"shard": [key[0]], "filter": [now.to_bytes()]})

    changed = (
        index.filters.groupBy("shard")
        .cogroup(changes.groupBy("shard"))
        .applyInPandas(change, "shard bigint, filter binary")
    )
    changed = materialise(changed, "line-filters")
    full = changed.where("filter is null").select("shard")

    def rebuild(key, group):
        made = built(_numbers(group["key"]))
        return pd.DataFrame({"shard": [key[0]], "filter": [made.to_bytes()]})

    rebuilt = (
        _common(refs, index.min_docs)
        .join(full, "shard", "left_semi")
        .groupBy("shard")
        .applyInPandas(rebuild, "shard bigint, filter binary")
    )
    filters = changed.where("filter is not null").union(rebuilt)
    filters = materialise(filters, "line-filters")
    return LineIndex(refs, filters, index.shards, index.min_docs, index.min_chars)


def dropped_keys(index: LineIndex, keys: DataFrame) -> DataFrame:
    """``(doc_id, key)`` of the lines that go, out of ``keys(shard, key, doc_id)``.

    Keys meet their shard's filter in chunks of bounded size, dealt by document, so a
    line that half of all documents hold is tested by many tasks.
    """
    chunks = max(1, math.ceil(keys.count() / (LINES_PER_PROBE * index.shards)))
    probes = keys.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    each = F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))
    copies = index.filters.select("shard", F.explode(each).alias("chunk"), "filter")

    def test(lines, filters):
        if not len(lines) or not len(filters):
            return lines[["key", "doc_id"]].iloc[:0]
        passed = CuckooFilter.from_bytes(filters["filter"].iloc[0]).contains(
            _numbers(lines["key"])
        )
        return lines.loc[passed, ["key", "doc_id"]]

    kind = keys.schema["doc_id"].dataType.simpleString()
    possible = (
        probes.groupBy("shard", "chunk")
        .cogroup(copies.groupBy("shard", "chunk"))
        .applyInPandas(test, f"key binary, doc_id {kind}")
    )
    common = _common(index.refs, index.min_docs).select("key", "holder")
    return possible.join(common, "key").where("doc_id <> holder").select("doc_id", "key")


def deduplicated(
    index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All columns of ``docs`` with shortened text, and ``n_lines``, ``n_dropped``.

    Columns of these names in ``docs`` are replaced.
    ``docs`` are documents that the index holds.  Texts move once, to the short list
    of keys that their document loses.
    """
    drops = (
        dropped_keys(index, index.refs)
        .groupBy("doc_id")
        .agg(F.collect_list("key").alias("_keys"))
        .withColumnRenamed("doc_id", "_id")
        .hint("shuffle_hash")
    )
    min_chars = index.min_chars
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c not in (doc_id, text)])
    plain, name = plain_names(docs)
    names = plain.columns
    at = docs.columns.index(text)
    plain = plain.join(drops, F.col(name[doc_id]) == F.col("_id"), "left").drop("_id")
    plain = plain.withColumnRenamed("_keys", "keys")

    def shorten(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for value, keys in zip(batch[names[at]], batch["keys"]):
                parts = (value or "").split("\n")
                lines.append(len(parts))
                kept = parts
                if keys is not None and len(keys):
                    gone = {bytes(k) for k in keys}
                    kept = [
                        p
                        for p in parts
                        if line_key(p.encode("utf-8", "surrogatepass"), min_chars) not in gone
                    ]
                dropped.append(len(parts) - len(kept))
                texts.append("\n".join(kept) if value is not None else None)
            out = batch.drop(columns="keys")
            out[names[at]] = texts
            yield out.assign(n_lines=lines, n_dropped=dropped)

    kinds = [f.dataType.simpleString() for f in docs.schema]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    out = plain.mapInPandas(shorten, f"{schema}, n_lines bigint, n_dropped bigint")
    return out.toDF(*docs.columns, "n_lines", "n_dropped")
