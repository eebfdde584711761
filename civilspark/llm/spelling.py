"""Grouping of spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into the
other: with the length M of the longer one, common prefix plus common suffix reach M - 1.

Candidates.  Positions 0 to M are cut into pieces.  The common prefix of a near pair ends in
one piece, so the words agree before that piece and, counted from the end, behind it.  Words
are dealt by (M, piece, hash of what lies outside the piece), once with their own length as
M and once with one more.  Each near pair meets exactly once for its piece.  A group with
more than ``GROUP`` words has its piece halved, again and again; a piece of one position
leaves as many words as there are letters, so every group is bounded and no pair is lost.

Tiles.  Words of several groups become padded code-point matrices, one flush left and one
flush right, in blocks of ``BLOCK`` words or of the next smaller power of two for small
groups.  Pairs of blocks of a group are compared position by position at once.  A task sends
out only the number of near words and the best one for each word, not the pairs.

The form of a word is its near word of the largest count (ties: the smallest by code
points), if that is ``ratio`` times its own at least.  Counts grow along forms, so the chain
of forms ends; it is followed by doubling.

Null and empty texts have no words, very long texts are read whole and leave the row word
by word.  A null id counts as an empty one.  Repeated rows count repeatedly.  An empty table
gives an empty result.  Only the named columns are used.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.session import materialise

RUN = r"[A-Za-z\x{C0}-\x{FF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10
NOISE = 31  # one run of so many loses a code point
PIECES = 4
GROUP = 2048  # words that are compared with one another at once
BLOCK = 64
TILE_BYTES = 8 << 20  # of one comparison


def noisy_words(
    docs: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS, noise: int = NOISE
) -> DataFrame:
    """``word`` of every run of letters, some of them with a code point missing."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))
    lower = lambda r: F.when(
        F.octet_length(r) == F.length(r), F.lower(r)
    ).otherwise(F.translate(r, UPPER, LOWER))
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"))
    rows = docs.select(key.alias("key"), F.explode(F.transform(runs, lower)).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("key", "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.pmod("h", F.lit(noise)) == 0, shorter).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= min_chars)


def word_counts(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of words that occur ``min_count`` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _outside(word: str, most: Column, low: Column, high: Column) -> Column:
    """Hash of what lies before ``low`` and, counted from the end of ``most``, behind ``high``."""
    length = F.length(word)
    behind = F.least(most - high, length)
    return F.xxhash64(
        F.substr(word, F.lit(1), low), F.substr(word, length - behind + 1, behind)
    )


def _pieces(counts: DataFrame, pieces: int) -> DataFrame:
    """``(most, low, high, key, word, n)``: the groups that each word is in."""
    rows = counts.select("word", "n", F.length("word").alias("l"))
    rows = rows.select("word", "n", F.explode(F.array(F.col("l"), F.col("l") + 1)).alias("most"))
    cut = lambda k: F.floor(F.col("most") * k / F.lit(pieces)).cast("int")
    rows = rows.select(
        "word",
        "n",
        "most",
        F.explode(
            F.array(
                *[F.struct(cut(k).alias("low"), cut(k + 1).alias("high")) for k in range(pieces)]
            )
        ).alias("p"),
    ).select("word", "n", "most", "p.low", "p.high")
    return rows.where("low < high").withColumn(
        "key", _outside("word", F.col("most"), F.col("low"), F.col("high"))
    )


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")),
        F.struct(middle.alias("low"), F.col("high").alias("high")),
    )
    rows = rows.select("word", "n", "most", F.explode(halves).alias("p"))
    return rows.select("word", "n", "most", "p.low", "p.high").withColumn(
        "key", _outside("word", F.col("most"), F.col("low"), F.col("high"))
    )


GROUPED = ["most", "low", "high", "key"]


def groups(counts: DataFrame, pieces: int = PIECES, limit: int = GROUP) -> DataFrame:
    """Rows ``(most, low, high, key, word, n)``, in no group above ``limit`` with a piece to halve."""
    rows = materialise(_pieces(counts, pieces), "pieces")
    done = None
    while True:
        sizes = rows.groupBy(*GROUPED).agg(F.count(F.lit(1)).alias("size"))
        large = sizes.where((F.col("size") > limit) & (F.col("high") - F.col("low") > 1))
        large = materialise(large.drop("size"), "large-groups")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(large, GROUPED, "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rows = materialise(_halved(rows.join(large, GROUPED, "left_semi")), "pieces")


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded matrices, flush left and flush right, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=0)) + 1
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    kind = np.uint8 if not len(flat) or flat.max() < 256 else np.uint32
    left = np.zeros((len(words), width), kind)
    right = np.zeros((len(words), width), kind)
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left[row, column] = flat
    right[row, lengths[row] - 1 - column] = flat
    return left, right, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of block a with each of block b."""
    alive = np.ones((a.shape[0], a.shape[1], b.shape[1]), bool)
    out = np.zeros(alive.shape, np.uint8 if a.shape[2] < 256 else np.int32)
    for k in range(a.shape[2]):
        alive &= (a[:, :, None, k] == b[:, None, :, k]) & (a[:, :, None, k] != 0)
        if not alive.any():
            break
        out += alive
    return out


def _tiles(starts: np.ndarray, sizes: np.ndarray, block: int) -> dict:
    """Pairs of blocks by block size: rows ``(first of a, first of b, end of the group)``."""
    found: dict[int, list] = {}
    side = 2
    while side <= block:  # groups that are one block
        fit = (sizes <= side) & (sizes > (side // 2 if side > 2 else 1))
        if fit.any():
            begin = starts[fit]
            found[side] = [np.stack([begin, begin, begin + sizes[fit]], 1)]
        side *= 2
    for start, size in zip(starts[sizes > block], sizes[sizes > block]):
        begins = np.arange(start, start + size, block)
        i, j = np.triu_indices(len(begins))
        stop = np.full(len(i), start + size)
        found.setdefault(block, []).append(np.stack([begins[i], begins[j], stop], 1))
    return {side: np.concatenate(rows) for side, rows in found.items()}


def near_pairs(words: list[str], frame: pd.DataFrame, block: int = BLOCK):
    """Index pairs ``(i, j)`` of near words in a frame sorted by group."""
    left, right, lengths = code_points(words)
    bounds = frame[GROUPED].ne(frame[GROUPED].shift()).any(axis=1).to_numpy()
    starts = np.flatnonzero(bounds)
    sizes = np.diff(np.append(starts, len(frame)))
    many = sizes > 1
    most, low, high = (frame[c].to_numpy() for c in ("most", "low", "high"))
    for side, tiles in _tiles(starts[many], sizes[many], block).items():
        step = max(1, TILE_BYTES // (side * side * 4))
        for at in range(0, len(tiles), step):
            part = tiles[at : at + step]
            rows_a = part[:, :1] + np.arange(side)
            rows_b = part[:, 1:2] + np.arange(side)
            in_a, in_b = rows_a < part[:, 2:], rows_b < part[:, 2:]
            rows_a, rows_b = np.where(in_a, rows_a, 0), np.where(in_b, rows_b, 0)
            before = _common(left[rows_a], left[rows_b]).astype(np.int32)
            behind = _common(right[rows_a], right[rows_b])
            longer = np.maximum(lengths[rows_a][:, :, None], lengths[rows_b][:, None, :])
            first = part[:, 0]
            near = before + behind >= longer - 1
            near &= (longer == most[first][:, None, None]) & in_a[:, :, None] & in_b[:, None, :]
            near &= (before >= low[first][:, None, None]) & (before < high[first][:, None, None])
            near &= rows_a[:, :, None] < rows_b[:, None, :]
            tile, i, j = np.nonzero(near)
            yield rows_a[tile, i], rows_b[tile, j]


def _compare(frames):
    """``(word, near, best_n, best)`` per word and batch of whole groups."""
    for frame in frames:
        words = list(frame["word"])
        n = frame["n"].to_numpy()
        pairs = list(near_pairs(words, frame))
        if not pairs:
            continue
        i = np.concatenate([p[0] for p in pairs] + [p[1] for p in pairs])
        j = np.concatenate([p[1] for p in pairs] + [p[0] for p in pairs])
        if not len(i):
            continue
        links = pd.DataFrame(
            {"word": [words[k] for k in i], "best": [words[k] for k in j], "best_n": n[j]}
        )
        # Python compares strings by code points.
        links = links.sort_values(["word", "best_n", "best"], ascending=[True, False, True])
        out = links.groupby("word", sort=False).agg(
            near=("best", "size"), best_n=("best_n", "first"), best=("best", "first")
        )
        yield out.reset_index()[["word", "near", "best_n", "best"]]


def _whole_groups(batches, rows: int = 20_000):
    """Frames of whole groups out of batches sorted by group."""
    kept = None
    for batch in batches:
        frame = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if len(frame) < rows:
            kept = frame
            continue
        last = (frame[GROUPED] == frame[GROUPED].iloc[-1]).all(axis=1).to_numpy()
        cut = len(frame) - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        kept = frame.iloc[cut:].reset_index(drop=True)
    if kept is not None and len(kept):
        yield kept


def near_words(counts: DataFrame, pieces: int = PIECES, limit: int = GROUP) -> DataFrame:
    """``(word, n_near, best_n, best)`` of words that have a near word."""
    rows = groups(counts, pieces, limit)
    tasks = rows.repartition(*GROUPED).sortWithinPartitions(*GROUPED)
    links = tasks.mapInPandas(
        lambda batches: _compare(_whole_groups(batches)),
        "word string, near bigint, best_n bigint, best string",
    )
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("best")))
    return links.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.order")).alias("best_n"), F.col("b.best").alias("best")
    )


def variants(counts: DataFrame, ratio: int = RATIO, **options) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``counts(word, n)``."""
    near = materialise(near_words(counts, **options), "near-words")
    taken = F.col("best_n") >= ratio * F.col("n")
    rows = counts.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, F.col("best")).alias("form"),
        F.when(taken, F.col("best_n")).alias("form_n"),
    )
    rows = materialise(rows, "forms")
    top = rows.agg(F.max("n")).first()[0] or 1
    # Each form has ``ratio`` times the count, so chains have log(count) steps at most.
    steps = 1 + math.ceil(math.log(top, max(ratio, 2)))
    jump = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        jump = materialise(jump, "roots")
        further = jump.select(F.col("word").alias("_via"), F.col("root").alias("_root"))
        jump = jump.join(further, F.col("root") == F.col("_via"), "left").select(
            "word", F.coalesce("_root", "root").alias("root")
        )
    return rows.join(jump, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The variants of the words of a corpus, noise included (see ``noisy_words``)."""
    counts = materialise(word_counts(noisy_words(documents, doc_id, text)), "words")
    return variants(counts)
