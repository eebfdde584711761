"""Manifest, spelling variants and mixing against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civilspark.llm import manifest, mixing, spelling
from civilspark.llm.common import ordered
from civilspark.session import materialise

# Names that the operators use themselves.
EXTRA = {
    "_part": "int", "nth": "int", "n": "int", "row": "int", "tree": "string", "leaf": "string",
    "digest": "string", "block": "int", "path": "string", "word": "string", "key": "string",
    "run": "string", "h": "int", "size": "int", "target": "double", "weight": "double",
    "place": "int", "pass": "int", "upto": "int", "draw": "string", "words": "int", "level": "int",
    "_source": "string", "_id": "string", "root": "string", "subroot": "string", "near": "int",
}


def table(spark, rows, clash=True):
    """Rows ``(doc_id, text, lang, source, n_chars)``, columns of clashing names beside them."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    for name, kind in EXTRA.items() if clash else ():
        docs = docs.withColumn(name, F.lit("7").cast(kind))
    return docs


def test_ordered(spark):
    rows = [(k, i % 7, i) for k in ("a", "b", None) for i in range(50)] + [("c", 1, 1)]
    df = spark.createDataFrame(rows, "k string, v int, row int")
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("many"))
    got = ordered(df, ["k"], ["v", "row"], 6, "test", totals={"sum": "v"}, per_key=per_key).collect()
    assert len(got) == len(rows)
    for key in ("a", "b", "c", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.nth)
        assert [r.nth for r in mine] == list(range(len(mine))) and {r.many for r in mine} == {len(mine)}
        assert [(r.v, r.row) for r in mine] == sorted((r.v, r.row) for r in mine)
        assert [r.sum for r in mine] == list(np.cumsum([r.v for r in mine]))
    assert ordered(df.where("false"), ["k"], ["v"], 2, "test").count() == 0


# ---- 11 --------------------------------------------------------------------


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row
    fields = (doc_id, source, lang, n_chars, text)
    return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def up(nodes):
    return [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def climb(nodes, at):
    """Root, and ``(sibling, sibling is left)`` or None per level."""
    path = []
    while len(nodes) > 1:
        path.append((nodes[at ^ 1], bool(at & 1)) if at ^ 1 < len(nodes) else None)
        nodes, at = up(nodes), at // 2
    return nodes[0], path


def brute_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for leaves in trees.values():
        leaves.sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in trees[lang]], 0)[0] for lang in langs]
    out = []
    for k, lang in enumerate(langs):
        nodes = [x[2] for x in trees[lang]]
        for i, (_, _, leaf, row) in enumerate(trees[lang]):
            subroot, inner = climb(nodes, i)
            root, outer = climb(subroots, k)
            node = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                node = leaf_of((*row[:4], row[4] + 1))
            for step in inner + outer:
                node = digest(node) if step is None else digest(*([step[0], node] if step[1] else [node, step[0]]))
            proof = digest(*[s[0] for s in inner + outer if s is not None])
            out.append((str(row[0]), leaf, subroot, root, proof, node, node == root))
    return sorted(out)


def manifest_rows(spark, rows, bits):
    docs = table(spark, rows)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.col("n_chars").cast("decimal(38,0)")
    leaves = manifest.leaves(docs, altered={"n_chars": F.when(chosen, n_chars + 1).otherwise(n_chars)})
    got = manifest.manifest(spark, leaves, bits).collect()
    shown = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    return sorted(
        (str(r.doc_id), *[bytes(r[c]).hex() for c in shown], r.folded_root == r.root) for r in got
    )


def manifest_cases(langs, seed=1):
    rng = random.Random(seed)
    rows = []
    for lang, many in langs.items():
        for _ in range(many):
            i = rng.randrange(10_000)
            rows.append((i, rng.choice(["", "a", "é😀 x" * 40, None]), lang, rng.choice(["s", None]), rng.choice([3, None])))
    rows += [(None, "n", "de", None, 5), (None, "m", "de", "", 2**63 - 1), (-4, "x" * 400_000, None, "s", 400_000)]
    return rows + rows[:5] + [rows[-1]] * 3  # repeated rows


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest(spark, bits):
    rows = manifest_cases({"de": 23, "en": 33, "é": 1, None: 8, "": 5, "z": 16})
    assert manifest_rows(spark, rows, bits) == brute_manifest(rows)


def test_manifest_of_many_trees_and_of_few_rows(spark):
    rows = [(i, "t", f"l{i % 11}", "s", 1) for i in range(40)]
    assert manifest_rows(spark, rows, 2) == brute_manifest(rows)
    assert manifest_rows(spark, rows[:1], 12) == brute_manifest(rows[:1])  # a lone leaf is the root
    assert manifest_rows(spark, [], 12) == []


def test_manifest_keeps_large_ids_beside_nulls(spark):
    rows = [(2**60 + 1, "a", "x", "s", 1), (None, "b", "x", "s", 1), (2**60 + 3, "c", "x", "s", None)]
    assert manifest_rows(spark, rows, 1) == brute_manifest(rows)


# ---- 12 --------------------------------------------------------------------


def brute_counts(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=10):
    words, forms, out = sorted(counts), {}, []
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(near[w]), counts.get(forms[w])))
    return sorted(out, key=str)


def variant_rows(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def test_spelling_variants(spark):
    rng = random.Random(5)
    stems = ["ordnung", "ähnlich", "Éclairs", "mountain", "mountains", "transformation", "ab×÷cdefg", "q" * 300]
    rows = []
    for i in range(60):
        words = rng.choices(stems, k=60)
        for _ in range(6):
            w = list(rng.choice(stems))
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["x"], [w[at], "e"], ["ö"]])
            words.append("".join(w))
        rows.append((i if i % 9 else None, rng.choice([" ", "1", "\n", "ł"]).join(words), "x", "s", 1))
    rows += [(100, None, "x", "s", 1), (101, "", "x", "s", 1), (102, "short words", "x", "s", 1), rows[0], rows[0]]
    rows.append((103, "Mountain " * 20_000, "x", "s", 1))
    want = brute_variants(brute_counts(rows))
    assert any(r[1] for r in want) and len(want) > 50
    assert variant_rows(spelling.spelling_variants(spark, table(spark, rows))) == want
    assert spelling.spelling_variants(spark, table(spark, [])).count() == 0


@pytest.mark.parametrize("pieces, limit, block", [(4, 2048, 64), (1, 5, 2), (2, 3, 4), (3, 40, 8)])
def test_near_words_in_halved_groups(spark, monkeypatch, pieces, limit, block):
    """Many words that agree but for one place, ties, chains of forms, words of any script."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(7)
    counts = {"a" * k: 3 for k in range(7, 12)} | {"abcdef" + c: 2 for c in "ghijklmnopqrstuvwxyz"}
    counts |= {f"{c}bcdefgh": 40 for c in "abcdéü"} | {"bcdefgh": 400, "bcdefghij": 4000, "bcdefghi": 4000}
    for _ in range(300):
        counts["".join(rng.choices("ab", k=rng.randrange(7, 12)))] = rng.choice([2, 20, 200, 2000])
    counts |= {"日本語日本語日": 30, "日本語日本語本": 2, "😀bcdefgh": 2}
    df = materialise(spark.createDataFrame(list(counts.items()), "word string, n bigint"), "test-words")
    got = spelling.variants(df, pieces=pieces, limit=limit)
    assert variant_rows(got) == brute_variants(counts)


def test_blocks_of_a_large_group():
    words = ["x" * 10 + chr(200 + i) for i in range(130)] + ["x" * 10]
    frame = pd.DataFrame({"word": words, "most": 11, "low": 10, "high": 11, "key": 1})
    found = {frozenset(p) for i, j in spelling.near_pairs(words, frame, 16) for p in zip(i, j)}
    assert len(found) == 131 * 130 // 2


# ---- 13 --------------------------------------------------------------------


def brute_targets(sizes, budget, weights):
    """Share, stop at the limit, share the rest again."""
    targets, open_ = {}, set(sizes)
    while open_:
        left = budget - sum(targets.values())
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > 2 * sizes[s]}
        if not over:
            return targets | {s: left * weights[s] / weight for s in open_}
        targets |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return targets


def mixed(spark, rows, **options):
    return mixing.taken(spark, table(spark, rows), **options).collect()


def mixing_cases():
    rng = random.Random(11)
    rows = []
    for source, many in {"a": 200, "b": 40, "c": 30, None: 25, "é": 3, "B": 60, "": 9}.items():
        for _ in range(many):
            text = " ".join(rng.choices(["x", "yy", "z z", "😀"], k=rng.randrange(60)))
            rows.append((rng.randrange(10_000), rng.choice([text, text, text, None, "", " \n\t"]), "l", source, 1))
    rows += [(None, "one two", "l", "a", 1), (None, "one two", "l", "a", 1), (None, "three", "l", None, 1)]
    rows += [rows[0]] * 30 + [(77, "w " * 50_000, "l", "b", 1), (78, None, "l", "zero", 1)]
    return rows


def test_mixing(spark):
    rows = mixing_cases()
    got = mixed(spark, rows)
    size = lambda t: len(re.findall("[^\\x20\\x09-\\x0d]+", t or ""))
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += size(row[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = brute_targets(sizes, 1.5 * sum(sizes.values()), weights)
    assert Counter((str(r[0]), str(r[3]), size(r[1])) for r in rows) == Counter(
        (str(r.doc_id), str(r.source), r.size) for r in got
    )
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    total = int(1.5 * sum(sizes.values()))
    assert total - len(names) <= sum(taken.values()) <= total
    again = mixed(spark, rows[::-1])
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_order(spark):
    """Entries come by finish time, a whole pass before the next one, cut at the budget."""
    docs = materialise(mixing.sized(table(spark, mixing_cases())), "test-sizes")
    sources = mixing.cyclic_weights(materialise(mixing.source_sizes(docs), "test-sources"))
    for budget in (0, 7, 3000):
        targets = materialise(mixing.with_targets(sources, budget), "test-targets")
        queues = materialise(mixing.placed(docs, targets, 3), "test-queues")
        entries = sorted(mixing.mix(queues, budget).collect(), key=lambda r: r.upto)
        assert [r.finish for r in entries] == sorted(r.finish for r in entries)
        assert sum(r.words for r in entries) == budget
        assert [r.upto for r in entries] == list(np.cumsum([r.words for r in entries]))
        assert all(r.start < 1 for r in entries)
        first = {(r.source, r.place): r.upto for r in entries if r["pass"] == 0}
        assert all(first[r.source, r.place] < r.upto for r in entries if r["pass"] == 1)


def test_mixing_of_nothing(spark):
    assert mixed(spark, []) == []
    (row,) = mixed(spark, [(1, None, "l", None, 1)])
    assert (row.size, row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)
