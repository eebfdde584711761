"""The stages on a table with planted cases."""

import random

import corpus_pipeline as pipeline
from civilspark.session import materialise

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark, small, tmp_path):
    rng = random.Random(3)
    real = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    english = [w for r in real if r[2] == "en" for w in r[1].split()]
    fresh = lambda n: " ".join(rng.choices(english, k=n))
    shared = fresh(12)
    base = fresh(200)
    planted = [
        (10_000, base), (10_001, base), (10_002, base + " end"), (10_003, f"{fresh(80)} {item} {fresh(80)}"),
        (10_004, None), (10_005, "12 34"), (10_006, fresh(150)),
    ]
    planted += [(10_010 + i, f"{fresh(60)}\n{shared}\n{fresh(60)}") for i in range(4)]
    rows = real + [(i, t, "en", "planted", None) for i, t in planted] + [(None, fresh(90), "en", None, 1)]
    docs = materialise(spark.createDataFrame(rows, SCHEMA), "test-docs")
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, small), f"test-{name}")
        assert sorted(docs.columns) == sorted(c.split()[0] for c in SCHEMA.split(", "))
        kept.append({r.doc_id: r.text for r in docs.collect()})
    languages, lines, near, clean = kept
    assert {10_004, 10_005} & languages.keys() == set() and {10_000, 10_006, None} <= languages.keys()
    assert lines.keys() == languages.keys()
    assert [shared in lines[10_010 + i] for i in range(4)] == [False, False, False, True]
    assert {10_000, 10_001, 10_002} & near.keys() == {10_000} and {10_006, None} <= near.keys()
    assert near.keys() - clean.keys() >= {10_003} and {10_000, 10_006, 10_013, None} <= clean.keys()
    packed = pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.count() == docs.count()


def test_empty_documents(spark, small):
    docs = materialise(spark.createDataFrame([], SCHEMA), "empty-docs")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_extra_columns(spark, small):
    extra = ["_id", "_keys", "n_lines", "n_dropped", "lang_pred", "score", "c1", "hits", "family"]
    rows = [(i, f"some words number {i} of a text", "en", "s", 1, *["x"] * len(extra)) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in extra))
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, small), "extra")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] + extra
        assert docs.count() == 5 and {r.score for r in docs.collect()} == {"x"}
