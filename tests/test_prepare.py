import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from civilspark.operators import prepare
from civilspark.plans.jobs import attach_split, prepare_dataset


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def texts(spark):
    data = [
        (1, "same", "a"),
        (2, "same", "b"),
        (3, None, "a"),
        (4, None, "a"),
        (5, "x", None),
        (6, " ok ", "b"),
        (0, "other text", "b"),
        (7, "other text", "a"),
    ]
    return spark.createDataFrame(data, "id long, text string, label string")


def test_profile(texts):
    assert rows(prepare.profile(texts)) == {
        (0, "id", 8, 0),
        (1, "text", 8, 2),
        (2, "label", 8, 1),
    }


def test_dedupe_keeps_rows_without_id(spark):
    df = spark.createDataFrame(
        [(None, "a"), (None, "a"), (2, "a"), (1, "a")], "id long, text string"
    )
    kept = prepare.drop_duplicate_texts(df, "text", "id")
    assert sorted(r.id or 0 for r in kept.collect()) == [0, 0, 1]


def test_dedupe_keeps_first_and_treats_nulls_alike(texts):
    kept = prepare.drop_duplicate_texts(texts, "text", "id")
    assert sorted(r.id for r in kept.collect()) == [0, 1, 3, 5, 6]
    assert kept.columns == texts.columns
    assert rows(prepare.duplicate_counts(texts, "text")) == {(8, 3, 5)}


def test_duplicate_counts_of_nothing(texts):
    assert rows(prepare.duplicate_counts(texts.limit(0), "text")) == {(0, 0, 0)}


def test_class_distribution(texts):
    out = [tuple(r) for r in prepare.class_distribution(texts, "label").collect()]
    assert out == [("a", 4, 57.14), ("b", 3, 42.86)]


def test_min_length(texts):
    kept = prepare.min_length_filter(texts, "text")
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 7]


def expected_split(pairs, seed=42):
    """Brute force: order every class by (md5, id) and cut it."""
    classes = defaultdict(list)
    for id_, label in pairs:
        digest = hashlib.md5(f"{seed}|{id_}".encode()).hexdigest()
        classes[label].append((digest, id_))
    out = {}
    for members in classes.values():
        n = len(members)
        for rank, (_, id_) in enumerate(sorted(members), 1):
            out[id_] = (
                "train" if rank * 10 <= n * 8 else "val" if rank * 10 <= n * 9 else "test"
            )
    return out


@pytest.mark.parametrize("prefix_length", [0, 1, 4])
def test_stratified_split_equals_brute_force(spark, prefix_length):
    # One class holds more than a third, one a single row, one is missing.
    pairs = [(i, "hot" if i % 2 else f"c{i % 7}") for i in range(900)]
    pairs += [(1000, "single"), (1001, None), (1002, None), (1003, None)]
    df = spark.createDataFrame(pairs, "id long, label string")
    out = prepare.stratified_split(df, "label", "id", prefix_length=prefix_length)
    assert {r.id: r.split for r in out.collect()} == expected_split(pairs)
    assert out.columns == ["id", "label", "split"]


def test_split_moves_no_rows(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 3).cast("string"))
    plan = prepare.stratified_split(df, "label", "id")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "BroadcastHashJoin" in physical
    assert "hashpartitioning" not in physical and "SortMergeJoin" not in physical


def test_split_summary(spark):
    df = spark.createDataFrame([("train",)] * 8 + [("val",), ("test",)], "split string")
    assert rows(prepare.split_summary(df)) == {
        ("train", 8, 80.0),
        ("val", 1, 10.0),
        ("test", 1, 10.0),
    }


def test_prepare_dataset(spark):
    data = [(i, f"text number {i % 60}", f"c{i % 2}") for i in range(120)]
    data += [(500, " x ", "c0")]
    df = spark.createDataFrame(data, "id long, text string, label string")
    split = prepare_dataset(df, "text", "label", "id")
    found = {r.id: r.split for r in split.collect()}
    assert found == expected_split([(i, f"c{i % 2}") for i in range(60)])
    full = attach_split(df, split, "id")
    assert Counter(r.split for r in full.collect()) == {"train": 48, "val": 6, "test": 6}


def test_one_rule_for_rows_without_id(spark):
    """The same rows stay wherever copies are removed; no text moves for few copies."""
    rows = [(1, "same text", "a"), (2, "same text", "a"), (None, "same text", "a"), (None, "same text", "b")]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    kept = prepare.drop_duplicate_texts(df, "text", "id")
    assert kept.columns == df.columns
    want = Counter((i, label) for i, _, label in rows if i != 2)
    assert Counter((r.id, r.label) for r in kept.collect()) == want
    split = prepare_dataset(df, "text", "label", "id")
    assert Counter((r.id, r.label) for r in split.collect()) == want
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 0
