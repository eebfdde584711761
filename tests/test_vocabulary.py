import math

import pytest
from pyspark.sql import functions as F

from collections import Counter

from civilspark.operators import features, vocabulary


@pytest.fixture(scope="module")
def docs(spark):
    data = [(10, "b a b c"), (2, "a D e"), (3, "e f f"), (4, "")]
    return spark.createDataFrame(data, "id long, text string")


def by_index(vocab):
    return [r.token for r in sorted(vocab.collect(), key=lambda r: r.idx)]


def test_frequency(docs):
    out = {r.token: r.freq for r in vocabulary.token_frequency(docs, "text").collect()}
    assert out == {"a": 2, "b": 2, "c": 1, "d": 1, "e": 2, "f": 2}


def test_vocabulary_ties_in_order_of_first_sight(docs):
    vocab = vocabulary.build_vocabulary(docs, "text", "id", 100, 2)
    # All four occur twice; document 2 comes first.
    assert by_index(vocab) == ["<pad>", "<unk>", "a", "e", "f", "b"]


def test_vocabulary_size_counts_reserved_tokens(docs):
    vocab = vocabulary.build_vocabulary(docs, "text", "id", 4, 1)
    assert by_index(vocab) == ["<pad>", "<unk>", "a", "e"]
    assert by_index(vocabulary.build_vocabulary(docs, "text", "id", 2, 1)) == [
        "<pad>",
        "<unk>",
    ]


def test_first_sight_with_large_ids(spark):
    data = [(2**62 + 1, "x y"), (2**62, "y x")]
    df = spark.createDataFrame(data, "id long, text string")
    vocab = vocabulary.build_vocabulary(df, "text", "id", 10, 1)
    assert by_index(vocab)[2:] == ["y", "x"]


def test_encode_and_decode(docs):
    vocab = vocabulary.build_vocabulary(docs, "text", "id", 100, 2)
    encoded = vocabulary.encode(docs, ["id"], "text", vocab, max_length=3)
    assert {r.id: r.token_ids for r in encoded.collect()} == {
        10: [5, 2, 5],
        2: [2, 1, 3],
        3: [3, 4, 4],
        4: [0, 0, 0],
    }
    decoded = vocabulary.decode(encoded, ["id"], vocab)
    assert {r.id: r.tokens for r in decoded.collect()} == {
        10: ["b", "a", "b"],
        2: ["a", "<unk>", "e"],
        3: ["e", "f", "f"],
        4: ["<pad>"] * 3,
    }


def test_masked_mean(spark):
    encoded = spark.createDataFrame(
        [(1, [2, 3, 0, 0]), (2, [0, 0, 0, 0]), (3, [3, 3, 3, 2])],
        "id long, token_ids array<int>",
    )
    vectors = spark.createDataFrame(
        [(0, [9.0, 9.0]), (2, [1.0, 2.0]), (3, [3.0, 6.0])],
        "idx long, embedding array<float>",
    )
    out = vocabulary.masked_mean_pool(encoded, ["id"], vectors, 2)
    assert {(r.id, r.dim): r.mean for r in out.collect()} == {
        (1, 0): 2.0,
        (1, 1): 4.0,
        (2, 0): 0.0,
        (2, 1): 0.0,
        (3, 0): 2.5,
        (3, 1): 5.0,
    }


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame(
        [(1, "red red the car"), (2, "red sky"), (3, "")], "id long, text string"
    )
    out = {
        (r.id, r.term): r.weight for r in features.tfidf(df, "id", "text").collect()
    }
    red = math.log(4 / 3) + 1
    rare = math.log(4 / 2) + 1
    one = {"red": (1 + math.log(2)) * red, "car": rare, "red red": rare, "red car": rare}
    two = {"red": red, "sky": rare, "red sky": rare}
    expected = {}
    for id_, row in ((1, one), (2, two)):
        length = math.sqrt(sum(w * w for w in row.values()))
        expected |= {(id_, t): w / length for t, w in row.items()}
    assert out == pytest.approx(expected)


def test_tfidf_keeps_most_frequent_terms(spark):
    df = spark.createDataFrame(
        [(1, "bb bb aa cc"), (2, "aa dd")], "id long, text string"
    )
    kept = features.tfidf(df, "id", "text", max_features=2, ngram_range=(1, 1))
    assert {r.term for r in kept.collect()} == {"aa", "bb"}


def test_label_index_and_weights(spark):
    df = spark.createDataFrame(
        [("b",)] * 3 + [("a",)] + [(None,)], "label string"
    )
    index = {r.label: r.idx for r in features.label_index(df, "label").collect()}
    assert index == {"a": 0, "b": 1}
    balanced = features.balanced_weights(df, "label").collect()
    assert {r.label: r.weight for r in balanced} == pytest.approx(
        {"a": 4 / 2, "b": 4 / 6}
    )
    inverse = features.inverse_frequency_weights(df, "label").collect()
    assert {r.label: r.weight for r in inverse} == pytest.approx({"a": 1.5, "b": 0.5})


def test_hot_token_is_combined_before_the_shuffle(spark):
    df = spark.range(100).select("id", F.lit("the the the x").alias("text"))
    plan = vocabulary.token_frequency(df, "text")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("HashAggregate") == 2


def test_vocabulary_of_string_ids_and_ties(spark, monkeypatch):
    """Ids of any type; the cut falls into a large tie, ranked by ranges."""
    from civilspark.operators import ranking

    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 7)
    texts = [f"w{k} w{k} common" for k in range(60)] + ["common x", None, ""]
    rows = [(f"id{99 - i:03d}", i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, n int, text string").repartition(5)
    for id_col, order in (("id", lambda r: r[0]), ("n", lambda r: r[1])):
        seen, freq = {}, Counter()
        for row in sorted(rows, key=order):
            for token in (row[2] or "").split():
                seen.setdefault(token, len(seen))
                freq[token] += 1
        want = sorted((t for t in freq if freq[t] >= 2), key=lambda t: (-freq[t], seen[t]))
        for size in (2, 3, 20, 61, 63, 500):
            got = vocabulary.build_vocabulary(df, "text", id_col, max_vocab_size=size, min_freq=2).collect()
            in_order = [r.token for r in sorted(got, key=lambda r: r.idx)]
            assert in_order == ["<pad>", "<unk>", *want[: size - 2]]
            assert [r.idx for r in sorted(got, key=lambda r: r.idx)] == list(range(len(got)))


def test_lookup_beyond_the_broadcast_bound(spark):
    from civilspark.operators.sizes import lookup

    table = spark.createDataFrame([(f"t{i}", i) for i in range(50)], "token string, idx int")
    rows = [(i, f"t{i % 70}" if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, token string")
    want = Counter((i, t, int(t[1:]) if t and int(t[1:]) < 50 else None) for i, t in rows)
    for bound in (1000, 10):
        got = lookup(df, table, "token", "idx", max_rows=bound).select("id", "token", "idx")
        assert Counter(map(tuple, got.collect())) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
