"""Fitted heads as scorer and explanation, against rescoring every variant."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.operators import features, heads, models, scoring
from civilspark.plans import jobs

LABELS = ("toxic", "insult")
WORDS = "you are the worst kind of fool idiot friend garden nice day stupid-head a I no! ... thanks".split()


def terms_of(text):
    kept = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in fixed.STOP_WORDS]
    return Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])


def brute_scores(text, table, bias):
    values = {t: (1 + math.log(n)) * table[t][0] for t, n in terms_of(text).items() if t in table}
    length = math.sqrt(sum(v * v for v in values.values()))
    out = []
    for k, label in enumerate(LABELS):
        z = sum(v * table[t][1][k] for t, v in values.items())
        out.append(1 / (1 + math.exp(-(bias[label] + (z / length if length else 0.0)))))
    return out


def brute_highlights(text, table, bias):
    words, base = text.split(), max(brute_scores(text, table, bias))
    out = []
    for i, word in enumerate(words):
        importance = 0.0
        if 2 <= len(words) <= 60:
            rest = " ".join(words[:i] + words[i + 1 :])
            importance = max(0.0, base - max(brute_scores(rest, table, bias)))
        trigger = importance >= 0.15 or (importance >= 0.08 and base > 0.7)
        out.append((i, word, round(importance, 4), trigger))
    return out


def comments_of(seed=3):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 14))) for _ in range(60)]
    texts += ["idiot", "idiot idiot", "fool " * 60, "fool " * 61, "... !!", "", "  ", "unknown words only"]
    return [*enumerate(texts), (99, None)]


def log_odds_heads(spark):
    rng = random.Random(9)
    rows = []
    for i, text in comments_of(4):
        bad = bool(text) and "idiot" in text
        rows.append((i, text, int(bad), rng.choice([int(bad), None])))
    df = spark.createDataFrame(rows, "id int, text string, toxic int, insult int")
    return heads.fit_log_odds(df, "text", LABELS, max_features=200)


def logistic_heads(spark):
    """The heads that ``models.fit_binary_heads`` fits."""
    rows = []
    for i, text in comments_of(4):
        bad = bool(text) and "idiot" in text
        rows.append((i, text or "", int(bad), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "id int, text string, toxic int, insult int")
    tfidf = models.fit_tfidf(df)
    weights, bias = models.fit_binary_heads(models.add_features(tfidf, df), LABELS, models.tfidf_terms(tfidf))
    counted = features.document_terms(df, "id", "text")
    idf = features.tfidf_vocabulary(counted, df.agg(F.count(F.lit(1))))
    return heads.heads_from_weights(idf.select("term", "idf"), weights, bias, LABELS)


@pytest.mark.parametrize("fit", [log_odds_heads, logistic_heads])
def test_records_and_highlights(spark, fit):
    fitted = fit(spark)
    table = {r.term: (r.idf, [r[l] for l in LABELS]) for r in fitted.table.collect()}
    comments = spark.createDataFrame(comments_of(), "id int, text string")
    got = {r.id: r for r in jobs.explained_records(comments, ["id"], "text", fitted).collect()}
    assert len(got) == len(comments_of())
    toxic = 0
    for i, text in comments_of():
        row = got[i]
        if not (text or "").strip():
            assert not row.is_toxic and row.overall_score == 0.0 and row.token_highlights == []
            continue
        text = " ".join(row.cleaned_text.split())
        want = brute_scores(text, table, fitted.bias)
        assert [s.score for s in row.scores] == pytest.approx(want, abs=1e-12)
        assert [s.label for s in row.scores] == list(LABELS)
        assert row.is_toxic == (max(want) >= 0.5)
        if row.is_toxic:
            toxic += 1
            shown = [tuple(h) for h in row.token_highlights]
            expected = brute_highlights(text, table, fitted.bias)
            assert [h[:2] for h in shown] == [h[:2] for h in expected]
            assert [h[2] for h in shown] == pytest.approx([h[2] for h in expected], abs=1.01e-4)
            assert [h[3] for h in shown] == [h[3] for h in expected]
        else:
            assert row.token_highlights == []
    assert 5 < toxic < 60


def test_scoring_by_heads_shuffles_nothing(spark):
    comments = spark.createDataFrame(comments_of(), "id int, text string")
    records = scoring.predict(comments, "text", log_odds_heads(spark), keep=["id"])
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_heads_without_terms(spark):
    none = spark.createDataFrame([], "id int, text string, toxic int, insult int")
    fitted = heads.fit_log_odds(none, "text", LABELS)
    comments = spark.createDataFrame([(1, "some text")], "id int, text string")
    (row,) = jobs.explained_records(comments, ["id"], "text", fitted).collect()
    assert [s.score for s in row.scores] == [0.5, 0.5] and row.is_toxic
    assert [(h.word, h.importance) for h in row.token_highlights] == [("some", 0.0), ("text", 0.0)]


def test_default_needs_no_lexicon(spark):
    comments = spark.createDataFrame([(1, "x")], "id int, text string")
    scorer = lambda text: F.array(F.struct(F.lit("toxic").alias("label"), F.lit(0.9).alias("score")))
    (row,) = scoring.predict(comments, "text", scorer, keep=["id"], labels=["toxic"]).collect()
    assert row.is_toxic and row.token_highlights == []
    with pytest.raises(ValueError):
        scoring.predict(comments, "text", scorer, highlight_tokens=True)


def test_term_statistics_without_counts_per_document(spark):
    """Occurrences give the statistics that terms counted in each document give."""
    rows = [(1, "bad bad idiot bad"), (2, None), (3, ""), (4, "the idiot said bad things"), (1, "bad bad")]
    df = spark.createDataFrame(rows, "id int, text string")
    counted = features.document_terms(df, "id", "text").groupBy("term").agg(
        F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")
    )
    spread = features.term_occurrences(df, ["id"], "text").groupBy("term").agg(
        F.sum("tf").alias("total"), F.count_if("distinct").alias("df")
    )
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, counted.collect()))
    n_docs = df.agg(F.count(F.lit(1)))
    both = [
        [tuple(r) for r in features.tfidf_vocabulary(rows, n_docs, 3).collect()]
        for rows in (features.document_terms(df, "id", "text"), features.term_occurrences(df, [], "text"))
    ]
    assert both[0] == both[1] and len(both[0]) == 3
