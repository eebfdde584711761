import math

import pytest
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.functions import scores as S
from civilspark.functions.tokens import word_tokens
from civilspark.operators import scoring
from civilspark.plans.jobs import explain_comments, moderate

LABELS = fixed.LABELS


def scored(spark, rows):
    """Rows of six scores as a table with ``id`` and ``scores``."""
    df = spark.createDataFrame(
        [(i, *map(float, r)) for i, r in enumerate(rows)],
        "id int, " + ", ".join(f"{c} double" for c in LABELS),
    )
    return df.select("id", scoring.wide_to_scores(df).alias("scores"))


def verdicts(spark, rows, threshold=0.5):
    out = scoring.judge(scored(spark, rows), threshold).collect()
    return sorted(out, key=lambda r: r.id)


#        toxic severe obscene threat insult identity -> grade
LADDER = [
    ((0.14, 0, 0, 0, 0, 0), "Clean (Safe)"),
    ((0.15, 0, 0, 0, 0, 0), "Low / Borderline"),
    ((0.49, 0, 0, 0, 0, 0), "Low / Borderline"),
    ((0.50, 0, 0, 0, 0, 0), "Mild / Elevated Concern"),
    ((0.59, 0, 0, 0, 0, 0), "Mild / Elevated Concern"),
    ((0.60, 0, 0, 0, 0, 0), "Moderate Toxicity"),
    ((0.84, 0, 0, 0, 0, 0), "Moderate Toxicity"),
    ((0.85, 0, 0, 0, 0, 0), "High Toxicity"),
    ((0, 0, 0, 0, 0, 0.64), "Moderate Toxicity"),
    ((0, 0, 0, 0, 0, 0.65), "High Toxicity"),
    ((0, 0.69, 0, 0, 0, 0), "Moderate Toxicity"),
    ((0, 0.70, 0, 0, 0, 0), "Critical Danger (Threat / Severe)"),
    ((0.90, 0, 0, 0.49, 0, 0), "High Toxicity"),
    ((0, 0, 0, 0.50, 0, 0), "Critical Danger (Threat / Severe)"),
    ((0.95, 0, 0, 0.50, 0, 0), "Critical Danger (Threat / Severe)"),
]


def test_severity_ladder(spark):
    out = verdicts(spark, [row for row, _ in LADDER])
    assert [r.severity_level for r in out] == [grade for _, grade in LADDER]


def test_flags_and_primary_category(spark):
    out = verdicts(
        spark,
        [
            (0.7, 0, 0.7, 0, 0.6, 0),
            (0, 0, 0.5, 0, 0.5, 0),
            (0.4, 0, 0, 0.3, 0, 0),
            (0, 0, 0, 0, 0, 0.9),
        ],
    )
    assert [r.flagged_categories for r in out] == [
        ["toxic", "obscene", "insult"],
        ["obscene", "insult"],
        [],
        ["identity_hate"],
    ]
    # Ties go to the earlier label; nothing flagged is clean.
    assert [r.primary_category for r in out] == [
        "Toxicity",
        "Obscenity / Profanity",
        "Clean",
        "Identity Hate Speech",
    ]
    assert [r.overall_score for r in out] == [0.7, 0.5, 0.4, 0.9]
    assert [r.is_toxic for r in out] == [True, True, False, True]


def test_threshold_is_inclusive_and_adjustable(spark):
    row = [(0.3, 0, 0, 0, 0, 0)]
    assert verdicts(spark, row, 0.3)[0].is_toxic
    assert not verdicts(spark, row, 0.31)[0].is_toxic


def test_unknown_label_keeps_its_name(column):
    assert column(S.display_name, ["toxic", "spam"]) == ["Toxicity", "spam"]


def test_argmax_takes_the_first(column):
    assert column(S.argmax_index, [[0.2, 0.5, 0.5], [1.0]], "array<double>") == [1, 0]


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def test_lexicon_by_hand(spark):
    df = spark.createDataFrame([("You IDIOT, idiot!",), ("idiots",)], "text string")
    lexicon = scoring.default_lexicon()
    two, none = (r.s for r in df.select(lexicon(F.col("text")).alias("s")).collect())
    weights = fixed.LEXICON_WEIGHTS["idiot"]
    assert [x.label for x in two] == list(LABELS)
    assert [x.score for x in two] == pytest.approx(
        [sigmoid(fixed.LEXICON_BIAS[c] + 2 * w) for c, w in zip(LABELS, weights)]
    )
    assert [x.score for x in none] == pytest.approx(
        [sigmoid(fixed.LEXICON_BIAS[c]) for c in LABELS]
    )


def test_lexicon_is_checked():
    with pytest.raises(ValueError):
        scoring.Lexicon({"two words": (0.0,) * 6}, {})
    with pytest.raises(ValueError):
        scoring.Lexicon({"a": (0.0,)}, {})


def test_lexicon_of_any_size(spark):
    weights = {f"w{i}": (float(i), 0, 0, 0, 0, 0) for i in range(1000)}
    scores = scoring.Lexicon(weights, {"toxic": -999.0})(F.col("text"))
    df = spark.createDataFrame([("w999 w1000",)], "text string")
    assert df.select(scores.alias("s")).first().s[0].score == 0.5


def test_both_scorers_agree(spark):
    terms = list(fixed.LEXICON_WEIGHTS)
    texts = [" ".join(terms[j] for j in range(10) if i >> j & 1) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    weights = spark.createDataFrame(
        [
            (t, label, w)
            for t, row in fixed.LEXICON_WEIGHTS.items()
            for label, w in zip(LABELS, row)
        ],
        "term string, label string, weight double",
    )
    tokens = df.select(
        "id", F.explode(word_tokens(F.col("text"))).alias("term"), F.lit(1.0).alias("value")
    )
    wide = scoring.linear_scores(df, tokens, weights, fixed.LEXICON_BIAS, ["id"])
    relational = {r.id: [r[c] for c in LABELS] for r in wide.collect()}
    inline = {
        r.id: [x.score for x in r.s]
        for r in df.select("id", scoring.default_lexicon()(F.col("text")).alias("s")).collect()
    }
    assert relational == inline
    assert len(relational) == 200


def test_large_weight_table_joins_without_broadcast_hint(spark, monkeypatch):
    from civilspark.operators import sizes

    big = spark.range(50).select(F.col("id").cast("string").alias("term"))
    assert sizes.broadcast_if_small(big, 49) is big
    assert sizes.broadcast_if_small(big, 50) is not big
    assert sizes.broadcast_if_small(big, 49, as_literals=False) is big
    assert sizes.broadcast_if_small(big, 50, max_bytes=100) is big
    assert sizes.broadcast_if_small(big, 50, as_literals=False, max_bytes=100) is big
    assert sizes.broadcast_if_small(big, 50, as_literals=False, max_bytes=5000) is not big


def test_blank_comments(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "hi")], "id int, text string")
    out = {r.id: r for r in scoring.predict(df, keep=["id"]).collect()}
    for blank in (out[1], out[2], out[3]):
        assert blank.cleaned_text == ""
        assert [s.score for s in blank.scores] == [0.0] * 6
        assert (blank.is_toxic, blank.overall_score) == (False, 0.0)
        assert (blank.primary_category, blank.severity_level) == ("Clean", "Clean (Safe)")
        assert blank.flagged_categories == [] and blank.token_highlights == []
    assert out[1].original_text is None and out[2].original_text == ""
    assert out[4].overall_score > 0
    assert [f for f in scoring.predict(df).columns] == list(scoring.PREDICTION_FIELDS)
    assert moderate(df, "text", keep=["id"]).count() == 1


@pytest.fixture(scope="module")
def comments(spark):
    words = ["you"] * 58
    data = [
        (1, "you are an id1ot and a l0ser"),
        (2, "idiot"),
        (3, " ".join(["idiot", "moron", *words])),
        (4, " ".join(["idiot", "moron", "scum", *words])),
        (5, "a nice day"),
        (6, "idiot idiot-moron, b!tch"),
        (7, "scum scum"),
        (8, "clown trash"),
    ]
    return spark.createDataFrame(data, "id long, text string")


def test_occlusion_paths_agree(comments):
    lexicon = scoring.default_lexicon()
    general = {
        r.id: r.token_highlights
        for r in explain_comments(comments, ["id"], "text", lexicon).collect()
    }
    inline = {
        r.id: r.token_highlights
        for r in scoring.predict(comments, scorer=lexicon, keep=["id"]).collect()
        if r.is_toxic
    }
    assert set(general) == set(inline) == {1, 2, 3, 4, 6, 7, 8}
    for id_, highlights in general.items():
        assert [tuple(h) for h in highlights] == [tuple(h) for h in inline[id_]]


def test_occlusion_rules(comments):
    out = {r.id: r.token_highlights for r in scoring.predict(comments, keep=["id"]).collect()}
    assert [h.word for h in out[1]] == "you are an idiot and a loser".split()
    # One word, or more than sixty: words only.
    assert [tuple(h) for h in out[2]] == [(0, "idiot", 0.0, False)]
    assert len(out[4]) == 61 and not any(h.is_toxic_token for h in out[4])
    # Exactly sixty words are explained.
    assert len(out[3]) == 60
    assert out[5] == []
    # Two equal words: what remains without one of them.
    bias, weight = fixed.LEXICON_BIAS["toxic"], fixed.LEXICON_WEIGHTS["scum"][0]
    bias_i, weight_i = fixed.LEXICON_BIAS["insult"], fixed.LEXICON_WEIGHTS["scum"][4]
    both = max(sigmoid(bias + 2 * weight), sigmoid(bias_i + 2 * weight_i))
    single = max(sigmoid(bias + weight), sigmoid(bias_i + weight_i))
    assert [h.importance for h in out[7]] == [round(both - single, 4)] * 2


def test_trigger_rule(spark):
    df = spark.createDataFrame(
        [(0.15, 0.5), (0.149, 0.9), (0.08, 0.71), (0.08, 0.7), (0.079, 0.9)],
        "importance double, baseline double",
    )
    out = df.select(S.is_trigger(F.col("importance"), F.col("baseline")).alias("x"))
    assert [r.x for r in out.collect()] == [True, True, True, False, False]


def test_trigger_words(comments):
    out = scoring.predict(comments, keep=["id"]).where("id = 6").select(
        S.trigger_words(F.col("token_highlights")).alias("w")
    )
    # Without the double word one "idiot" is left; without the single one, two hits.
    assert out.first().w == "idiot-moron,"
    other = scoring.predict(
        comments.sparkSession.createDataFrame([("you idiot go home",)], "text string")
    ).select(S.trigger_words(F.col("token_highlights")).alias("w"))
    assert other.first().w == "idiot"


def test_breakdown_report_and_summary(spark, comments):
    records = scoring.predict_batch(comments, keep=["id"])
    breakdown = scoring.category_breakdown(records, ["id"])
    assert breakdown.count() == 8 * 6
    first = breakdown.where("id = 2 and label = 'insult'").first()
    assert (first.category, first.flag) == ("Insult / Harassment", "FLAGGED")
    report = scoring.batch_report(records)
    assert report.columns == [
        "Comment", "Status", "Primary Category", "Severity", "Confidence (%)",
        "Toxicity", "Severe Toxic", "Obscene", "Threat", "Insult", "Identity Hate",
    ]
    assert tuple(scoring.batch_summary(records).first()) == (8, 1, 12.5, 7, 87.5)
    assert tuple(scoring.batch_summary(records.limit(0)).first()) == (0, 0, 0.0, 0, 0.0)


def test_threshold_sweep(spark):
    df = scored(spark, [(0.1, 0, 0, 0, 0, 0), (0.5, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0.92)])
    out = {r.threshold: (r.toxic_count, r.clean_count) for r in scoring.threshold_sweep(df).collect()}
    assert len(out) == 17
    assert out[0.1] == (3, 0) and out[0.5] == (2, 1) and out[0.9] == (1, 2)


def test_samples(spark):
    rows = [(1, "What a wonderful garden you grew!"), (2, "Such a p4thetic l0ser, an 1diot")]
    records = scoring.predict(
        spark.createDataFrame(rows, "id int, comment string"), "comment", keep=["id"]
    )
    out = {r.id: r for r in records.collect()}
    assert not out[1].is_toxic and out[2].is_toxic
    # a token that starts with a digit is no word to decode
    assert out[2].cleaned_text == "such a pathetic loser, an 1diot"


def test_network_scorer(spark, comments):
    def load():
        import numpy as np

        def run(texts):
            hit = np.array([[1.0 if "idiot" in t else 0.0] for t in texts])
            return hit * np.array([[0.9, 0.1, 0.2, 0.0, 0.8, 0.1]])

        return run

    scorer = scoring.network_scorer(load)
    out = {
        r.id: r
        for r in scoring.predict_batch(comments, scorer=scorer, keep=["id"]).collect()
    }
    assert out[1].flagged_categories == ["toxic", "insult"]
    assert out[5].primary_category == "Clean"
    highlights = explain_comments(comments.where("id = 1"), ["id"], "text", scorer)
    words = {h.word: h for h in highlights.first().token_highlights}
    assert words["idiot"].is_toxic_token and words["idiot"].importance == 0.9
    assert words["you"].importance == 0.0


def test_scoring_shuffles_nothing(comments):
    plan = scoring.predict(comments)._jdf.queryExecution().toString()
    assert "Exchange" not in plan[plan.index("== Physical Plan ==") :]


def test_filter_on_verdict_scores_once(comments):
    toxic = scoring.predict_batch(comments, keep=["id"]).where("is_toxic")
    flags = toxic.select(F.explode("flagged_categories"))
    for df in (toxic, flags):
        plan = df._jdf.queryExecution().toString()
        assert plan[plan.index("== Physical Plan ==") :].count("ArrowEvalPython") == 1
