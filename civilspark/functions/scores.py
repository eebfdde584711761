"""Moderation semantics over an ordered score array.

Scores are ``array<struct<label, score>>`` in label order, so ties resolve to
the earlier label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.functions.text import let


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def score_array(labels: Sequence[str], values: Column) -> Column:
    """Pair an array of doubles with its labels."""
    return F.zip_with(
        F.array(*[F.lit(label) for label in labels]),
        values,
        lambda label, value: F.struct(label.alias("label"), value.alias("score")),
    )


def zero_scores(labels: Sequence[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(0.0).alias("score"))
            for label in labels
        ]
    )


def score_of(scores: Column, label: str) -> Column:
    """Score of one label, 0 when the label is not scored."""
    by_label = F.map_from_entries(scores)
    return F.coalesce(F.try_element_at(by_label, F.lit(label)), F.lit(0.0))


def overall_score(scores: Column) -> Column:
    return F.coalesce(
        F.array_max(F.transform(scores, lambda s: s["score"])), F.lit(0.0)
    )


def flagged_categories(scores: Column, threshold: float | Column) -> Column:
    cutoff = F.lit(threshold)
    return F.transform(
        F.filter(scores, lambda s: s["score"] >= cutoff), lambda s: s["label"]
    )


def is_toxic(scores: Column, threshold: float | Column) -> Column:
    cutoff = F.lit(threshold)
    return F.exists(scores, lambda s: s["score"] >= cutoff)


def argmax_index(values: Column) -> Column:
    """0-based position of the maximum, the first one on ties."""
    return let(values, lambda v: F.array_position(v, F.array_max(v)) - 1)


def display_name(label: Column) -> Column:
    """Display name of a category, the raw label when unknown."""
    pairs = [
        F.lit(item) for key, meta in fixed.CATEGORIES.items() for item in (key, meta[0])
    ]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label)


def primary_category(scores: Column, threshold: float | Column) -> Column:
    """Display name of the best flagged label, ``Clean`` when none is."""
    best = F.filter(
        scores,
        lambda s: s["score"] == F.array_max(F.transform(scores, lambda x: x["score"])),
    )
    return F.when(
        is_toxic(scores, threshold), display_name(best[0]["label"])
    ).otherwise(F.lit(fixed.CLEAN_CATEGORY))


def severity_level(scores: Column, toxic: Column) -> Column:
    """Severity grade; the first matching rung of the ladder wins."""
    top = overall_score(scores)
    critical = (score_of(scores, "threat") >= fixed.CRITICAL_THREAT) | (
        score_of(scores, "severe_toxic") >= fixed.CRITICAL_SEVERE
    )
    high = (top >= fixed.HIGH_ANY) | (
        score_of(scores, "identity_hate") >= fixed.HIGH_IDENTITY
    )
    return (
        F.when(~toxic & (top < fixed.CLEAN_BELOW), fixed.SEVERITY_CLEAN)
        .when(~toxic, fixed.SEVERITY_LOW)
        .when(critical, fixed.SEVERITY_CRITICAL)
        .when(high, fixed.SEVERITY_HIGH)
        .when(top >= fixed.MODERATE_ANY, fixed.SEVERITY_MODERATE)
        .otherwise(fixed.SEVERITY_MILD)
    )


def is_trigger(importance: Column, baseline: Column) -> Column:
    """Whether a word is highlighted, from its unrounded importance."""
    return (importance >= fixed.TRIGGER_IMPORTANCE) | (
        (importance >= fixed.TRIGGER_IMPORTANCE_CONFIDENT)
        & (baseline > fixed.CONFIDENT_BASELINE)
    )


def highlight(pos: Column, word: Column, importance: Column, trigger: Column) -> Column:
    return F.struct(
        pos.cast("int").alias("pos"),
        word.alias("word"),
        importance.cast("double").alias("importance"),
        trigger.alias("is_toxic_token"),
    )


def plain_highlights(words: Column) -> Column:
    """Words of a comment that is too short or too long to explain."""
    return F.transform(
        words, lambda w, i: highlight(i, w, F.lit(0.0), F.lit(False))
    )


def trigger_words(highlights: Column) -> Column:
    """Highlighted words joined by a comma."""
    return F.array_join(
        F.transform(
            F.filter(highlights, lambda h: h["is_toxic_token"]), lambda h: h["word"]
        ),
        ", ",
    )
