"""Occlusion explanation for any scorer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.functions import scores as S
from civilspark.functions.tokens import whitespace_tokens
from civilspark.operators.scoring import Scorer


def explain_by_occlusion(
    df: DataFrame,
    ids: Sequence[str],
    scorer: Scorer,
    text_col: str = "model_text",
    baseline_col: str = "overall_score",
) -> DataFrame:
    """``ids`` plus ``token_highlights`` for comments already judged toxic.

    Every word is left out once and the variant is scored again.  The fan-out is
    bounded: only comments of 2 to 60 words are taken apart, and the regrouping
    collects at most 60 rows per comment.  Other comments travel along as one row
    with their words unexplained.  The spread by id before scoring puts the
    variants over all tasks and is the partitioning the regrouping needs.
    """
    ids = list(ids)
    words = df.select(
        *ids,
        F.col(baseline_col).alias("_baseline"),
        whitespace_tokens(F.col(text_col)).alias("_words"),
    )
    fits = F.size("_words").between(fixed.EXPLAIN_MIN_WORDS, fixed.EXPLAIN_MAX_WORDS)
    variants = (
        words.select(
            *ids,
            "_baseline",
            F.when(fits, F.col("_words")).alias("_words"),
            F.when(~fits, S.plain_highlights(F.col("_words"))).alias("_plain"),
        )
        .select("*", F.posexplode_outer("_words").alias("_pos", "_word"))
        .select(
            *ids,
            "_baseline",
            "_plain",
            "_pos",
            "_word",
            F.coalesce(
                F.array_join(F.filter("_words", lambda w, i: i != F.col("_pos")), " "),
                F.lit(""),
            ).alias("_variant"),
        )
        .repartition(*ids)
    )
    importance = F.greatest(
        F.lit(0.0), F.col("_baseline") - S.overall_score(F.col("_scores"))
    )
    one = S.highlight(
        F.col("_pos"),
        F.col("_word"),
        F.round("_importance", 4),
        S.is_trigger(F.col("_importance"), F.col("_baseline")),
    )
    return (
        variants.withColumn("_scores", scorer(F.col("_variant")))
        .withColumn("_importance", importance)
        .groupBy(*ids)
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("_pos").isNotNull(), one))
            ).alias("_explained"),
            F.any_value("_plain", True).alias("_plain"),
        )
        .select(*ids, F.coalesce("_plain", "_explained").alias("token_highlights"))
    )
