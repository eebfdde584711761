"""Fitted linear heads as scorer of record, with their explanation.

A head is a weight per TF-IDF term and a bias; several heads share one vocabulary, which
is a table ``(term, idf, <one column per label>)`` of at most ``max_features`` rows.

* Scoring is a projection: terms are counted against the vocabulary in the JVM, and the
  weights stand in the expression as constants.  Nothing is shuffled.
* Explaining leaves out one word after the other without building variant texts.  Leaving
  a word out removes its terms and the n-grams across it, and joins its neighbours; only
  these terms change their count.  They meet the weights in one join, and each variant's
  logit follows from what they change in the document's weighted sum and length.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.functions import scores as S
from civilspark.functions.text import let
from civilspark.functions.tokens import (
    drop_stop_words,
    ngrams,
    whitespace_tokens,
    word_tokens,
)
from civilspark.operators.features import ngram_terms, term_occurrences
from civilspark.operators.sizes import broadcast_if_small
from civilspark.session import materialise

# A known term weighs 1 at least (idf >= 1, tf >= 1); a squared length below this is none.
NO_TERMS = 0.5


def _constant(values: Sequence[float]) -> Column:
    """An array of doubles that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


@dataclass(frozen=True)
class LinearHeads:
    """``table`` has ``term``, ``idf`` and a weight column per label."""

    table: DataFrame
    bias: Mapping[str, float]
    labels: Sequence[str]
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS)

    def add_scores(self, df: DataFrame, text_col: str, name: str) -> DataFrame:
        """Add ``array<struct<label, score>>``; the vocabulary is collected, which is small."""
        rows = self.table.select("term", "idf", *self.labels).collect()
        if not rows:
            flat = [S.sigmoid(F.lit(float(self.bias[label]))) for label in self.labels]
            return df.withColumn(name, S.score_array(self.labels, F.array(*flat)))
        counter = CountVectorizerModel.from_vocabulary(
            [r.term for r in rows], inputCol="_terms", outputCol="_counts"
        )
        terms = ngram_terms(F.col(text_col), stop_words=self.stop_words)
        counted = counter.transform(df.withColumn("_terms", terms))
        idf = _constant([float(r.idf) for r in rows])
        weights = [_constant([float(r[label]) for r in rows]) for label in self.labels]

        def total(values: Column) -> Column:
            return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

        def times(weight: Column):
            return lambda i, a: a * F.get(weight, i)

        def logits(v: Column) -> Column:
            values = F.zip_with(
                v["indices"], v["values"], lambda i, n: (1.0 + F.log(n)) * F.get(idf, i)
            )

            def from_values(x: Column) -> Column:
                length = F.sqrt(total(F.transform(x, lambda a: a * a)))
                sums = [total(F.zip_with(v["indices"], x, times(w))) for w in weights]
                return let(
                    length,
                    lambda n: F.array(
                        *[
                            _probability(s, n, self.bias[label])
                            for s, label in zip(sums, self.labels)
                        ]
                    ),
                )

            return let(values, from_values)

        scored = counted.withColumn(
            name, S.score_array(self.labels, let(F.unwrap_udt("_counts"), logits))
        )
        return scored.drop("_terms", "_counts")


def _probability(weighted: Column, length: Column, bias: float) -> Column:
    return S.sigmoid(
        F.lit(float(bias)) + F.when(length > 0, weighted / length).otherwise(F.lit(0.0))
    )


def heads_from_weights(
    idf: DataFrame, weights: DataFrame, bias: Mapping[str, float], labels: Sequence[str]
) -> LinearHeads:
    """Heads of fitted weights ``(label, term, weight)`` and ``idf(term, idf)``."""
    wide = weights.groupBy("term").agg(
        *[F.sum(F.when(F.col("label") == l, F.col("weight"))).alias(l) for l in labels]
    )
    table = idf.join(wide, "term", "left").select(
        "term", "idf", *[F.coalesce(l, F.lit(0.0)).alias(l) for l in labels]
    )
    return LinearHeads(materialise(table, "heads"), bias, tuple(labels))


def fit_log_odds(
    labelled: DataFrame,
    text_col: str,
    labels: Sequence[str],
    max_features: int = fixed.TFIDF_MAX_FEATURES,
) -> LinearHeads:
    """Heads whose weights are log odds of a term between the two classes.

    Each term has one more document, shared by the classes like all documents, so the
    weights of rare terms are near 0.
    ``labels`` are columns of 0 and 1; rows without a label do not count for its head.  One
    aggregation by term, combined map-side, gives vocabulary, idf and all weights.
    """
    terms = term_occurrences(labelled, labels, text_col)
    n_docs = labelled.agg(F.count(F.lit(1)).alias("n_docs"))
    per_term = terms.groupBy("term").agg(
        F.sum("tf").alias("total"),
        F.count_if("distinct").alias("df"),
        *[F.count_if(F.col("distinct") & (F.col(l) == 1)).alias(f"_pos_{l}") for l in labels],
        *[F.count_if(F.col("distinct") & (F.col(l) == 0)).alias(f"_neg_{l}") for l in labels],
    )
    top = per_term.orderBy(F.desc("total"), "term").limit(max_features)
    sizes = labelled.agg(
        *[F.count_if(F.col(l) == 1).alias(f"pos_{l}") for l in labels],
        *[F.count_if(F.col(l) == 0).alias(f"neg_{l}") for l in labels],
    ).first()

    prior = {}
    for label in labels:
        positive, negative = sizes[f"pos_{label}"], sizes[f"neg_{label}"]
        prior[label] = (positive + 1.0) / (positive + negative + 2.0)

    def odds(label: str) -> Column:
        p = prior[label]
        own = (F.col(f"_pos_{label}") + p) / (F.col(f"_neg_{label}") + (1.0 - p))
        return F.log(own) - math.log(p / (1.0 - p))

    idf = F.log((1.0 + n_docs.scalar()) / (1.0 + F.col("df"))) + 1.0
    table = top.select("term", idf.alias("idf"), *[odds(l).alias(l) for l in labels])
    bias = {label: math.log(p / (1.0 - p)) for label, p in prior.items()}
    return LinearHeads(materialise(table, "heads"), bias, tuple(labels))


def _count(terms: Column, term: Column) -> Column:
    return F.size(F.filter(terms, lambda t: t == term))


def _changes(kept: Column) -> Column:
    """``array<struct<variant, term, before, after>>`` of a comment.

    ``kept`` has the kept tokens of each word.  Variant -1 is the whole comment, built up
    from nothing; variant i are the terms that change when word i is left out.
    """

    def of_terms(terms: Column) -> Column:
        whole = F.transform(
            F.array_distinct(terms),
            lambda t: F.struct(
                F.lit(-1).alias("variant"),
                t.alias("term"),
                F.lit(0).alias("before"),
                _count(terms, t).alias("after"),
            ),
        )

        def of_word(own: Column, i: Column) -> Column:
            none = F.array().cast("array<string>")
            ahead = F.slice(F.flatten(F.slice(kept, F.lit(1), i)), -1, 1)
            ahead = F.when(F.size(F.flatten(F.slice(kept, F.lit(1), i))) > 0, ahead)
            behind = F.slice(F.flatten(F.slice(kept, i + 2, F.size(kept))), 1, 1)
            joined = F.concat(F.coalesce(ahead, none), behind)

            def touched(gone: Column) -> Column:
                made = F.when(F.size(joined) == 2, F.array(F.array_join(joined, " "))).otherwise(none)
                return F.transform(
                    F.array_distinct(F.concat(gone, made)),
                    lambda t: F.struct(
                        i.alias("variant"),
                        t.alias("term"),
                        _count(terms, t).alias("before"),
                        (_count(terms, t) - _count(gone, t) + _count(made, t)).alias("after"),
                    ),
                )

            around = F.concat(F.coalesce(ahead, none), own, behind)
            gone = F.concat(own, ngrams(around, 2, 2))
            nothing = F.array().cast("array<struct<variant:int,term:string,before:int,after:int>>")
            return F.when(F.size(own) > 0, let(gone, touched)).otherwise(nothing)

        return F.concat(whole, F.flatten(F.transform(kept, of_word)))

    return let(ngrams(F.flatten(kept), *fixed.TFIDF_NGRAM_RANGE), of_terms)


def explain(
    df: DataFrame,
    ids: Sequence[str],
    heads: LinearHeads,
    text_col: str = "model_text",
    baseline_col: str = "overall_score",
) -> DataFrame:
    """``ids`` plus ``token_highlights`` for comments already judged toxic.

    A comment of 2 to 60 words makes a few rows per word; they are joined to the weights
    (broadcast when small), added up per word and per comment, and meet the words again on
    the id.  Other comments keep their words unexplained.  Ids must be unique.
    """
    ids, labels = list(ids), list(heads.labels)
    words = whitespace_tokens(F.col(text_col))
    base = df.select(*ids, F.col(baseline_col).alias("_baseline"), words.alias("_words"))
    fits = F.size("_words").between(fixed.EXPLAIN_MIN_WORDS, fixed.EXPLAIN_MAX_WORDS)
    kept = F.transform(
        "_words", lambda w: drop_stop_words(word_tokens(w, min_length=2), heads.stop_words)
    )
    rows = (
        base.where(fits)
        .select(*ids, kept.alias("_kept"))
        .select(*ids, F.inline(_changes(F.col("_kept"))))
    )
    tf = lambda n: F.when(F.col(n) > 0, 1.0 + F.log(F.col(n))).otherwise(F.lit(0.0))
    change, squares = tf("after") - tf("before"), tf("after") * tf("after") - tf("before") * tf("before")
    moved = rows.join(broadcast_if_small(heads.table), "term").groupBy(*ids, "variant").agg(
        F.sum(squares * F.col("idf") * F.col("idf")).alias("_q"),
        *[F.sum(change * F.col("idf") * F.col(l)).alias(f"_s{k}") for k, l in enumerate(labels)],
    )
    sums = F.struct("_q", *[f"_s{k}" for k in range(len(labels))])
    per_comment = moved.groupBy(*ids).agg(
        F.any_value(F.when(F.col("variant") < 0, sums), True).alias("_whole"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("variant") >= 0, F.struct("variant", sums)))
        ).alias("_moved"),
    )

    def without(i: Column) -> Column:
        """Best score of the comment without word i."""

        def best(d: Column) -> Column:
            whole = F.col("_whole")
            square = whole["_q"] + F.coalesce(d["_q"], F.lit(0.0))
            length = F.when(square > NO_TERMS, F.sqrt(square)).otherwise(F.lit(0.0))
            return F.greatest(
                F.lit(0.0),
                *[
                    _probability(
                        whole[f"_s{k}"] + F.coalesce(d[f"_s{k}"], F.lit(0.0)), length, heads.bias[l]
                    )
                    for k, l in enumerate(labels)
                ],
            )

        return let(F.try_element_at(F.col("_moved"), i), best)

    def one(word: Column, i: Column) -> Column:
        known = F.when(F.col("_whole").isNotNull(), F.col("_baseline") - without(i))
        importance = F.greatest(F.lit(0.0), F.coalesce(known, F.lit(0.0)))
        return let(
            importance,
            lambda x: S.highlight(i, word, F.round(x, 4), S.is_trigger(x, F.col("_baseline"))),
        )

    explained = F.when(fits, F.transform("_words", one)).otherwise(
        S.plain_highlights(F.col("_words"))
    )
    return base.join(per_comment, ids, "left").select(*ids, explained.alias("token_highlights"))
