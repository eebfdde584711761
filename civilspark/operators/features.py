"""TF-IDF in relational form, label indices, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civilspark import fixed_values as fixed
from civilspark.functions.tokens import (
    drop_stop_words,
    ngrams,
    term_counts,
    word_tokens,
)
from civilspark.operators.sizes import MAX_BROADCAST_ROWS


def ngram_terms(
    text: Column,
    ngram_range: tuple[int, int] = fixed.TFIDF_NGRAM_RANGE,
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> Column:
    """Terms of a text: words of two characters or more, stop words removed
    first, then joined to n-grams."""
    words = drop_stop_words(word_tokens(text, min_length=2), stop_words)
    return ngrams(words, *ngram_range)


def ngram_counts(
    df: DataFrame,
    text_col: str,
    ngram_range: tuple[int, int] = (2, 2),
    stop_words: Sequence[str] = tuple(fixed.STOP_WORDS),
) -> DataFrame:
    return (
        df.select(
            F.explode(ngram_terms(F.col(text_col), ngram_range, stop_words)).alias("term")
        )
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def term_occurrences(df: DataFrame, keep: Sequence[str], text_col: str, **terms) -> DataFrame:
    """``(keep..., term, tf, distinct)``: a row per occurrence of a term, with ``tf`` 1, and
    one per distinct term of each document, with ``tf`` 0 and ``distinct`` true.

    Statistics of terms need no count within the document, so its terms are only laid out
    twice, which costs less than counting them in the row.
    """
    found = df.select(*keep, ngram_terms(F.col(text_col), **terms).alias("_terms"))
    laid_out = F.posexplode(F.concat("_terms", F.array_distinct("_terms")))
    return found.select(
        *keep, F.size("_terms").alias("_n"), laid_out.alias("_pos", "term")
    ).select(
        *keep,
        "term",
        (F.col("_pos") < F.col("_n")).cast("int").alias("tf"),
        (F.col("_pos") >= F.col("_n")).alias("distinct"),
    )


def document_terms(df: DataFrame, id_col: str, text_col: str, **terms) -> DataFrame:
    """``(id, term, tf)``, counted inside the row: no shuffle."""
    return df.select(
        id_col, F.inline(term_counts(ngram_terms(F.col(text_col), **terms)))
    )


def tfidf_vocabulary(
    rows: DataFrame, n_docs: DataFrame, max_features: int = fixed.TFIDF_MAX_FEATURES
) -> DataFrame:
    """``(term, df, idf)`` of the most frequent terms, ties alphabetical.

    ``rows`` are ``term_occurrences`` or ``document_terms``; ``n_docs`` is a table of one
    row and column: the number of documents.
    """
    one = F.count_if("distinct") if "distinct" in rows.columns else F.count(F.lit(1))
    top = (
        rows.groupBy("term")
        .agg(F.sum("tf").alias("_total"), one.alias("df"))
        .orderBy(F.desc("_total"), F.asc("term"))
        .limit(max_features)
    )
    idf = F.log((1.0 + n_docs.scalar()) / (1.0 + F.col("df"))) + 1.0
    return top.select("term", "df", idf.alias("idf"))


def tfidf(
    df: DataFrame,
    id_col: str,
    text_col: str,
    max_features: int = fixed.TFIDF_MAX_FEATURES,
    **terms,
) -> DataFrame:
    """``(id, term, weight)``: sublinear tf, smoothed idf, rows of length 1.

    First pass: term statistics, combined map-side.  Second pass: terms are counted inside
    the row, and those outside the vocabulary are dropped by a
    broadcast join (safe, since the vocabulary is limited to ``max_features``); only
    the distinct terms of a document that are left move, once, for its length.
    """
    n_docs = df.agg(F.count(F.lit(1)).alias("n_docs"))
    kept = tfidf_vocabulary(
        term_occurrences(df, [], text_col, **terms), n_docs, max_features
    ).select("term", "idf")
    if max_features <= MAX_BROADCAST_ROWS:
        kept = F.broadcast(kept)
    raw = document_terms(df, id_col, text_col, **terms).join(kept, "term").select(
        id_col, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("_w")
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("_w") / length).alias("weight"))


def label_index(df: DataFrame, label_col: str) -> DataFrame:
    """``(label, idx)``, alphabetical from 0; the window sees one row per class."""
    classes = df.where(F.col(label_col).isNotNull()).select(label_col).distinct()
    return classes.select(
        label_col,
        (F.row_number().over(Window.orderBy(label_col)) - 1).alias("idx"),
    )


def _class_counts(df: DataFrame, label_col: str) -> DataFrame:
    return (
        df.where(F.col(label_col).isNotNull())
        .groupBy(label_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def balanced_weights(df: DataFrame, label_col: str) -> DataFrame:
    """``(label, n, weight)`` with weight = total / (classes * n)."""
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    classes = F.count(F.lit(1)).over(everything)
    return _class_counts(df, label_col).select(
        label_col, "n", (total / (classes * F.col("n"))).alias("weight")
    )


def inverse_frequency_weights(df: DataFrame, label_col: str) -> DataFrame:
    """``(label, n, weight)`` with weight ~ 1/n, summing to the class count."""
    everything = Window.partitionBy()
    inverse = 1.0 / F.col("n")
    return _class_counts(df, label_col).select(
        label_col,
        "n",
        (
            inverse / F.sum(inverse).over(everything) * F.count(F.lit(1)).over(everything)
        ).alias("weight"),
    )
