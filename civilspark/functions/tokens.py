"""Token and n-gram array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civilspark.functions.regex import SPACE, WORD
from civilspark.functions.text import let


def word_tokens(text: Column, min_length: int = 1) -> Column:
    """Lower-case words: maximal runs of word characters."""
    run = f"{WORD}+" if min_length <= 1 else f"{WORD}{{{min_length},}}"
    return F.regexp_extract_all(F.lower(text), F.lit(run), 0)


def whitespace_tokens(text: Column) -> Column:
    """Pieces between whitespace, without empty ones."""
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda t: t != "")


def drop_stop_words(tokens: Column, stop_words) -> Column:
    stop_words = list(stop_words)
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(stop_words))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, joined by one space."""

    def of_size(words: Column, n: int) -> Column:
        grams = words
        for k in range(2, n + 1):
            # Pair every shorter gram with the word after it; the last ones have
            # none and drop out.
            following = F.slice(words, F.lit(k), F.size(words))
            grams = F.filter(
                F.zip_with(grams, following, lambda g, w: F.concat(g, F.lit(" "), w)),
                lambda g: g.isNotNull(),
            )
        return grams

    return let(
        tokens,
        lambda words: F.concat(*[of_size(words, n) for n in range(low, high + 1)]),
    )


def term_counts(terms: Column) -> Column:
    """Distinct terms of one row with their counts: ``array<struct<term, tf>>``.

    Sorting the row's own array groups equal terms, so counting needs no
    shuffle; run starts minus next run starts are the counts.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered,
                lambda term, i: F.when(
                    (i == 0) | (term != F.get(ordered, i - 1)), i + 1
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda s: F.zip_with(
                s,
                F.concat(
                    F.slice(s, F.lit(2), F.size(s)), F.array(F.size(ordered) + 1)
                ),
                lambda a, b: F.struct(
                    ordered[a - 1].alias("term"), (b - a).alias("tf")
                ),
            ),
        )

    return let(
        F.array_sort(terms),
        lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)).otherwise(
            F.array().cast("array<struct<term:string,tf:int>>")
        ),
    )
