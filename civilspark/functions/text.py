"""Text normalisation, Column in, Column out.

Each step refers to its input once (``let`` binds it where a step needs it more
often), so composing the steps keeps the expression tree linear in size.  Only
``fold_unicode`` crosses into Python, and only for the rows that need it: characters that
fold to one or none, and the usual entities, are handled by tables in the JVM.  Steps
that most texts do not need are guarded by a plain substring search.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from civilspark.fixed_values import (
    LEET_LETTERS,
    LEET_WORD_PATTERN,
    MENTION_PATTERN,
    MENTION_PLACEHOLDER,
    REPEAT_PATTERN,
    URL_PATTERN,
    URL_PLACEHOLDER,
)
from civilspark.functions.regex import NOT_SPACE, SPACE, WORD, java_pattern

_URL = java_pattern(URL_PATTERN)
_MENTION = java_pattern(MENTION_PATTERN)
# Every leet word starts with a letter at a word boundary; saying so first lets
# the engine leave most positions after one look.
_LEET_WORD = f"(?=[a-z])(?<!{WORD})(?:{java_pattern(LEET_WORD_PATTERN)})"
# What a word needs to be changed at all: a digit after a letter, or symbols
# between a letter and a further word character.
_LEET_HINT = f"[a-z](?:[0-9]|[!@*$+]+{WORD})"
# A text without any of these has no such word, which one class tells sooner.
_LEET_SIGNS = "[0-9!@*$+]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: Column) -> Column:
    """Missing text becomes the empty string, other types their string form."""
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for missing, empty and whitespace-only text."""
    return ~text_or_empty(text).rlike(NOT_SPACE)


def has_min_length(text: Column, length: int) -> Column:
    """Whether the stripped text has at least ``length`` characters.

    The match is lazy: it stops after the first few characters instead of
    building a stripped copy of a long text.  Missing text gives NULL.
    """
    if length <= 1:
        return text.rlike(NOT_SPACE) if length == 1 else text.isNotNull()
    return text.rlike(f"(?s){NOT_SPACE}.{{{length - 2},}}?{NOT_SPACE}")


def _as_ranges(codes: list[int], form: str) -> str:
    """Ascending code points as ranges for a character class."""
    ranges: list[list[int]] = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(f"{form.format(a)}-{form.format(b)}" for a, b in ranges)


@cache
def _combining_class() -> str:
    """Character class of all combining marks."""
    marks = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    return f"[{_as_ranges(marks, '\\U{:08x}')}]+"


@cache
def _fold_udf():
    marks_pattern = _combining_class()

    # Nested on purpose: shipped to the workers by value, so executors need no
    # copy of this package.
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import html
        import re
        import unicodedata

        import pandas

        marks = re.compile(marks_pattern)

        def fold_one(text):
            if text is None:
                return None
            text = html.unescape(text)
            if text.isascii():
                return text
            return marks.sub("", unicodedata.normalize("NFKD", text))

        for batch in batches:
            yield pandas.Series([fold_one(t) for t in batch], dtype=object)

    return F.pandas_udf(fold, StringType())


# Entities that are decoded in the JVM; the ampersand is the last one to be decoded.
USUAL_ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "#39": "'",
    "#x27": "'",
    "nbsp": "\u00a0",
    "copy": "\u00a9",
    "reg": "\u00ae",
    "middot": "\u00b7",
    "mdash": "\u2014",
    "ndash": "\u2013",
    "lsquo": "\u2018",
    "rsquo": "\u2019",
    "ldquo": "\u201c",
    "rdquo": "\u201d",
    "euro": "\u20ac",
    "amp": "&",
}
# Frequent characters that fold to several; all others of that kind go to Python.
USUAL_EXPANSIONS = "\u2026\u2122\u00bd\u00bc\u00be\ufb01\ufb02"


def _folded(char: str) -> str:
    decomposed = unicodedata.normalize("NFKD", char)
    return "".join(c for c in decomposed if not unicodedata.combining(c))


@cache
def _fold_table() -> tuple[str, str, str]:
    """Folding of the whole Unicode database: from, to, class of what needs Python.

    Marks are dropped, so their order does not matter and characters fold one by one.
    Most fold to themselves.  ``from`` has those that become one other character, then,
    without a partner in ``to``, those that vanish; the class has those that become several
    and those beyond the basic plane that change.
    """
    source, target, gone, several = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = _folded(char)
        if code > 0xFFFF and folded != char:  # Spark translates one UTF-16 unit at a time
            several.append(code)
        elif not folded:
            gone.append(char)
        elif len(folded) > 1:
            if char not in USUAL_EXPANSIONS:
                several.append(code)
        elif folded != char:
            source.append(char)
            target.append(folded)
    return "".join(source + gone), "".join(target), _as_ranges(several, "\\x{{{:x}}}")


def _decode_usual(text: Column) -> Column:
    for name, char in USUAL_ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def _has_unusual_entity(text: Column) -> Column:
    """Whether an ``&`` begins something that may be an entity and is no usual one."""
    return text.rlike(f"&(?=[#A-Za-z])(?!(?:{'|'.join(USUAL_ENTITIES)});)")


def fold_unicode(text: Column) -> Column:
    """Decode HTML entities, decompose (NFKD) and drop combining marks."""
    text = text_or_empty(text)
    source, target, several = _fold_table()
    # As many bytes as characters: ASCII, told without a pattern.
    ascii_only = lambda t: F.octet_length(t) == F.length(t)
    has_entity = text.contains("&")
    # The look-ahead keeps the long class off the characters before its first one.
    ahead = int(several[3 : several.index("}")], 16) - 1
    expands = ~ascii_only(text) & text.rlike(f"(?![\\x00-\\x{{{ahead:x}}}])[{several}]")
    needs_python = (has_entity & _has_unusual_entity(text)) | expands

    def native(t: Column) -> Column:
        expanded = t
        for char in USUAL_EXPANSIONS:
            expanded = F.replace(expanded, F.lit(char), F.lit(_folded(char)))
        return F.when(ascii_only(t), t).otherwise(F.translate(expanded, source, target))

    decoded = F.when(has_entity, _decode_usual(text)).otherwise(text)
    return F.coalesce(_fold_udf()(F.when(needs_python, text)), let(decoded, native))


def unescape_html(text: Column) -> Column:
    """Decode HTML entities only; rows without unusual ones stay in the JVM."""
    text = text_or_empty(text)
    has_entity = text.contains("&")
    unusual = F.when(has_entity & _has_unusual_entity(text), text)
    usual = F.when(has_entity, _decode_usual(text)).otherwise(text)
    return F.coalesce(_unescape_udf()(unusual), usual)


@cache
def _unescape_udf():
    def unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import html

        import pandas

        for batch in batches:
            yield pandas.Series(
                [None if t is None else html.unescape(t) for t in batch], dtype=object
            )

    return F.pandas_udf(unescape, StringType())


def _replace_if(
    text: Column, needles: tuple[str, ...], pattern: str, placeholder: str
) -> Column:
    """Replace matches in the texts that hold one of the needles."""

    def body(t: Column) -> Column:
        present = F.lit(False)
        for needle in needles:
            present = present | t.contains(needle)
        return F.when(
            present, F.regexp_replace(t, pattern, F.lit(placeholder))
        ).otherwise(t)

    return let(text, body)


def mask_urls(text: Column) -> Column:
    return _replace_if(text, ("http", "www."), _URL, URL_PLACEHOLDER)


def mask_mentions(text: Column) -> Column:
    return _replace_if(text, ("@",), _MENTION, MENTION_PLACEHOLDER)


def decode_leet(text: Column) -> Column:
    """Decode obfuscated words; numbers and plain punctuation stay as they are.

    The text is cut at the obfuscated words, those are translated character by
    character, and the pieces are joined again.
    """
    source, target = "".join(LEET_LETTERS), "".join(LEET_LETTERS.values())

    def rebuild(t: Column) -> Column:
        gaps = F.split(t, _LEET_WORD, -1)
        words = F.regexp_extract_all(t, F.lit(_LEET_WORD), 0)
        pieces = F.zip_with(
            gaps,
            words,
            lambda gap, word: F.concat(
                gap, F.coalesce(F.translate(word, source, target), F.lit(""))
            ),
        )
        return F.array_join(pieces, "")

    return let(
        text_or_empty(text),
        lambda t: F.when(t.rlike(_LEET_SIGNS) & t.rlike(_LEET_HINT), rebuild(t)).otherwise(t),
    )


def collapse_repeats(text: Column) -> Column:
    """Three or more equal ASCII letters become two."""
    return F.regexp_replace(text, REPEAT_PATTERN, "$1$1")


def squash_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_text(
    text: Column, remove_urls: bool = True, normalize_whitespace: bool = True
) -> Column:
    """Normalise a comment; the order of the steps matters."""
    out = F.lower(fold_unicode(text))
    if remove_urls:
        out = mask_urls(out)
    out = collapse_repeats(decode_leet(mask_mentions(out)))
    return squash_whitespace(out) if normalize_whitespace else out


def model_text(text: Column) -> Column:
    """Text as the models see it: cleaned, then leet-decoded a second time.

    Decoding is not idempotent (``sh1t!yo`` needs both passes).
    """
    return decode_leet(clean_text(text))
