import re
import sys
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civilspark.functions import text as T
from civilspark.functions.regex import SPACE, WORD
from civilspark.functions.tokens import (
    ngrams,
    term_counts,
    whitespace_tokens,
    word_tokens,
)

# Surrogates cannot be stored in a string column.
ALL_CHARS = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]


def test_leet_one_pass(column):
    cases = {
        "f*ck this sh!t and you b!tch": "fuck this shit and you bitch",
        "sh1t h4te l0ser": "shit hate loser",
        "sh*t": "shut",
        "mp3": "mpe",
        "covid19": "covidi9",
        "1985": "1985",
        "2024": "2024",
        "4u": "4u",
        "cool!!!": "cool!!!",
        "stop!now": "stopinow",
        "sh1t!yo": "shit!yo",
        "h1": "h1",
        "abc1": "abci",
        "1abc": "1abc",
        "a!b": "a!b",
        "a!bc": "aibc",
        "éabc1": "éabc1",
        "abc1é": "abc1é",
        "x_abc1": "x_abc1",
        "b!tch!é": "bitchié",
        "SH1T": "SH1T",
        "": "",
    }
    assert column(T.decode_leet, list(cases)) == list(cases.values())


def test_model_text_decodes_twice(column):
    assert column(T.clean_text, ["sh1t!yo"]) == ["shit!yo"]
    assert column(T.model_text, ["sh1t!yo"]) == ["shitiyo"]


def test_clean_text(column):
    cases = {
        "Check this out: https://example.com/bad and @john is cool!!!": (
            "check this out: [URL] and [USER] is cool!!!"
        ),
        "b@d joe@x.com": "b[USER] joe[USER].com",
        "sooooo 555 !!!": "soo 555 !!!",
        "SOOOO goood": "soo good",
        "WWW.Example.com/x y": "[URL] y",
        "café ｆｕｃｋ": "cafe fuck",
        "Straße ÆON Ñandú": "straße æon nandu",
        "&lt;b&gt; &amp;amp; &lt 1 &eacute;": "<b> &amp; < 1 e",
        "a  b\x1c c  ": "a b c",
        "ΣΑΣ": "σας",
        "@été x": "[USER] x",
        "": "",
        None: "",
    }
    assert column(T.clean_text, list(cases)) == list(cases.values())


def test_clean_text_switches(column):
    keep_url = column(lambda c: T.clean_text(c, remove_urls=False), ["see http://a.b  c"])
    assert keep_url == ["see http://a.b  c".replace("  ", " ")]
    keep_space = column(
        lambda c: T.clean_text(c, normalize_whitespace=False), [" see http://a.b  c "]
    )
    assert keep_space == [" see [URL]  c "]


def test_numbers_become_text(column):
    assert column(T.clean_text, [42], "int") == ["42"]


def test_unescape(column):
    assert column(T.unescape_html, ["&copy; &amp;lt; &am x", "plain", None]) == [
        "© &lt; &am x",
        "plain",
        "",
    ]


def test_fold_equals_unicode_database_on_every_character(column):
    size = 2000
    blocks = [
        "".join(ALL_CHARS[i : i + size]).replace("&", "")
        for i in range(0, len(ALL_CHARS), size)
    ]
    # Every Latin letter alone as well, to take the table and not the worker.
    singles = [chr(c) for c in range(0x80, 0x250)]
    expected = [
        "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        for t in blocks + singles
    ]
    assert column(T.fold_unicode, blocks + singles) == expected


def test_character_classes_match_python(spark):
    df = spark.createDataFrame([(c,) for c in ALL_CHARS], "c string").repartition(4)
    marked = df.select(
        "c", F.col("c").rlike(SPACE).alias("space"), F.col("c").rlike(WORD).alias("word")
    ).toPandas()
    spaces = set(marked.c[marked.space])
    assert spaces == {c for c in ALL_CHARS if c.isspace()}
    words = set(marked.c[marked.word])
    python_words = {c for c in ALL_CHARS if re.match(r"\w", c)}
    # The engines follow different Unicode versions; only characters Java does
    # not know yet, or number-like letters, may differ.
    unknown = words ^ python_words
    assert len(unknown) < 12000
    assert not any(ord(c) < 0x500 for c in unknown)


def test_blank_and_min_length(column):
    values = [None, "", "  \n", "a", " ab ", " abc ", "a b", " ab "]
    assert column(T.is_blank, values) == [True, True, True] + [False] * 5
    assert column(lambda c: T.has_min_length(c, 3), values) == [
        None, False, False, False, False, True, True, False,
    ]


@settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), min_size=1, max_size=30))
def test_clean_text_invariants(column, texts):
    for cleaned in column(T.clean_text, texts):
        assert cleaned == cleaned.strip()
        assert not re.search(r"\s\s|[^\S ]", cleaned)
        assert not re.search(r"([a-zA-Z])\1\1", cleaned)


def test_word_tokens(column):
    cases = {
        "It's [URL] café_x, 3.5!": ["it", "s", "url", "café_x", "3", "5"],
        "": [],
    }
    assert column(word_tokens, list(cases)) == list(cases.values())


def test_whitespace_tokens(column):
    assert column(whitespace_tokens, ["  a b c\n", "", " "]) == [["a", "b", "c"], [], []]


def test_ngrams_and_counts(column):
    def grams(text):
        return ngrams(whitespace_tokens(text), 1, 3)

    assert column(grams, ["a b c", "a", ""]) == [
        ["a", "b", "c", "a b", "b c", "a b c"],
        ["a"],
        [],
    ]
    counted = column(lambda t: term_counts(whitespace_tokens(t)), ["b a b c b a", "", "x"])
    assert [[tuple(r) for r in row] for row in counted] == [
        [("a", 2), ("b", 3), ("c", 1)],
        [],
        [("x", 1)],
    ]


def test_every_character_folds(spark):
    """All code points one by one against Python, and which of them need Python."""
    import html
    import sys
    import unicodedata

    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    codes = [c for c in codes if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, text string")
    got = {r.code: r.folded for r in df.select("code", T.fold_unicode(F.col("text")).alias("folded")).collect()}
    fold = lambda t: "".join(
        c for c in unicodedata.normalize("NFKD", html.unescape(t)) if not unicodedata.combining(c)
    )
    wrong = [c for c in codes if got[c] != fold(chr(c))]
    assert not wrong
    source, target, several = T._fold_table()
    for text in ("emoji 😀🎉", "dash \u2014 \u2013", "Привет, ёлка й", "漢字", "\u2026 \u2122 ½ ﬁ", "e\u0301 ä"):
        python = spark.createDataFrame([(text,)], "t string").where(
            F.col("t").rlike(f"[{several}]")
        )
        assert python.count() == 0


ENTITIES = [
    "a &lt;b&gt; &amp; c", "&amp;lt; &amp;amp;", "&nbsp;x&nbsp;", "&copy; 2020 &mdash; &quot;q&quot;",
    "&#39;s &#x27;", "&lt no semicolon", "AT&T & co", "&unknown; &notit;", "&#128512; &#38;lt;", "&&lt;;", "&amp", "é &eacute; &hellip;",
]


def test_entities(column):
    import html
    import unicodedata

    assert column(T.unescape_html, ENTITIES) == [html.unescape(t) for t in ENTITIES]
    assert column(T.fold_unicode, ENTITIES) == [
        "".join(c for c in unicodedata.normalize("NFKD", html.unescape(t)) if not unicodedata.combining(c))
        for t in ENTITIES
    ]


def test_cheap_guards_miss_nothing(spark):
    """The characters that skip the long class are not in it; no leet word lacks a sign."""
    plan = spark.range(1).select(T.clean_text(F.col("id").cast("string")))
    shown = plan._jdf.queryExecution().analyzed().toString()
    _, _, several = T._fold_table()
    assert "(?![\\x00-\\x{131}])" in shown and several.startswith("\\x{132}")
    assert T._LEET_SIGNS in shown
    rows = [(chr(c),) for c in range(0x132)]
    texts = spark.createDataFrame(rows, "t string")
    assert texts.where(F.col("t").rlike(f"[{several}]")).count() == 0
    every = spark.createDataFrame([(f"a{chr(c)}b",) for c in range(1, 0x250)], "t string")
    hinted = every.where(F.col("t").rlike(T._LEET_HINT))
    assert hinted.count() > 10 and hinted.where(~F.col("t").rlike(T._LEET_SIGNS)).count() == 0
