"""The registered queries as plain SQL for DuckDB, for comparison."""

from __future__ import annotations

import string

from civilspark import fixed_values as fixed
from civilspark.plans.registry import POOL_VECTOR_SIZE, VOCAB_QUERY_SIZE

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x{85}\p{Z}]"
NOT_SPACE = r"[^\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x{85}\p{Z}]"
# Letters and digits beyond ASCII.
FAR_WORD = r"[^\x00-\x7f\p{Z}\p{P}\p{S}\p{M}\p{C}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(items) -> str:
    return ", ".join(q(i) for i in items)


# ---- normalisation ---------------------------------------------------------


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'), ' ')"


def collapse(x: str) -> str:
    for letter in string.ascii_letters:
        x = f"regexp_replace({x}, '{letter}{{3,}}', '{letter}{letter}', 'g')"
    return x


def unescape(x: str) -> str:
    """The entities that occur in the tables; the ampersand comes last."""
    for entity, char in (
        ("&copy;", "©"),
        ("&middot;", "·"),
        ("&quot;", '"'),
        ("&lt;", "<"),
        ("&gt;", ">"),
    ):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def mask_urls(x: str) -> str:
    return f"regexp_replace({x}, 'https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+', '[URL]', 'g')"


def mask_mentions(x: str) -> str:
    return f"regexp_replace({x}, '@{WORD}+', '[USER]', 'g')"


# Leet words without look-ahead.  Word boundaries are ASCII-only here, so letters
# beyond ASCII are wrapped in capital Z (absent from lower-case text) meanwhile.
_LEET = (
    r"\b(?:[a-z]{2,}[0-9][a-z0-9]*|[a-z][0-9][a-z][a-z0-9]*)\b"
    r"|\b[a-z][!@*$+]?[a-z][!@*$+]?[a-z][a-z!@*$+]*\b"
)


def leet(x: str) -> str:
    source, target = "".join(fixed.LEET_LETTERS), "".join(fixed.LEET_LETTERS.values())
    wrapped = f"regexp_replace({x}, '({FAR_WORD})', 'Z\\1Z', 'g')"
    rebuilt = (
        f"array_to_string(list_transform(list_zip("
        f"string_split_regex(w, '{_LEET}'), regexp_extract_all(w, '{_LEET}')), "
        f"lambda p: p[1] || coalesce(translate(p[2], '{source}', '{target}'), '')), '')"
    )
    # One-row subquery: names the wrapped text so it is written once.
    return (
        f"(SELECT regexp_replace({rebuilt}, 'Z({FAR_WORD})Z', '\\1', 'g') "
        f"FROM (SELECT {wrapped} AS w) AS one)"
    )


def fold(x: str) -> str:
    return f"strip_accents({unescape(x)})"


CLEAN_STEPS = """
{name}_1 AS (SELECT * EXCLUDE (x), {masked} AS x FROM {source}),
{name}_2 AS (SELECT * EXCLUDE (x), {decoded} AS x FROM {name}_1),
{name} AS (SELECT * EXCLUDE (x), {squashed} AS cleaned FROM {name}_2)"""


def clean_ctes(name: str, source: str) -> str:
    """CTEs from ``source(..., x)`` to ``name(..., cleaned)``."""
    return CLEAN_STEPS.format(
        name=name,
        source=source,
        masked=mask_mentions(mask_urls(f"lower({fold('x')})")),
        decoded=leet("x"),
        squashed=squash(collapse("x")),
    )


# ---- scoring ---------------------------------------------------------------


def lexicon_cte() -> str:
    rows = ", ".join(
        f"({q(term)}, {', '.join(f'{w}::DOUBLE' for w in row)})"
        for term, row in fixed.LEXICON_WEIGHTS.items()
    )
    return f"lexicon(term, {', '.join(fixed.LABELS)}) AS (VALUES {rows})"


def scored_ctes(source: str, ids: str) -> str:
    """CTEs from ``source(ids, x)`` to ``scored(ids, cleaned, model_text, labels)``."""
    sums = ", ".join(f"sum(l.{c}) AS {c}" for c in fixed.LABELS)
    probs = ", ".join(
        f"1.0 / (1.0 + exp(-({fixed.LEXICON_BIAS[c]}::DOUBLE + coalesce(h.{c}, 0.0)))) AS {c}"
        for c in fixed.LABELS
    )
    keys = [k.strip() for k in ids.split(",")]
    on = " AND ".join(f"h.{k} = m.{k}" for k in keys)
    return f"""
{lexicon_cte()},
raw AS (SELECT {ids}, x AS original_text, x FROM {source}),
{clean_ctes("cleaned_rows", "raw")},
modelled AS (SELECT {ids}, original_text, cleaned, x AS model_text FROM
  (SELECT *, {leet("cleaned")} AS x FROM cleaned_rows)),
hit_terms AS (SELECT {ids}, unnest(regexp_extract_all(lower(model_text), '{WORD}+')) AS term FROM modelled),
hit_sums AS (SELECT {ids}, {sums} FROM hit_terms t JOIN lexicon l USING (term) GROUP BY {ids}),
scored AS (SELECT m.*, {probs} FROM modelled m LEFT JOIN hit_sums h ON {on}),
judged AS (SELECT *, greatest({", ".join(fixed.LABELS)}) AS overall_score FROM scored)"""


DOCS = "(SELECT doc_id, text AS x FROM documents)"
LINES = f"""(SELECT doc_id, line_no, {strip("line")} AS x FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no
  FROM documents) WHERE regexp_matches(line, '{NOT_SPACE}'))"""


def first_label(condition: str) -> str:
    """First label in order that fulfils a condition on ``{c}``."""
    whens = " ".join(f"WHEN {condition.format(c=c)} THEN {q(c)}" for c in fixed.LABELS)
    return f"CASE {whens} END"


def primary(threshold: float = fixed.THRESHOLD) -> str:
    whens = " ".join(
        f"WHEN {c} = overall_score THEN {q(fixed.CATEGORIES[c][0])}" for c in fixed.LABELS
    )
    return f"CASE WHEN overall_score < {threshold} THEN 'Clean' {whens} END"


def severity(threshold: float = fixed.THRESHOLD) -> str:
    return f"""CASE
  WHEN overall_score < {threshold} AND overall_score < {fixed.CLEAN_BELOW} THEN {q(fixed.SEVERITY_CLEAN)}
  WHEN overall_score < {threshold} THEN {q(fixed.SEVERITY_LOW)}
  WHEN threat >= {fixed.CRITICAL_THREAT} OR severe_toxic >= {fixed.CRITICAL_SEVERE} THEN {q(fixed.SEVERITY_CRITICAL)}
  WHEN overall_score >= {fixed.HIGH_ANY} OR identity_hate >= {fixed.HIGH_IDENTITY} THEN {q(fixed.SEVERITY_HIGH)}
  WHEN overall_score >= {fixed.MODERATE_ANY} THEN {q(fixed.SEVERITY_MODERATE)}
  ELSE {q(fixed.SEVERITY_MILD)} END"""


def flagged(threshold: float = fixed.THRESHOLD) -> str:
    parts = ", ".join(
        f"CASE WHEN {c} >= {threshold} THEN {q(c)} END" for c in fixed.LABELS
    )
    return f"concat_ws(',', {parts})"


def with_scores(select: str, source: str = DOCS, ids: str = "doc_id") -> str:
    return f"WITH {scored_ctes(source, ids)}\n{select}"


REPORT = f"""SELECT doc_id, original_text AS "Comment",
  CASE WHEN overall_score >= {fixed.THRESHOLD} THEN {q(fixed.STATUS_TOXIC)} ELSE {q(fixed.STATUS_CLEAN)} END AS "Status",
  {primary()} AS "Primary Category", {severity()} AS "Severity",
  round(overall_score * 100, 1) AS "Confidence (%)",
  {", ".join(f'round({c} * 100, 1) AS "{h}"' for c, h in fixed.REPORT_COLUMNS.items())}
FROM judged"""

SUMMARY = f"""SELECT count(*) AS total,
  count(*) FILTER (overall_score < {fixed.THRESHOLD}) AS clean_count,
  round(count(*) FILTER (overall_score < {fixed.THRESHOLD}) * 100.0 / count(*), 1) AS clean_pct,
  count(*) FILTER (overall_score >= {fixed.THRESHOLD}) AS toxic_count,
  round(count(*) FILTER (overall_score >= {fixed.THRESHOLD}) * 100.0 / count(*), 1) AS toxic_pct
FROM judged"""


# ---- occlusion -------------------------------------------------------------


def occlusion_ctes() -> str:
    sums = ", ".join(f"sum(l.{c}) AS {c}" for c in fixed.LABELS)
    masked = ", ".join(
        f"1.0 / (1.0 + exp(-({fixed.LEXICON_BIAS[c]}::DOUBLE + coalesce(v.{c}, 0.0))))"
        for c in fixed.LABELS
    )
    return f"""{scored_ctes(LINES, "doc_id, line_no")},
toxic AS (SELECT doc_id, line_no, overall_score,
  list_filter(regexp_split_to_array(model_text, '{SPACE}+'), lambda w: w <> '') AS words
  FROM judged WHERE overall_score >= {fixed.THRESHOLD}),
placed AS (SELECT doc_id, line_no, overall_score, words, len(words) AS n,
  unnest(words) AS word, generate_subscripts(words, 1)::INT - 1 AS pos FROM toxic),
variants AS (SELECT *, array_to_string(list_concat(words[1:pos], words[pos + 2:]), ' ') AS variant
  FROM placed WHERE n BETWEEN {fixed.EXPLAIN_MIN_WORDS} AND {fixed.EXPLAIN_MAX_WORDS}),
variant_terms AS (SELECT doc_id, line_no, pos,
  unnest(regexp_extract_all(lower(variant), '{WORD}+')) AS term FROM variants),
variant_sums AS (SELECT doc_id, line_no, pos, {sums}
  FROM variant_terms JOIN lexicon l USING (term) GROUP BY doc_id, line_no, pos),
important AS (SELECT p.doc_id, p.line_no, p.pos, p.word, p.overall_score,
  CASE WHEN p.n BETWEEN {fixed.EXPLAIN_MIN_WORDS} AND {fixed.EXPLAIN_MAX_WORDS}
       THEN greatest(0.0, p.overall_score - greatest({masked})) ELSE 0.0 END AS importance
  FROM placed p LEFT JOIN variant_sums v
    ON v.doc_id = p.doc_id AND v.line_no = p.line_no AND v.pos = p.pos),
highlights AS (SELECT doc_id, line_no, pos, word, round(importance, 4) AS importance,
  importance >= {fixed.TRIGGER_IMPORTANCE}
    OR (importance >= {fixed.TRIGGER_IMPORTANCE_CONFIDENT} AND overall_score > {fixed.CONFIDENT_BASELINE}) AS is_toxic_token
  FROM important)"""


STOP = in_list(fixed.STOP_WORDS)
KEPT = f"""kept AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{WORD}{{2,}}'),
  lambda w: w NOT IN ({STOP})) AS w FROM documents)"""
BIGRAMS = "list_transform(list_zip(w[1:-2], w[2:]), lambda p: p[1] || ' ' || p[2])"

# ---- fitted heads ----------------------------------------------------------

HEADS = ("toxic", "insult")


def kept_words(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{WORD}{{2,}}'), lambda w: w NOT IN ({STOP}))"


def terms_of(w: str) -> str:
    grams = BIGRAMS.replace("w[", f"{w}[")
    return f"list_concat({w}, CASE WHEN len({w}) >= 2 THEN {grams} ELSE [] END)"


def model_text_ctes(name: str, source: str) -> str:
    """``name(..., cleaned, model_text, original_text)`` of ``source(..., x)``."""
    return f"""{name}_raw AS (SELECT *, x AS original_text FROM {source}),
{clean_ctes(name + "_clean", name + "_raw")},
{name} AS (SELECT * EXCLUDE (x), x AS model_text FROM
  (SELECT *, {leet("cleaned")} AS x FROM {name}_clean))"""


def heads_ctes() -> str:
    """Log odds of terms as weights: ``weights(term, idf, <labels>)``, ``bias(<labels>)``."""
    counts = ", ".join(f"sum({l}) AS p_{l}, sum(1 - {l}) AS n_{l}" for l in HEADS)
    prior = {l: f"((s.p_{l} + 1.0::DOUBLE) / (s.n + 2.0::DOUBLE))" for l in HEADS}
    odds = ", ".join(
        f"ln((t.p_{l} + {p}) / (t.n_{l} + (1.0 - {p}))) - ln({p} / (1.0 - {p})) AS {l}"
        for l, p in prior.items()
    )
    bias = ", ".join(f"ln({p} / (1.0 - {p})) AS {l}" for l, p in prior.items())
    return f"""{model_text_ctes("docs", DOCS)},
marks AS (SELECT doc_id, (toxic = 1)::INT AS toxic, (toxic = 1 AND quality = 0)::INT AS insult FROM labels),
marked AS (SELECT doc_id, toxic, insult, {kept_words("model_text")} AS w FROM docs JOIN marks USING (doc_id)),
mark_terms AS (SELECT doc_id, toxic, insult, unnest({terms_of("w")}) AS term FROM marked),
mark_tfs AS (SELECT doc_id, toxic, insult, term, count(*) AS tf FROM mark_terms GROUP BY ALL),
mark_sizes AS (SELECT count(*) AS n, {counts} FROM marked),
mark_vocab AS (SELECT term, count(*) AS df, sum(tf) AS total, {counts} FROM mark_tfs GROUP BY term
  ORDER BY total DESC, term LIMIT {fixed.TFIDF_MAX_FEATURES}),
weights AS (SELECT term, ln((1.0::DOUBLE + s.n) / (1.0::DOUBLE + df)) + 1.0 AS idf, {odds}
  FROM mark_vocab t, mark_sizes s),
bias AS (SELECT {bias} FROM mark_sizes s)"""


def heads_scores(name: str, source: str, ids: str, text: str) -> str:
    """CTEs from ``source(ids, text)`` to ``name(ids, <labels>)``."""
    sums = ", ".join(f"sum(v * {l}) AS {l}" for l in HEADS)
    probs = ", ".join(
        f"1.0 / (1.0 + exp(-(b.{l} + coalesce(s.{l} / sqrt(s.q), 0.0)))) AS {l}" for l in HEADS
    )
    return f"""{name}_terms AS (SELECT {ids}, unnest({terms_of("w")}) AS term
  FROM (SELECT {ids}, {kept_words(text)} AS w FROM {source})),
{name}_tfs AS (SELECT {ids}, term, count(*) AS tf FROM {name}_terms GROUP BY ALL),
{name}_sums AS (SELECT {ids}, sum(v * v) AS q, {sums}
  FROM (SELECT {ids}, (1 + ln(tf)) * idf AS v, {", ".join(HEADS)} FROM {name}_tfs JOIN weights USING (term))
  GROUP BY {ids}),
{name} AS (SELECT d.*, {probs} FROM {source} d LEFT JOIN {name}_sums s USING ({ids}), bias b)"""


def heads_judged(name: str, scored: str) -> str:
    rest = ", ".join(f"0.0::DOUBLE AS {l}" for l in fixed.LABELS if l not in HEADS)
    return f"""{name} AS (SELECT *, {rest}, greatest({", ".join(HEADS)}) AS overall_score FROM {scored})"""


HEADS_REPORT = f"""WITH {heads_ctes()},
{heads_scores("docs_scored", "docs", "doc_id", "model_text")},
{heads_judged("judged", "docs_scored")}
{{report}} WHERE regexp_matches(original_text, '{NOT_SPACE}')"""

HEADS_HIGHLIGHTS = f"""WITH {heads_ctes()},
{model_text_ctes("lines", LINES)},
{heads_scores("lines_scored", "lines", "doc_id, line_no", "model_text")},
toxic AS (SELECT doc_id, line_no, greatest({", ".join(HEADS)}) AS overall_score,
  list_filter(regexp_split_to_array(model_text, '{SPACE}+'), lambda w: w <> '') AS words
  FROM lines_scored WHERE greatest({", ".join(HEADS)}) >= {fixed.THRESHOLD}),
placed AS (SELECT *, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1)::INT - 1 AS pos
  FROM toxic),
variants AS (SELECT doc_id, line_no, pos, array_to_string(list_concat(words[1:pos], words[pos + 2:]), ' ') AS variant
  FROM placed WHERE n BETWEEN {fixed.EXPLAIN_MIN_WORDS} AND {fixed.EXPLAIN_MAX_WORDS}),
{heads_scores("variants_scored", "variants", "doc_id, line_no, pos", "variant")},
important AS (SELECT p.doc_id, p.line_no, p.pos, word, overall_score,
  greatest(0.0, overall_score - coalesce(greatest({", ".join("v." + l for l in HEADS)}), overall_score)) AS importance
  FROM placed p LEFT JOIN variants_scored v USING (doc_id, line_no, pos))
SELECT doc_id, line_no, pos, word, round(importance, 4) AS importance,
  importance >= {fixed.TRIGGER_IMPORTANCE}
    OR (importance >= {fixed.TRIGGER_IMPORTANCE_CONFIDENT} AND overall_score > {fixed.CONFIDENT_BASELINE}) AS is_toxic_token
FROM important"""


# ---- metrics ---------------------------------------------------------------


def judged_labels_ctes(threshold: float = fixed.THRESHOLD) -> str:
    return f"""{scored_ctes(DOCS, "doc_id")},
pairs AS (SELECT l.doc_id,
  CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS actual,
  CASE WHEN j.overall_score >= {threshold} THEN 'toxic' ELSE 'clean' END AS pred,
  j.toxic AS p_toxic
  FROM labels l JOIN judged j USING (doc_id))"""


MATRIX_CTES = """grid AS (SELECT a.c AS actual, p.c AS pred
  FROM (VALUES ('clean'), ('toxic')) a(c), (VALUES ('clean'), ('toxic')) p(c)),
matrix AS (SELECT g.actual, g.pred, count(x.doc_id) AS n FROM grid g
  LEFT JOIN pairs x ON x.actual = g.actual AND x.pred = g.pred GROUP BY g.actual, g.pred),
report AS (SELECT c AS label,
  coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
  coalesce(tp / nullif(support, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(support + predicted, 0), 0.0) AS f1, support
  FROM (SELECT c,
    (SELECT sum(n)::DOUBLE FROM matrix WHERE actual = c AND pred = c) AS tp,
    (SELECT sum(n)::BIGINT FROM matrix WHERE actual = c) AS support,
    (SELECT sum(n)::BIGINT FROM matrix WHERE pred = c) AS predicted
    FROM (VALUES ('clean'), ('toxic')) k(c)))"""


def with_matrix(select: str, threshold: float = fixed.THRESHOLD) -> str:
    return f"WITH {judged_labels_ctes(threshold)},\n{MATRIX_CTES}\n{select}"


HEADLINE = """(SELECT avg(f1) FROM report) AS macro_f1,
  (SELECT sum(f1 * support) / sum(support) FROM report) AS weighted_f1,
  (SELECT avg((actual = pred)::INT) FROM pairs) AS accuracy"""


def model_compare() -> str:
    one = with_matrix(f"SELECT 'lexicon at 0.5' AS model, {HEADLINE}", 0.5)
    two = with_matrix(f"SELECT 'lexicon at 0.9' AS model, {HEADLINE}", 0.9)
    return f"""SELECT model, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
  round(accuracy, 6) AS accuracy,
  round(macro_f1 - max(macro_f1) FILTER (model = 'lexicon at 0.5') OVER (), 6) AS macro_f1_delta
FROM (SELECT * FROM ({one}) UNION ALL SELECT * FROM ({two}))"""


# ---- tokens ----------------------------------------------------------------

TOKENS = f"""tokens AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}+') AS t FROM documents))"""


def vocabulary_ctes(size: str) -> str:
    return f"""{TOKENS},
counted AS (SELECT token, count(*) AS freq, min((doc_id::HUGEINT << 31) + pos) AS seen
  FROM tokens GROUP BY token HAVING count(*) >= {fixed.VOCAB_MIN_FREQ}),
ranked AS (SELECT token, freq, row_number() OVER (ORDER BY freq DESC, seen) AS r FROM counted),
vocab AS (SELECT token, (r + 1)::INT AS idx, freq FROM ranked WHERE r <= {size} - 2
  UNION ALL VALUES ('<pad>', 0, 0), ('<unk>', 1, 0))"""


def encoded_ctes(size: str) -> str:
    n = fixed.ENCODE_LENGTH
    return f"""{vocabulary_ctes(size)},
turns AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{WORD}+')[1:{n}] AS t FROM conversations),
turn_tokens AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM turns),
turn_ids AS (SELECT x.conv_id, x.turn, x.pos, coalesce(v.idx, 1) AS idx
  FROM turn_tokens x LEFT JOIN vocab v USING (token)),
turn_lists AS (SELECT conv_id, turn, list(idx ORDER BY pos) AS ids FROM turn_ids GROUP BY conv_id, turn),
encoded AS (SELECT t.conv_id, t.turn, list_resize(coalesce(l.ids, []), {n}, 0) AS ids
  FROM turns t LEFT JOIN turn_lists l USING (conv_id, turn))"""


SPLIT_CTES = f"""firsts AS (SELECT doc_id, lang, text,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents),
usable AS (SELECT doc_id, lang, md5('{fixed.SEED}|' || doc_id::VARCHAR) AS h FROM firsts
  WHERE copy = 1 AND length({strip("text")}) > 2),
placed AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r,
  count(*) OVER (PARTITION BY lang) AS n FROM usable),
split AS (SELECT doc_id, lang,
  CASE WHEN r <= n * 8 // 10 THEN 'train' WHEN r <= n * 9 // 10 THEN 'val' ELSE 'test' END AS split
  FROM placed)"""

ORACLE = {
    "profile_nulls": " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, count(*) AS row_count, "
        f"count(*) - count({c}) AS null_count FROM documents"
        for i, c in enumerate(("doc_id", "text", "lang", "source", "n_chars"))
    ),
    "dedupe_keep_first": """SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents) WHERE copy = 1""",
    "dedupe_counts": """SELECT count(*) AS total_rows, count(*) - count(*) FILTER (copy = 1) AS removed,
  count(*) FILTER (copy = 1) AS remaining FROM (
  SELECT row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents)""",
    "class_distribution": """SELECT lang, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM (
  SELECT lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents)
WHERE copy = 1 AND lang IS NOT NULL GROUP BY lang""",
    "min_length_filter": f"""SELECT * FROM (SELECT doc_id,
  generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no,
  unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length({strip("line")}) > 2""",
    "stratified_split": f"WITH {SPLIT_CTES} SELECT doc_id, lang, split FROM split",
    "split_summary": f"""WITH {SPLIT_CTES} SELECT split, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM split GROUP BY split""",
    "csv_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "split_roundtrip": f"""WITH {SPLIT_CTES}
SELECT d.doc_id, text, d.lang, source, n_chars, split FROM documents d JOIN split USING (doc_id)""",
    "report_roundtrip": with_scores(REPORT),
    "vocab_roundtrip": f"WITH {vocabulary_ctes(str(VOCAB_QUERY_SIZE))} SELECT token, idx FROM vocab",
    "non_string_text": """SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars::VARCHAR ELSE '' END AS cleaned
FROM documents""",
    "blank_guard": f"""SELECT doc_id, regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g') AS original_text, '' AS cleaned_text,
  false AS is_toxic, 0.0::DOUBLE AS overall_score, 'Clean' AS primary_category, {q(fixed.SEVERITY_CLEAN)} AS severity_level,
  0.0::DOUBLE AS best, {len(fixed.LABELS)} AS labels, 0 AS flagged, 0 AS highlights FROM documents""",
    "saved_model_eval": f"""WITH {SPLIT_CTES}
SELECT count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split = 'test') AS agreeing,
  (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM split) AS classes,
  count(*) FILTER (split = 'test') AS support FROM split""",
    "lines_to_rows": f"SELECT doc_id, line_no, x AS comment FROM {LINES}",
    "detect_text_column": """SELECT conv_id, turn, text AS comment FROM conversations
WHERE text IS NOT NULL""",
    "url_mention_mask": f"""SELECT page_id,
  {mask_mentions(mask_urls("concat_ws(' ', url, html)"))} AS masked FROM pages""",
    "mention_mask": f"SELECT doc_id, {mask_mentions('text')} AS masked FROM documents",
    "collapse_repeats": f"SELECT doc_id, {collapse('text')} AS collapsed FROM documents",
    "squash_whitespace": f"SELECT doc_id, {squash('text')} AS squashed FROM documents",
    "lowercase_fold": "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents",
    "html_unescape": f"SELECT page_id, {unescape('html')} AS unescaped FROM pages",
    "leet_decode": f"SELECT doc_id, {leet('x')} AS decoded FROM (SELECT doc_id, lower(text) AS x FROM documents)",
    "clean_text": f"""WITH {clean_ctes("c", DOCS)}
SELECT doc_id, cleaned, {leet("cleaned")} AS model_text FROM c""",
    "clean_pages": f"""WITH {clean_ctes("c", "(SELECT page_id, concat_ws(' ', url, html) AS x FROM pages)")}
SELECT page_id, cleaned FROM c""",
    "token_frequency": f"WITH {TOKENS} SELECT token, count(*) AS freq FROM tokens GROUP BY token",
    "vocab_topk": f"WITH {vocabulary_ctes(str(VOCAB_QUERY_SIZE))} SELECT token, idx, freq FROM vocab",
    "encode_tokens": f"""WITH {encoded_ctes(str(VOCAB_QUERY_SIZE))}
SELECT conv_id, turn, array_to_string(ids, ' ') AS token_ids FROM encoded""",
    "decode_tokens": f"""WITH {encoded_ctes(str(VOCAB_QUERY_SIZE))},
places AS (SELECT conv_id, turn, unnest(ids) AS idx, generate_subscripts(ids, 1) AS pos FROM encoded)
SELECT conv_id, turn, string_agg(token, ' ' ORDER BY pos) AS tokens
FROM places JOIN vocab USING (idx) GROUP BY conv_id, turn""",
    "masked_mean_pool": f"""WITH {encoded_ctes(str(VOCAB_QUERY_SIZE))},
places AS (SELECT conv_id, turn, unnest(ids) AS idx FROM encoded),
real_places AS (SELECT * FROM places WHERE idx <> 0),
lengths AS (SELECT conv_id, turn, count(*) AS n FROM real_places GROUP BY conv_id, turn),
vectors AS (SELECT vec_id AS idx, unnest(embedding)::DOUBLE AS v,
  generate_subscripts(embedding, 1)::INT - 1 AS dim FROM embeddings),
sums AS (SELECT conv_id, turn, dim, sum(v) AS s FROM real_places JOIN vectors USING (idx)
  GROUP BY conv_id, turn, dim)
SELECT e.conv_id, e.turn, d.dim, round(coalesce(s.s, 0.0) / greatest(coalesce(l.n, 1), 1), 4) AS mean
FROM encoded e CROSS JOIN (SELECT unnest(range({POOL_VECTOR_SIZE}))::INT AS dim) d
LEFT JOIN lengths l USING (conv_id, turn)
LEFT JOIN sums s ON s.conv_id = e.conv_id AND s.turn = e.turn AND s.dim = d.dim""",
    "bigram_counts": f"""WITH {KEPT}
SELECT term, count(*) AS n FROM (SELECT unnest({BIGRAMS}) AS term FROM kept WHERE len(w) >= 2) GROUP BY term""",
    "tfidf_terms": f"""WITH {KEPT},
terms AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN {BIGRAMS} ELSE [] END)) AS term FROM kept),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tfs GROUP BY term
  ORDER BY total DESC, term LIMIT {fixed.TFIDF_MAX_FEATURES}),
raw AS (SELECT doc_id, term, (1 + ln(tf)) *
  (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS w
  FROM tfs JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
    "label_index": """SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS idx
FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)""",
    "balanced_weights": """SELECT toxic, count(*) AS n,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight
FROM labels WHERE toxic IS NOT NULL GROUP BY toxic""",
    "inverse_freq_weights": """SELECT lang, n,
  round((1.0::DOUBLE / n) / sum(1.0::DOUBLE / n) OVER () * count(*) OVER (), 6) AS weight
FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)""",
    "multilabel_scores": with_scores(
        f"SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in fixed.LABELS)} FROM scored"
    ),
    "flag_categories": with_scores(
        f"SELECT doc_id, {flagged()} AS flagged, overall_score >= {fixed.THRESHOLD} AS is_toxic FROM judged"
    ),
    "primary_category": with_scores(
        f"SELECT doc_id, {primary()} AS primary_category, round(overall_score, 6) AS overall_score FROM judged"
    ),
    "severity": with_scores(f"SELECT doc_id, {severity()} AS severity_level FROM judged"),
    "argmax_label": with_scores(
        f"SELECT doc_id, {first_label('{c} = overall_score')} AS label FROM judged"
    ),
    "category_breakdown": with_scores(
        " UNION ALL ".join(
            f"SELECT doc_id, {i} AS category_no, {q(c)} AS label, {q(fixed.CATEGORIES[c][0])} AS category, "
            f"round({c} * 100, 2) AS score_pct, "
            f"CASE WHEN {c} >= {fixed.THRESHOLD} THEN 'FLAGGED' ELSE 'Normal' END AS flag, "
            f"round({c}, 6) AS raw_score FROM judged"
            for i, c in enumerate(fixed.LABELS)
        )
    ),
    "threshold_sweep": with_scores(
        f"""SELECT t::DOUBLE AS threshold, count(*) AS total,
  count(*) FILTER (overall_score >= t::DOUBLE) AS toxic_count,
  count(*) FILTER (overall_score < t::DOUBLE) AS clean_count,
  round(count(*) FILTER (overall_score >= t::DOUBLE) * 100.0 / count(*), 1) AS toxic_pct
FROM judged, (VALUES {", ".join(f"({t}::DOUBLE)" for t in fixed.THRESHOLD_SWEEP)}) s(t) GROUP BY t"""
    ),
    "prediction_record": with_scores(
        f"""SELECT doc_id, line_no, original_text, cleaned AS cleaned_text,
  overall_score >= {fixed.THRESHOLD} AS is_toxic, round(overall_score, 6) AS overall_score,
  {primary()} AS primary_category, {severity()} AS severity_level,
  concat_ws(',', {", ".join(f"'{c}=' || round({c} * 10000)::INT" for c in fixed.LABELS)}) AS scores,
  {flagged()} AS flagged_categories,
  CASE WHEN overall_score >= {fixed.THRESHOLD} THEN
    len(list_filter(regexp_split_to_array(model_text, '{SPACE}+'), lambda w: w <> ''))::INT ELSE 0 END AS highlights
FROM judged""",
        LINES,
        "doc_id, line_no",
    ),
    "occlusion_highlights": f"""WITH {occlusion_ctes()}
SELECT doc_id, line_no, pos, word, importance, is_toxic_token FROM highlights""",
    "trigger_words": f"""WITH {occlusion_ctes()}
SELECT doc_id, line_no, coalesce(string_agg(word, ', ' ORDER BY pos) FILTER (is_toxic_token), '') AS trigger_words
FROM highlights GROUP BY doc_id, line_no""",
    "batch_report": with_scores(REPORT),
    "heads_report": HEADS_REPORT.replace("{report}", REPORT),
    "heads_highlights": HEADS_HIGHLIGHTS,
    "batch_summary": with_scores(SUMMARY),
    "toxic_rows": with_scores(f"{REPORT} WHERE overall_score >= {fixed.THRESHOLD}"),
    "category_metadata": with_scores(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT {q(c)} AS label, {q(display)} AS display, {q(text)} AS description, "
            f"count(*) FILTER ({c} >= {fixed.THRESHOLD}) AS comments FROM judged"
            for c, (display, text) in fixed.CATEGORIES.items()
        )
        + ") WHERE comments > 0"
    ),
    "expected_vs_predicted": f"""WITH {judged_labels_ctes()}
SELECT doc_id, actual AS expected, pred AS predicted FROM pairs""",
    "confusion_matrix": with_matrix("SELECT actual, pred, n FROM matrix"),
    "confusion_wide": with_matrix(
        """SELECT 'Actual_' || actual AS class, sum(n) FILTER (pred = 'clean')::BIGINT AS Pred_clean,
  sum(n) FILTER (pred = 'toxic')::BIGINT AS Pred_toxic, 0 AS "Pred_(other)" FROM matrix GROUP BY actual
UNION ALL SELECT 'Actual_(other)', 0, 0, 0"""
    ),
    "matrix_roundtrip": with_matrix(
        """SELECT 'Actual_' || actual AS class, sum(n) FILTER (pred = 'clean')::BIGINT AS Pred_clean,
  sum(n) FILTER (pred = 'toxic')::BIGINT AS Pred_toxic FROM matrix GROUP BY actual"""
    ),
    "metrics_document": with_matrix(
        f"""SELECT 'lexicon' AS model, round(macro_f1, 4) AS macro_f1, round(weighted_f1, 4) AS weighted_f1,
  round(accuracy, 4) AS accuracy, '["clean","toxic"]' AS classes,
  (SELECT '[[' || string_agg(n, ',' ORDER BY pred) FILTER (actual = 'clean') || '],['
     || string_agg(n, ',' ORDER BY pred) FILTER (actual = 'toxic') || ']]' FROM matrix) AS confusion_matrix,
  {", ".join(f"(SELECT round({x}, 6)::DOUBLE FROM report WHERE label = '{c}') AS {c}_{y}"
             for c in ("clean", "toxic")
             for x, y in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"), ("support", "support")))},
  round(accuracy, 6) AS report_accuracy, round(macro_f1, 6) AS macro_avg_f1,
  (SELECT sum(support)::DOUBLE FROM report) AS weighted_avg_support
FROM (SELECT {HEADLINE})"""
    ),
    "class_report": with_matrix(
        """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM report"""
    ),
    "summary_metrics": with_matrix(
        """SELECT round((SELECT avg((actual = pred)::INT) FROM pairs), 6) AS accuracy,
  round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
  round(avg(f1), 6) AS macro_f1,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  sum(support)::BIGINT AS support FROM report"""
    ),
    "log_loss": f"""WITH {judged_labels_ctes()}
SELECT round(avg(-ln(greatest(CASE WHEN actual = 'toxic' THEN p_toxic ELSE 1.0 - p_toxic END, 1e-15))), 6) AS log_loss
FROM pairs""",
    "model_compare": model_compare(),
}
ORACLE["stream_score"] = ORACLE["batch_report"]
ORACLE["stream_summary"] = ORACLE["batch_summary"]
