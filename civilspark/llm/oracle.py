"""DuckDB SQL of the operators that SQL can express."""

from civilspark.llm.secrets import BASE_RULES, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('coalesce(text, {0})')}, '[^\x20\x09-\x0D]+')".replace(
    "{0}", "''"
)


def _kind_spans(rank: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return rf"""
      SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, unnest(list_filter(
        list_transform(range(1, len(found) + 1), lambda i: struct_pack(
          a := list_sum(list_transform(pieces[1:i], lambda p: length(p)))
             + coalesce(list_sum(list_transform(found[1:i - 1], lambda p: length(p))), 0),
          n := length(found[i]),
          v := length(vals[i]))),
        lambda s: s.v >= {rule.least})) AS s
      FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces,
                   regexp_extract_all(text, '{pattern}', 0) AS found,
                   regexp_extract_all(text, '{pattern}', {rule.group}) AS vals
            FROM d)
      WHERE len(found) > 0"""


_SPANS = "\n      UNION ALL".join(_kind_spans(k, r) for k, r in enumerate(RULES))
_BASE = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
_SPAN = "kind || ':' || a || ':' || e"
_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES
)

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS (SELECT doc_id, kind, rank, s.a AS a, s.a + s.n AS e FROM ({_SPANS}))
SELECT doc_id, {_COUNTS},
       sha256(coalesce(string_agg({_SPAN}, ',' ORDER BY a, rank) FILTER (WHERE kind IN ({_BASE})), ''))
         AS base_sha256,
       coalesce(string_agg({_SPAN}, ',' ORDER BY a, rank) FILTER (WHERE kind IS NOT NULL), '')
         AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""

OP2 = rf"""
WITH w AS (
  SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS pos FROM documents),
vocab AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, encode(word)) + 1 AS id
  FROM (SELECT word, count(*) AS n FROM w GROUP BY word)
  QUALIFY row_number() OVER (ORDER BY n DESC, encode(word)) <= 2046),
size AS (SELECT count(*) + 2 AS v FROM vocab),
ids AS (
  SELECT doc_id, pos, coalesce(id, 0) AS id FROM w LEFT JOIN vocab USING (word)
  UNION ALL SELECT doc_id, max(pos) + 1, 1 FROM w GROUP BY doc_id),
pairs AS (
  SELECT doc_id, coalesce(lag(id) OVER (PARTITION BY doc_id ORDER BY pos), 1) AS h, id AS w
  FROM ids),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (
  SELECT h, w, count(*) AS b, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)) AS t
  FROM pairs GROUP BY h, w),
singles AS (SELECT w, sum(b) AS b, sum(t) AS t FROM counts GROUP BY w),
firsts AS (SELECT h, sum(b) AS b, sum(t) AS t FROM counts GROUP BY h),
total AS (SELECT sum(b) AS b, sum(t) AS t FROM counts),
losses AS (
  SELECT c.h, c.w,
    -ln((c.t + 100 * (s.t + 1) / (total.t + v)) / (f.t + 100)) AS lt,
    -ln((c.b + 100 * (s.b + 1) / (total.b + v)) / (f.b + 100)) AS lb
  FROM counts c JOIN singles s USING (w) JOIN firsts f USING (h), total, size),
scored AS (
  SELECT doc_id, count(*) AS n, avg(lt) AS t, avg(lb) AS b
  FROM pairs JOIN losses USING (h, w) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(t, 6) AS target_loss,
       round(b, 6) AS background_loss, round(t - b, 6) AS difference
FROM documents LEFT JOIN scored USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s
  FROM w WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sizes
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS component FROM reach GROUP BY x) USING (doc_id)
"""

OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT e.vec_id, coalesce(k, 0) AS n_links, coalesce(c, e.vec_id) AS component_id,
       e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT x AS vec_id, count(*) AS k FROM links GROUP BY x) USING (vec_id)
LEFT JOIN (SELECT x AS vec_id, min(y) AS c FROM reach GROUP BY x) USING (vec_id)
"""

_KEY = _LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")

OP7 = rf"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
lines AS (
  SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM parts),
keyed AS (SELECT *, {_KEY} AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT doc_id, line, pos, holder IS NOT NULL AND doc_id <> holder AS gone
  FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM judged GROUP BY doc_id
"""

# CRC-32 from its polynomial; the words have code points up to U+00FF.
_CRC_TABLE = """
crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)),
                 lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
        FROM range(256) AS r(i)))"""


def _crc32(text: str) -> str:
    bytes_ = f"""flatten(list_transform(string_split({text}, ''), lambda c:
      CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT]
           ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END))"""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _tree(name: str, base: str) -> str:
    return f"""
{name} AS (
  {base}
  UNION ALL
  SELECT lv + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY lv, tree, pos // 2, n)"""


def _walk(name: str, nodes: str, base: str) -> str:
    return f"""
{name} AS (
  {base}
  UNION ALL
  SELECT w.id, w.tree, w.lv + 1, w.pos // 2, (w.n + 1) // 2,
         sha256(CASE WHEN s.h IS NULL THEN f WHEN w.pos % 2 = 0 THEN f || s.h ELSE s.h || f END),
         proof || coalesce(s.h, '')
  FROM {name} w LEFT JOIN {nodes} s ON s.lv = w.lv AND s.tree = w.tree AND s.pos = xor(w.pos, 1)
  WHERE w.n > 1)"""


OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS altered
  FROM documents, crc),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n
  FROM hashed),
{_tree('nodes', 'SELECT 0 AS lv, tree, pos, n, leaf AS h FROM leaves')},
subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
{_tree('tops', 'SELECT 0 AS lv, 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM subroots')},
root AS (SELECT h FROM tops WHERE n = 1),
{_walk('inner_walk', 'nodes', "SELECT id, tree, 0 AS lv, pos, n, coalesce(altered, leaf) AS f, '' AS proof FROM leaves")},
{_walk('walk', 'tops', "SELECT id, 0 AS tree, 0 AS lv, tree AS pos, (SELECT count(*) FROM subroots) AS n, f, proof FROM inner_walk WHERE n = 1")}
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256,
       w.f AS folded_root, w.f = r.h AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN walk w ON w.id = l.id AND w.n = 1, root r
"""

OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, {_LOWER.format('run')} AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, c, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h, length(run) AS l FROM runs, crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % l)::INT) || substr(run, (h % l + 2)::INT) ELSE run END AS word,
         sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2),
dels AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, (i + 2)::INT) AS d
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
steps AS (
  SELECT DISTINCT a.word AS long, a.n AS long_n, b.word AS short, b.n AS short_n
  FROM dels a JOIN words b ON a.d = b.word),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n
  FROM dels a JOIN dels b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION ALL SELECT long, short, short_n FROM steps
  UNION ALL SELECT short, long, long_n FROM steps),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other,
         max(other_n) AS other_n
  FROM near GROUP BY word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
         CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT word, form, root, n, n_near, form_n
FROM formed JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""

OP13 = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
budget AS (SELECT sum(source_size)::DOUBLE * 3 / 2 AS b, sum(weight) AS w FROM sources),
ratios AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / weight AS ratio FROM sources),
levels AS (
  SELECT *, (b - (sum(cap) OVER o - cap)) / (w - (sum(weight) OVER o - weight)) AS level
  FROM ratios, budget
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
found AS (SELECT min(level) AS level FROM (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)),
targets AS (
  SELECT source, source_size, least(cap, coalesce(weight * found.level, cap)) AS target FROM levels, found),
queues AS (
  SELECT doc_id, sized.source AS source, size, source_size, target,
         sum(size) OVER (PARTITION BY sized.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING)
           ::BIGINT AS place
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
entries AS (
  SELECT source, place, pass, (pass * source_size + place) / target AS finish,
         least(size, ceil(target)::BIGINT - (pass * source_size + place - size)) AS given
  FROM queues, (SELECT unnest([0, 1]) AS pass) WHERE size > 0),
merged AS (
  SELECT *, sum(given) OVER (ORDER BY finish, source NULLS LAST, pass, place ROWS UNBOUNDED PRECEDING) AS upto
  FROM entries WHERE given > 0),
words AS (
  SELECT source, place, sum(least(given, floor(b)::BIGINT - (upto - given)))::BIGINT AS taken
  FROM merged, budget WHERE upto - given < floor(b)::BIGINT GROUP BY ALL)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END AS taken
FROM queues q LEFT JOIN words w ON q.place = w.place AND q.source IS NOT DISTINCT FROM w.source
"""

ORACLE = {
    "op1_secrets": OP1,
    "op2_lm_score": OP2,
    "op3_jaccard": OP3,
    "op6_embeddings": OP6,
    "op7_lines": OP7,
    "op11_manifest": OP11,
    "op12_spelling": OP12,
    "op13_mixing": OP13,
}
