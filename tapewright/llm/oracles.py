"""Check SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from .quality import CLASS_LIMIT, CLASSES, MIN_CHARS, MIN_WORDS, WORD_LIMIT, vocabulary
from .secrets import BASE, RULES

WORD = r"[^\x20\x09-\x0D]+"
LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingles_sql(table: str, key: str) -> str:
    """Distinct (key, s) of a table: 5-word shingles, or all words of a shorter text."""
    return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ') || '  ']
  ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s
  FROM (SELECT {key}, regexp_extract_all({LOW.format(t="coalesce(text, '')")}, '{WORD}') AS w FROM {table}))"""


OP1 = f"""
WITH d AS {shingles_sql('documents', 'doc_id')}, i AS {shingles_sql('benchmark', 'item_id')},
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_common FROM d JOIN i USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n"""

OP5 = f"""
WITH RECURSIVE d AS MATERIALIZED {shingles_sql('documents', 'doc_id')},
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(b, t.doc_id)) AS component_id,
  t.doc_id = least(t.doc_id, coalesce(b, t.doc_id)) AS kept
FROM documents t LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = t.doc_id"""


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _distance(counts: str, reference: str) -> str:
    p, q = f"list_transform({counts}, lambda x: x / list_sum({counts}))", f"list_transform({reference}, lambda x: x / list_sum({reference}))"
    part = "list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END))"
    return f"sqrt(greatest(0, ({part.format(p=p, q=q)} + {part.format(p=q, q=p)}) / 2))"


_BINS = len(CLASSES) + 2, len(vocabulary()) + 2
OP6 = f"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7])) AS g FROM base WHERE len(w) >= 8)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM seen WHERE c > 1) GROUP BY 1),
counts AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count(CLASSES["symbol"])} AS n_symbols, length(t) AS n_chars,
  (SELECT count(*) - count(DISTINCT l) FROM (SELECT unnest(string_split(t, chr(10))) AS l) WHERE regexp_matches(l, '{WORD}')) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, [{", ".join(f"CAST({_count(p)} AS DOUBLE)" for p in CLASSES.values())}] AS signs,
  [{", ".join(f"CAST(len(list_filter(w, lambda x: lower(x) = '{v}')) AS DOUBLE)" for v in vocabulary())}] AS found,
  CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z0-9]|[^\\x00-\\x7F]'))) AS DOUBLE) AS bare
  FROM base LEFT JOIN repeated r USING (doc_id)),
hist AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  list_concat(signs, [n_chars - word_chars, word_chars - list_sum(signs)]) AS classes, list_concat(found, [bare, n_words - list_sum(found) - bare]) AS commons FROM counts),
refs AS (SELECT lang, [{", ".join(f"sum(classes[{i}])" for i in range(1, _BINS[0] + 1))}] AS rc, [{", ".join(f"sum(commons[{i}])" for i in range(1, _BINS[1] + 1))}] AS rw
  FROM hist WHERE NOT base_failed GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= {MIN_CHARS} AND {_distance("classes", "rc")} > {CLASS_LIMIT}, false)
  AND NOT coalesce(n_words >= {MIN_WORDS} AND {_distance("commons", "rw")} > {WORD_LIMIT}, false) AS kept
FROM hist LEFT JOIN refs USING (lang)"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _spans_sql(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    if kind == "assign":  # letters of either case, ASCII only
        words = "|".join(map(_any_case, ["password", "passwd", "secret", "token"])) + f"|{_any_case('api')}_?{_any_case('key')}"
        p = "(" + words + ")" + p.split("))", 1)[1]
    return f"""SELECT doc_id, {order} AS k, '{kind}' AS kind, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
  length(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS p FROM base)) WHERE length(v[i]) >= {least}"""


OP9 = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans_sql(i, r.kind, r.pattern, r.value_group, r.least) for i, r in enumerate(RULES))}),
found AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (k < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM spans GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found USING (doc_id)"""

#: All pairs, and all that a vector reaches; every vector of the tables is valid.
OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.a = v.vec_id
"""

#: Remainders of the checksum, eight shifts of each byte.
_CRC_TABLE = """(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda t, z: xor(t >> 1, 3988292384 * (t & 1))) ORDER BY i) AS crc FROM range(0, 256) r(i))"""


def _crc(data: str) -> str:
    """Checksum of a list of bytes; ``crc`` is the table."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, 128 + (CAST(unicode(c) AS BIGINT) & 63)] END))"
_EDITS = "list_distinct(list_transform(range(1, length(word) + 1), lambda i: {'cut': i, 'rest': substr(word, 1, i - 1) || substr(word, i + 1)}))"

#: Words that differ in one place leave the same rest there; a word that is another's rest lacks one code point.
OP12 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_crc(_BYTES)} AS h FROM (SELECT *, CAST(doc_id AS VARCHAR) || ':' || run AS s FROM runs), {_CRC_TABLE}),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
edits AS (SELECT word, n, e['cut'] AS cut, e['rest'] AS rest FROM (SELECT word, n, unnest({_EDITS}) AS e FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM edits a JOIN edits b ON a.cut = b.cut AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM edits a JOIN words b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM edits a JOIN words b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain(word, final) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.final WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.final AS root
FROM forms f JOIN chain c ON c.word = f.word JOIN forms l ON l.word = c.final AND l.form IS NULL
"""

_DIGITS = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))"

#: All prefixes of all conversations; a subtree is what has a node among its prefixes.
OP13 = f"""
WITH turns AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY place) AS t FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, {_crc(_DIGITS)} % 4 AS h FROM own, {_CRC_TABLE}),
built AS (
  SELECT o.conv_id, list_concat(coalesce(f.t[1:h], []), o.t[h + 1:]) AS t
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (
  SELECT conv_id, d AS depth, len(t) = d AS is_end, md5(list_aggregate(list_transform(t[1:d], lambda x: x.id), 'string_agg', ',')) AS id,
    md5(list_aggregate(list_transform(t[1:d - 1], lambda x: x.id), 'string_agg', ',')) AS up, t[d].words AS words
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM built)),
nodes AS (
  SELECT depth, coalesce(id, '') AS id, CASE WHEN depth > 0 THEN coalesce(any_value(up), '') END AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, coalesce(id, '')),
below AS (SELECT DISTINCT coalesce(a.id, '') AS top, a.depth AS top_depth, coalesce(b.id, '') AS id, b.depth FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
children AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT b.top, b.top_depth, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((s.n_convs - 1) * s.words) AS saved
  FROM below b JOIN nodes s ON s.id = b.id AND s.depth = b.depth LEFT JOIN children c ON c.up = s.id AND c.depth = s.depth GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.id AND s.top_depth = n.depth
LEFT JOIN nodes p ON p.id = n.up AND p.depth = n.depth - 1 LEFT JOIN children c ON c.up = n.id AND c.depth = n.depth
"""
