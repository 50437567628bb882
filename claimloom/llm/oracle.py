"""DuckDB counterparts of the registered training-data queries, where SQL can express them.

No counterpart: op2 (merges of a rank queue), op3 (its tests are statistics on characters), op4 (MinHash), op5 (every
400-byte string of every text is too slow in SQL), op8 and the pipeline (a trained model), op11 (hypergeometric draws). tests/llm
checks these against brute-force versions, exact round trips or held-out labels.
"""

from __future__ import annotations

from claimloom.llm import quality
from claimloom.llm.queries import URL_RULES
from claimloom.llm.url_filters import SAME_PAGE

BLANKS = r"[\x20\x09-\x0D]+"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _kept(outside: str) -> str:
    return "length(regexp_replace(t, '{}', '', 'g'))".format(outside.replace("'", "''"))


def _divergence(counts: str, reference: str) -> str:
    """Jensen-Shannon distance of two count lists of one length."""
    p, q = f"x[1] / list_sum({counts})", f"x[2] / list_sum({reference})"
    part = lambda a: f"CASE WHEN {a} > 0 THEN ({a}) * log2(({a}) / ((({p}) + ({q})) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({counts}, {reference}), lambda x: {part(p)} + {part(q)})) / 2, 0))"


def _quality() -> str:
    inner = [_kept(f"[^{c}]+") for c in quality.CLASSES]
    ascii_ = _kept(r"[^\x00-\x7F]+")
    char_counts = f"[{', '.join(inner)}, {ascii_} - ({' + '.join(inner)}), length(t) - {ascii_}]"
    found = " ".join(f"WHEN '{name}' THEN {_strings(words)}" for name, words in quality.COMMON_WORDS.items())
    n_classes = len(quality.CLASSES) + 2
    limit = lambda top, k, n: f"sqrt({top * top} + {quality.NOISE} * {k} / (8 * ln(2) * {n}))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '{BLANKS}'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, ws[i:i + 4] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT r, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM win JOIN dup USING (r, k), range(5) AS o(j) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
lists AS (SELECT r, CASE lang {found} END AS common FROM d),
m AS (
  SELECT r, doc_id, lang, len(ws) AS n_words, {_kept(BLANKS)} AS word_chars, {_kept('[^#*$%&|<>]+')} AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, {char_counts} AS cc,
    list_transform(common, lambda c: len(list_filter(ws, lambda x: lower(x) = c))) AS found
  FROM d JOIN w USING (r) JOIN lines USING (r) JOIN lists USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, found || [n_words - list_sum(found)] AS wc, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
sound AS (SELECT * FROM b WHERE wc IS NOT NULL AND NOT base_failed AND n_words >= {quality.GUARD_WORDS}),
cref AS (SELECT lang, list(s ORDER BY i) AS cr FROM (SELECT lang, i, sum(cc[i]) AS s FROM sound, range(1, {n_classes + 1}) AS o(i) GROUP BY ALL) GROUP BY lang),
wref AS (SELECT lang, list(s ORDER BY i) AS wr FROM (SELECT lang, i, sum(wc[i]) AS s FROM sound, range(1, 101) AS o(i) WHERE i <= len(wc) GROUP BY ALL) GROUP BY lang),
j AS (SELECT b.*, CASE WHEN list_sum(cc) > 0 THEN {_divergence('cc', 'cr')} END AS cd, CASE WHEN list_sum(wc) > 0 THEN {_divergence('wc', 'wr')} END AS wd
  FROM b LEFT JOIN cref USING (lang) LEFT JOIN wref USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars >= {quality.GUARD_CHARS} AND cd > {limit(quality.CHAR_LIMIT, n_classes, 'word_chars')}, false)
  AND NOT coalesce(n_words >= {quality.GUARD_WORDS} AND wd > {limit(quality.WORD_LIMIT, 26, 'n_words')}, false) AS kept
FROM j"""


_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWERED.format("coalesce(text, '')")}, '{BLANKS}'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i:i + 4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM w
  UNION SELECT CASE WHEN l.a = node THEN l.b ELSE l.a END, root FROM reach JOIN links AS l ON l.a = node OR l.b = node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) USING (doc_id)"""

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS s FROM p),
f AS (SELECT s, min(page_id) AS first FROM h GROUP BY s),
bits AS (SELECT DISTINCT s, unhex(s)::BIT::VARCHAR AS b FROM h),
digest AS (SELECT s, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(b[i + 1] AS INT) + 8 * cast(b[i + 2] AS INT) + 4 * cast(b[i + 3] AS INT) + 2 * cast(b[i + 4] AS INT) + cast(b[i + 5] AS INT), 1), '' ORDER BY i) AS d
  FROM bits, range(0, 160, 5) AS o(i) GROUP BY s)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (s) JOIN digest USING (s)"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
iw AS (SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{_WORDS}') AS ws FROM benchmark),
win AS (
  SELECT item, 13 AS s, ws[i:i + 12] AS k FROM (SELECT item, ws, unnest(range(1, len(ws) - 11)) AS i FROM iw WHERE len(ws) >= 13)
  UNION SELECT item, len(ws), ws FROM iw WHERE len(ws) BETWEEN 1 AND 12),
sizes AS (SELECT DISTINCT s FROM win),
spots AS (SELECT doc_id, s, i, ws[i:i + s - 1] AS k FROM (SELECT doc_id, ws, s, unnest(range(1, len(ws) - s + 2)) AS i FROM dw, sizes WHERE len(ws) >= s)),
hits AS (SELECT doc_id, item, spots.s, i FROM spots JOIN win ON spots.k = win.k),
n AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT doc_id, s, i FROM hits), range(13) AS r(o) WHERE o < s GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _fits(host: str, path: str) -> tuple[str, str]:
    """(rule text, verdict) of the longest fitting rule as SQL."""
    order = sorted(URL_RULES, key=lambda r: (-len(r.text), r.text))
    when = [f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN " for r in order]
    return tuple("CASE " + " ".join(f"{w}'{v}'" for w, v in zip(when, values, strict=True)) + " END" for values in ([r.text for r in order], [r.verdict for r in order]))


def _urls() -> str:
    host = lambda u: f"coalesce({LOWERED.format(f"regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)")}, '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = lambda u: f"array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '(?s)^.*?://[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{SAME_PAGE}'))), '&')"
    node = lambda u: f"regexp_replace(regexp_replace({host(u)}, ':(80|443)$', ''), '^(www|m)[.]', '') || regexp_replace({path(u)}, '(/index)?([.]html?)?/*$', '') || CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END"
    rule, verdict = _fits("host", "path")
    _, node_verdict = _fits("regexp_extract(b, '(?s)^([^/?]*)', 1)", "regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1)")
    quote = "[\"'']?"
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {host('url')} AS host, {path('url')} AS path FROM pages),
q AS (SELECT *, CASE WHEN host <> '' THEN {node('url')} END AS node, {rule} AS rule, {verdict} AS own FROM p),
tags AS (
  SELECT node, url, host, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*{quote}canonical\b[^>]*>')), '(?is)\bhref\s*=\s*{quote}([^"''\s>]+)', 1) AS t FROM q WHERE node IS NOT NULL
  UNION ALL SELECT node, url, host, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*{quote}refresh\b[^>]*>')), '(?is)\burl\s*=\s*{quote}([^"''\s>;]+)', 1) FROM q WHERE node IS NOT NULL),
to_ AS (
  SELECT node AS a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'https:' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://)', 1) || host || t ELSE regexp_extract(url, '(?s)^(.*?://[^?#]*/)', 1) || t END AS u
  FROM tags WHERE t <> ''),
links AS (SELECT a, {node('u')} AS b FROM to_ WHERE contains(u, '://')),
facts AS (SELECT node AS b, own FROM q WHERE own IS NOT NULL AND node IS NOT NULL UNION SELECT b, {node_verdict} FROM links),
nodes AS (SELECT node AS x FROM q WHERE node IS NOT NULL UNION SELECT b FROM links),
reach(x, root) AS (SELECT x, x FROM nodes UNION SELECT CASE WHEN l.a = x THEN l.b ELSE l.a END, root FROM reach JOIN links AS l ON l.a = x OR l.b = x),
comp AS (SELECT x, min(root) AS c FROM reach GROUP BY x),
spread AS (SELECT c FROM comp JOIN facts ON facts.b = comp.x GROUP BY c HAVING bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), false))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN c IN (SELECT c FROM spread) THEN 'block' END, 'allow') AS verdict
FROM q LEFT JOIN comp ON comp.x = q.node"""


def _repair() -> str:
    add = lambda s, k, letters: f"CASE WHEN {s} = '~' THEN '~' ELSE printf('%012d', cast({s}[1:12] AS BIGINT) + {k}) || {s}[13:] || '{letters}' END"
    # states are cost and audit in one string, for nothing yet, after s, after u, after a; ~ where there is none
    closed = f"s0, s1, least(s2, {add('s0', 3, 'I')}, {add('s1', 3, 'I')}, {add('s3', 3, 'I')}) AS s2, least(s3, {add('s2', 3, 'I')}, {add('s0', 6, 'II')}, {add('s1', 6, 'II')}) AS s3"
    keep = lambda initial, s: f"CASE WHEN goes OR initial <> '{initial}' THEN '~' ELSE {add(s, 'extra', 'K')} END"
    rerole = lambda s: f"CASE WHEN goes THEN '~' ELSE {add(s, '3 + extra', 'R')} END"
    first = "least(s0, s1, s3)"
    bits = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
    step = bits.replace("a ", "xor(a, x) ")
    return rf"""
WITH RECURSIVE b AS (
  SELECT conv_id, coalesce(cast(conv_id AS VARCHAR), ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(range(8 * strlen(k)), lambda i: CASE WHEN i % 8 = 0 THEN ord(k[i // 8 + 1]) ELSE 0 END),
    lambda a, x: {step}), 4294967295) % 20 AS kind FROM b),
d AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(sha256(text), 32), copy) AS pos FROM d),
f AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS goes, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
walk(c, pos, s0, s1, s2, s3) AS (
  SELECT DISTINCT c, cast(0 AS BIGINT), '000000000000', '~', '~', '~' FROM r
  UNION ALL
  SELECT c, pos, {add('s0', 4, 'D')}, least({add('s1', 4, 'D')}, {keep('s', 's0')}), least({add('s2', 4, 'D')}, {keep('u', first)}, {rerole(first)}),
    least({add('s3', 4, 'D')}, {keep('a', 's2')}, {rerole('s2')})
  FROM (SELECT r.c, r.pos, goes, extra, initial, {closed} FROM walk JOIN r ON r.c = walk.c AND r.pos = walk.pos + 1)),
ends AS (SELECT c, least(s0, s3) AS best FROM (SELECT c, pos, {closed} FROM walk) JOIN (SELECT c, max(pos) AS pos FROM r GROUP BY c) USING (c, pos)),
e AS (SELECT c, cast(best[1:12] AS BIGINT) AS cost, best[13:] AS audit FROM ends),
l AS (SELECT c, j, audit[j] AS letter FROM (SELECT c, audit, unnest(range(1, len(audit) + 1)) AS j FROM e)),
m AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY j) AS pos, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY j) AS place FROM l),
o AS (SELECT m.*, CASE WHEN letter = 'I' THEN '' ELSE r.text END AS text, r.role, letter = 'K' AND r.initial = 's' AS is_s FROM m LEFT JOIN r ON r.c = m.c AND r.pos = m.pos AND letter <> 'I' WHERE letter <> 'D'),
q AS (SELECT *, place - max(CASE WHEN is_s THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS nth FROM o),
z AS (SELECT c, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS sha FROM q GROUP BY c),
g AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY pos) AS before FROM r) GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM b) LEFT JOIN g USING (c) LEFT JOIN e USING (c) LEFT JOIN z USING (c)"""


_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_AUDIT = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '{_TERMS}') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, cast(count(*) AS HUGEINT) AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, cast(count(*) AS HUGEINT) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, cast(coalesce(sum(c), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (n.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.c + 2) // (v.n + 2 * v.v) AS q
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10"""


ORACLE_SQL: dict[str, str] = {
    "op1_distribution_divergence": _quality(),
    "op6_jaccard_join": _JACCARD,
    "op7_warc_salvage": _WARC,
    "op9_decontamination": _HITS,
    "op10_url_equivalence": _urls(),
    "op12_branch_and_bound": _repair(),
    "op13_iceberg_refinement": _AUDIT,
}
