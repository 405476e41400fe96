"""The same in DuckDB SQL, where SQL can say it: whole queries (near duplicates, archives), or the columns of a query that
don't depend on its method (edited texts, base spans of secrets, the smoothed word model)."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: crc32 of doc_id as text, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), "
    "lambda c, ch: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, ch)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
)

#: Sets are compared once each; only sets whose sizes allow a link are joined. Components are what links reach.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS sh FROM w),
node AS (SELECT sh, min(doc_id) AS node, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
g AS (SELECT node, n, unnest(sh) AS g FROM node),
met AS (SELECT a.node AS a, b.node AS b, a.n AS x, b.n AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM met WHERE 100 * k >= 80 * (x + y - k) UNION ALL SELECT b, a FROM met WHERE 100 * k >= 80 * (x + y - k)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a AS node, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(root, node.node, s.doc_id) AS component_id, coalesce(root, node.node, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN node ON node.sh = s.sh AND len(s.sh) > 0 LEFT JOIN root ON root.node = node.node
"""

_URL = "replace(replace(replace(replace(replace(coalesce(url, ''), ' ', '%20'), chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09'), chr(0), '%00')"
_REST = f"string_split(regexp_replace({_URL}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#')[1]"
_PART = lambda k: f"regexp_extract(rest, '^(?:[^/?@]*@)?([^/?:]*)(:\\d+)?(.*)', {k})"
ARCHIVES = f"""
WITH p AS (SELECT page_id, {_REST} AS rest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1),
r AS (SELECT p.*, first IS NOT NULL AND payload_bytes >= 1000 AND page_id <> first AS again, first FROM p LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
array_to_string(list_reverse(string_split(rtrim(lower({_PART(1)}), '.'), '.')), ',') || CASE WHEN {_PART(2)} IN (':80', ':443') THEN '' ELSE {_PART(2)} END || ')' || CASE WHEN {_PART(3)} = '' THEN '/' ELSE {_PART(3)} END AS urlkey,
strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 31536000), '%Y%m%d%H%M%S') AS ts FROM r
"""

EDITED_TEXTS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC, t), first_value(t) OVER (ORDER BY doc_id DESC, t)) AS x FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(x, 1, n // 2)) AS edited_sha256 FROM n
"""


def _spans(order: int, kind: str, pattern: str, good: str = "true") -> str:
    """Structs of a kind's finds: what lies between them and the finds themselves give their places."""
    hit, gap, value = f"regexp_extract_all(t, '{pattern}')", f"string_split_regex(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}', {2 if kind == 'assign' else 0})"
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda z: length(z))), 0)"
    start = f"({size(f'{kind}_gap[1:i]')} + {size(f'{kind}_hit[1:i - 1]')})"
    found = f"list_filter(list_transform(range(1, len({kind}_hit) + 1), lambda i: {{'s': CAST({start} AS BIGINT), 'o': {order}, 'k': '{kind}', 'e': CAST({start} + length({kind}_hit[i]) AS BIGINT), 'v': length({kind}_value[i])}}), lambda z: {good})"
    return f"{hit} AS {kind}_hit, {gap} AS {kind}_gap, {value} AS {kind}_value|{found}"


# runs are the longest at their place, so the length can stand in the pattern
_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(map(_EITHER, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = _spans(0, "assign", f"({_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "z.v >= 6").split("|list_filter")
_ACCESS = _spans(1, "access", "AKIA[A-Z0-9]{16,}").split("|list_filter")
_HEX = _spans(2, "hex", "[0-9a-f]{24,}").split("|list_filter")
BASE_SPANS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, {_ASSIGN[0]}, {_ACCESS[0]}, {_HEX[0]} FROM d),
f AS (SELECT doc_id, list_filter{_ASSIGN[1]} AS a, list_filter{_ACCESS[1]} AS k, list_filter{_HEX[1]} AS x FROM h)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(k) AS BIGINT) AS n_access, CAST(len(x) AS BIGINT) AS n_hex,
sha256(array_to_string(list_transform(list_sort(list_concat(a, list_concat(k, x))), lambda z: z.k || ':' || z.s || ':' || z.e), ',')) AS base_sha256 FROM f
"""

WORD_MODEL = f"""
WITH t AS (SELECT doc_id, {_CRC} % 5 = 1 AS held_out, unnest(list_append({_WORDS}, '')) AS w FROM documents),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c.c IS NOT NULL) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens,
round(sum(log10((coalesce(c.c, 0) + 0.5::DOUBLE) / (n.n + 0.5::DOUBLE * (n.v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (w) CROSS JOIN n GROUP BY 1, 2
"""
