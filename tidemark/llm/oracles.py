"""SQL twins of the numbered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOPK = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

NEARDUP = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \\t-\\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
    END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
e AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT reach.d, edges.b FROM reach JOIN edges ON edges.a = reach.r),
c AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.d = n.doc_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best, list_transform(range(8), lambda g: CAST('0x' || substr(x, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)) AS g FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(flatten(list_transform(g, lambda v: [v >> 15 & 31, v >> 10 & 31, v >> 5 & 31, v & 31])),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(k + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to, true AS intact FROM d"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, list_aggregate(w[p:p + k - 1], 'string_agg', ' ') AS x
        FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM iw)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
found AS (SELECT doc_id, p, dw.k, item FROM dw JOIN win ON win.k = dw.k
          AND win.x = list_aggregate(w[p:p + dw.k - 1], 'string_agg', ' ')),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
docs AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
size AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), size),
i AS (SELECT row_number() OVER () AS k, item_id, w FROM (SELECT DISTINCT item_id, {_TERMS} AS w FROM benchmark)),
q AS (SELECT k, t, CAST(count(*) AS BIGINT) AS q FROM (SELECT k, unnest(w) AS t FROM i) GROUP BY ALL),
s AS (SELECT k, r, CAST(sum(q * w * (1000000000 * tf // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN weight USING (t) JOIN tf USING (t) JOIN docs USING (r), size GROUP BY ALL),
o AS (SELECT k, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s JOIN docs USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o JOIN i USING (k) WHERE rank <= 10"""


# entries {c cost, a audit, r repaired rows} of four states: start, behind s, behind u, behind a
_FAR = "{'c': 1000000000, 'a': '', 'r': ''}"


def _edit(entry: str, cost: str, edit: str, row: str | None) -> str:
    rows = f"{entry}.r" if row is None else f"{entry}.r || CASE WHEN {entry}.r = '' THEN '' ELSE chr(10) END || {row}"
    return f"CASE WHEN {entry}.c >= 1000000000 THEN {_FAR} ELSE {{'c': {entry}.c + {cost}, 'a': {entry}.a || '{edit}', 'r': {rows}}} END"


def _inserted(name: str, source: str, keep: str) -> str:
    user = ", ".join(_edit(e, "5", "I", "'user:'") for e in ("e0", "e1", "e3"))
    return f"""{name} AS (SELECT {keep}, e0, e1, least(e2, {user}) AS e2, least(e3, {_edit("e2", "5", "I", "'assistant:'")}) AS e3 FROM {source})"""


def _rows(states: tuple[int, ...], kinds: str, role: str, cost: str, edit: str) -> str:
    return ", ".join(f"CASE WHEN {kinds} THEN {_edit(f'e{p}', cost, edit, f'{role} || chr(58) || text')} ELSE {_FAR} END" for p in states)


_KEPT, _GOOD = "(5 * CAST(fault = 3 AS INTEGER))", "fault IN (0, 3)"

CONVERSATIONS = f"""WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda ch: list_transform(range(8), lambda b: CAST(ascii(ch) >> b & 1 AS BIGINT))))),
      lambda c, b: CASE WHEN (c & 1) <> b THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS crc FROM conversations),
h AS (SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS kind FROM o),
d0 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM h WHERE kind = 3),
d1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k,
  count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM d0),
d2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen, substr(role, 1, 1) AS initial FROM d1),
d AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM d2),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, {{'c': 0, 'a': '', 'r': ''}} AS e0, {_FAR} AS e1, {_FAR} AS e2, {_FAR} AS e3
  FROM (SELECT DISTINCT conv_id FROM d)
  UNION ALL (
  WITH {_inserted("i1", "walk", "conv_id, k")}, {_inserted("i2", "i1", "conv_id, k")},
  r AS (SELECT i2.conv_id, d.k, e0, e1, e2, e3, fault, initial, role, text
        FROM i2 JOIN d ON d.conv_id IS NOT DISTINCT FROM i2.conv_id AND d.k = i2.k + 1)
  SELECT conv_id, k, {_edit("e0", "2", "D", None)},
    least({_edit("e1", "2", "D", None)}, {_rows((0,), f"{_GOOD} AND initial = 's'", "role", _KEPT, "K")}),
    least({_edit("e2", "2", "D", None)}, {_rows((0, 1, 3), f"{_GOOD} AND initial = 'u'", "role", _KEPT, "K")},
          {_rows((0, 1, 3), _GOOD, "'user'", f"1 + {_KEPT}", "R")}),
    least({_edit("e3", "2", "D", None)}, {_rows((2,), f"{_GOOD} AND initial = 'a'", "role", _KEPT, "K")},
          {_rows((2,), _GOOD, "'assistant'", f"1 + {_KEPT}", "R")})
  FROM r)),
lastrow AS (SELECT walk.* FROM walk JOIN (SELECT conv_id, max(k) AS k FROM d GROUP BY conv_id) m
            ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND m.k = walk.k),
{_inserted("f1", "lastrow", "conv_id")}, {_inserted("f2", "f1", "conv_id")},
ends AS (SELECT conv_id, least(e0, e3) AS e FROM f2),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(e.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM c.conv_id"""
