"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '%s') AS ws"

OP5_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS % r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'} FROM benchmark),
s AS (SELECT item, ws, least(len(ws), 10) AS size FROM b WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM s)),
d AS (SELECT doc_id, {_WORDS % r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'} FROM documents),
grams AS (
  SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size)),
m AS (SELECT doc_id, i, grams.size, item FROM grams JOIN windows ON windows.g = grams.g AND windows.size = grams.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS % r'[^\x20\x09-\x0D]+'} FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n j ON j.doc_id = x JOIN n k ON k.doc_id = y WHERE 100 * c >= 80 * (j.n + k.n - c)),
sym AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
t(node, m) AS (SELECT x, y FROM sym UNION SELECT t.node, sym.y FROM t JOIN sym ON sym.x = t.m),
c AS (SELECT node, least(node, min(m)) AS component FROM t GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""

_LOWER = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"


def _crc32(s: str) -> str:
    """The checksum of a string's UTF-8 bytes, bit by bit (its polynomial is a fixed value)."""
    byte = f"CAST(('0x' || substr(hex(encode({s})), 2 * i - 1, 2)) AS BIGINT)"
    step = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, strlen({s}) + 1), lambda i: {byte}), lambda c, b: {step}), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
h AS MATERIALIZED (SELECT run, count(*) AS times, {_crc32("d || ':' || run")} AS crc FROM r WHERE length(run) >= 7 GROUP BY d, run),
w AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT times, CASE WHEN crc % 31 = 0 THEN substr(run, 1, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
pair AS (
  SELECT cut.word AS a, w.word AS b FROM cut JOIN w ON cut.rest = w.word
  UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.rest = w.word
  UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS near, max(w.n) AS near_n FROM pair JOIN w ON w.word = b GROUP BY a),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN near ON near.word = w.word),
t(word, root) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word JOIN f AS g ON g.word = t.root AND g.form IS NULL
"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"


_CHANGED = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
_LEAF, _OTHER = (" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", t))) for t in ("text", _CHANGED))

OP13_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, source, sha256({_LEAF}) AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({_OTHER}) END AS other
  FROM documents),
p AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM d),
low AS (
  SELECT g, 0 AS lev, k, n, leaf AS h FROM p
  UNION ALL SELECT g, lev + 1, k // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM low WHERE n > 1 GROUP BY g, lev, k // 16, n),
sub AS MATERIALIZED (SELECT g, h AS subroot, max(lev) OVER () AS most FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lev, g AS k, (SELECT count(*) FROM sub) AS n, subroot AS h FROM sub
  UNION ALL SELECT lev + 1, k // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY k)) FROM high WHERE n > 1 GROUP BY lev, k // 16, n),
runs AS MATERIALIZED (
  SELECT g, lev, k // 16 AS q, list(h ORDER BY k) AS run FROM low WHERE n > 1 GROUP BY g, lev, k // 16
  UNION ALL SELECT -1, lev, k // 16, list(h ORDER BY k) FROM high WHERE n > 1 GROUP BY lev, k // 16),
climb AS (
  SELECT row, g AS own, g, 0 AS lev, k, coalesce(other, leaf) AS h, '' AS proof, false AS done FROM p
  UNION ALL
  SELECT row, own, CASE WHEN run IS NULL THEN -1 ELSE c.g END, CASE WHEN run IS NULL THEN 0 ELSE c.lev + 1 END, CASE WHEN run IS NULL THEN own ELSE k // 16 END,
    CASE WHEN run IS NULL THEN h ELSE sha256(array_to_string(run[: k % 16] || [h] || run[k % 16 + 2 :], '')) END,
    CASE WHEN run IS NULL THEN proof ELSE proof || array_to_string(run[: k % 16] || run[k % 16 + 2 :], '') END,
    run IS NULL AND c.g = -1
  FROM climb c LEFT JOIN runs ON runs.g = c.g AND runs.lev = c.lev AND runs.q = c.k // 16 WHERE NOT done)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM p JOIN climb c ON c.row = p.row AND done JOIN sub ON sub.g = p.g, (SELECT h FROM high WHERE n = 1) r
"""
