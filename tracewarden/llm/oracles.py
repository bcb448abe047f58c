"""DuckDB SQL for the operators that it can express, over the test tables as views."""

from __future__ import annotations

import string

WORD = r"'[^\x20\x09-\x0D]+'"
WORDS = f"w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents))"
LOWER = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

LINE_DEDUP = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l),
s AS (SELECT line, count(DISTINCT coalesce('s' || source, 'null')) AS sites, min({'d': doc_id, 'n': n}) AS first FROM b WHERE line <> '' GROUP BY line),
j AS (SELECT b.doc_id, n, raw, b.line, coalesce(sites >= 10 AND (first.d <> doc_id OR first.n <> n), false) AS gone FROM b LEFT JOIN s ON s.line = b.line)
SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""

SUBSTRING_DEDUP = f"""
WITH {WORDS}, g AS (SELECT doc_id, p, word, CASE WHEN p + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS run FROM w),
f AS (SELECT *, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1 AS again FROM g),
c AS (SELECT doc_id, p, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f)
SELECT doc_id, count(word) AS n_words, count(*) FILTER (gone = 1) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '')) AS kept_sha256 FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id"""

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a), m AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size, CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent, sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total FROM w),
lv AS (SELECT arg_min(CAST(total - spent AS DOUBLE) / free, {{'r': source_size / weight, 'p': place}}) AS level FROM o WHERE 3 * source_size >= CAST(total - spent AS DOUBLE) / free * weight),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM w, lv),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS sent FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(e * source_size + sent AS BIGINT) AS due FROM q, range(3) r(e) WHERE size > 0 AND e * source_size + sent - size <= target),
a AS (SELECT doc_id, size, sum(size) OVER (ORDER BY due / target, source IS NULL, source, e, key, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM c),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM a WHERE spent <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN k USING (doc_id)"""

MINHASH = f"""
WITH RECURSIVE {WORDS}, g AS (SELECT doc_id, p, n, string_agg({LOWER % "word"}, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM w),
s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE p + 4 <= n OR (n < 5 AND p = 1)), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), m AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(c.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, sha256({LOWER % "coalesce(text, '')"}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM t WINDOW g AS (PARTITION BY text_sha256)"""

_SIGNS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_DIGIT = " || ".join(f"substr({_SIGNS}, CAST((v >> {b} & 31) + 1 AS INT), 1)" for b in (15, 10, 5, 0))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INT), 5) AS BIGINT)), lambda v: {_DIGIT}), '') AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d"""

_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER % "coalesce(text, '')"}, {_PLAIN}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER % "coalesce(text, '')"}, {_PLAIN}) AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[p : p + 9], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
w AS (SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k)),
h AS (SELECT w.doc_id, w.k, w.p, g.item_id FROM w JOIN g ON g.gram = w.gram AND g.k = w.k),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id),
c AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS word FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN i USING (doc_id) LEFT JOIN c USING (doc_id)"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, CAST(list_inner_product(a.e, d.e) AS BIGINT) AS score FROM v a JOIN v d ON a.vec_id % 100 = 0 AND a.vec_id <> d.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER g AS INT) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW g AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER g <= 10"""

_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"
PERIODIC_RUNS = f"""
WITH h AS (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
t AS (SELECT doc_id, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[CAST(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END AS BIGINT) + 1]) ELSE ws END AS ws FROM p),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM t),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)),
r AS (SELECT doc_id, start, m + q AS length, min(q) AS period FROM s GROUP BY ALL),
o AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, {{'l': -length, 's': start, 'p': period}}) AS top, string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)"""

SQL = {"op1_line_dedup": LINE_DEDUP, "op2_substring_dedup": SUBSTRING_DEDUP, "op3_embedding_dedup": EMBEDDING_DEDUP, "op4_mixing": MIXING, "op6_minhash": MINHASH, "op7_exact_dedup": EXACT_DEDUP, "op10_warc": WARC, "op11_decontamination": DECONTAMINATION, "op12_hard_negatives": HARD_NEGATIVES, "op13_periodic_runs": PERIODIC_RUNS}
