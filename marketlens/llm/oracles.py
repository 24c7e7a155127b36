"""DuckDB SQL for the corpus queries that SQL can express: plain definitions, without the operators' methods."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS BIGINT) AS item_id, regexp_extract_all(lower(text), '{WORD}') AS v FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, v, least(15, len(v)) AS size, CASE WHEN len(v) < 10 THEN len(v) ELSE least(15, len(v)) - least(15, len(v)) * 3 // 15 END AS need FROM b WHERE len(v) >= 5),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
bw AS (SELECT item_id, len(v) AS m, size, need, unnest(v) AS word, generate_subscripts(v, 1) - 1 AS j FROM items),
same AS (SELECT doc_id, item_id, n, m, size, need, i - j AS off, j FROM dw JOIN bw USING (word)),
laid AS (SELECT doc_id, item_id, n, m, size, need, off, list(DISTINCT j) AS js FROM same GROUP BY ALL HAVING count(DISTINCT j) >= need),
places AS (SELECT *, unnest(range(greatest(0, -off), least(m, n - off) - size + 1)) AS i FROM laid),
good AS (SELECT doc_id, item_id, size, off, js, i FROM places WHERE len(list_filter(js, lambda j: j >= i AND j < i + size)) >= need),
runs AS (SELECT doc_id, item_id, off, any_value(js) AS js, min(i) AS lo, max(i) + any_value(size) AS hi FROM good GROUP BY doc_id, item_id, off),
found AS (SELECT doc_id, item_id, off + lo AS start, hi - lo AS n_tokens, len(list_filter(js, lambda j: j >= lo AND j < hi)) AS n_equal FROM runs)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_equal AS BIGINT) AS n_equal
FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_tokens DESC, start) = 1
"""

BLOCK_DEDUP = rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

LINE_DEDUP = rf"""
WITH l AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, raw, regexp_extract_all(raw, '{WORD}') AS ws, array_to_string(regexp_extract_all(raw, '{WORD}'), ' ') AS line FROM l),
f AS (SELECT line, any_value(ws) AS ws, min((doc_id, pos)) AS first FROM w WHERE len(ws) > 0 GROUP BY line),
u AS (
  SELECT line, first, 'w ' AS kind, ws AS us FROM f WHERE len(ws) >= 8
  UNION ALL SELECT line, first, 'c ', list_transform(range(1, length(line) + 1), lambda i: substring(line, i, 1)) FROM f WHERE len(ws) < 8 AND length(line) >= 16),
rest AS (SELECT line, first, kind, i, list_concat(list_slice(us, 1, i - 1), list_slice(us, i + 1, len(us))) AS us FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM u)),
v AS (SELECT line, first, i, kind || CASE kind WHEN 'w ' THEN array_to_string(us, ' ') ELSE array_to_string(us, '') END AS k FROM rest),
near AS (
  SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY k, i) AS earliest FROM v) WHERE earliest < first
  UNION SELECT v.line FROM v JOIN u ON u.kind || u.line = v.k WHERE u.first < v.first
  UNION SELECT u.line FROM v JOIN u ON u.kind || u.line = v.k WHERE v.first < u.first),
judged AS (SELECT w.doc_id, w.pos, w.raw, len(w.ws) > 0 AS solid, len(w.ws) > 0 AND (f.first <> (w.doc_id, w.pos) OR near.line IS NOT NULL) AS gone
  FROM w LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
kept AS (SELECT doc_id, count(*) FILTER (solid) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)) AS text FROM judged GROUP BY doc_id)
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

BYTE_REPEATS = """
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (k)),
steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
islands AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM steps),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY doc_id, island),
ends AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept FROM ends JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 85 * (na.n + nb.n - both_)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
smallest AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.b, d.doc_id)) AS BIGINT) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN smallest m USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES = {"op1_decontamination": DECONTAMINATION, "op3_block_dedup": BLOCK_DEDUP, "op4_line_dedup": LINE_DEDUP, "op7_suffix_dedup": BYTE_REPEATS, "op8_minhash": NEAR_DUPLICATES, "op10_top_k": TOP_K}
