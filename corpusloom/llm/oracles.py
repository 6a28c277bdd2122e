"""DuckDB SQL for the queries that SQL can express, each a plain statement of its contract on the whole tables."""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS learnt,
    sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11)::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM g
"""

NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

#: Rows of one doc_id are one vertex with the links of all its texts.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(words) >= 5 THEN list_distinct([array_to_string(words[i:i+4], ' ') for i in range(1, len(words) - 3)])
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
e AS (SELECT r, doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
links AS (
  SELECT DISTINCT a, b FROM (
    SELECT any_value(a.doc_id) AS a, any_value(b.doc_id) AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n)
    GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*)))),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, coalesce(doc_id = least(doc_id, coalesce(other, doc_id)), true) AS kept
FROM s LEFT JOIN least_of USING (doc_id)
"""

#: Documents come in the order of doc_id and, of unlike texts under one, of the SHA-256 of the text.
SUBSTRINGS = """
WITH k AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, sha256(coalesce(text, ''))) AS doc FROM documents),
d AS (SELECT DISTINCT doc, h FROM k WHERE doc_id IS NOT NULL),
w AS (SELECT doc, p, md5_number(substr(h, 2 * p + 1, 200)) AS name FROM (SELECT doc, h, unnest(range(length(h) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc, p FROM (SELECT doc, p, row_number() OVER (PARTITION BY name ORDER BY doc, p) AS nth FROM w) WHERE nth > 1),
c AS (SELECT doc, p, coalesce(lag(p) OVER (PARTITION BY doc ORDER BY p) + 100 < p, true) AS new_run FROM r),
runs AS (SELECT doc, min(p) AS lo, max(p) + 100 AS hi FROM (SELECT doc, p, sum(new_run::INT) OVER (PARTITION BY doc ORDER BY p) AS run FROM c) GROUP BY doc, run),
gone AS (SELECT doc, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed FROM runs GROUP BY doc),
kept AS (
  SELECT doc, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS rest FROM (
    SELECT d.doc, d.h, x.lo, x.hi FROM d JOIN (
      SELECT doc, coalesce(lag(hi) OVER (PARTITION BY doc ORDER BY lo), 0) AS lo, lo AS hi FROM runs
      UNION ALL SELECT doc, max(hi), NULL FROM runs GROUP BY doc) y USING (doc), (SELECT y.lo AS lo, coalesce(y.hi, length(d.h) // 2) AS hi) x)
  GROUP BY doc)
SELECT doc_id, (length(k.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN k.h ELSE coalesce(rest, '') END)) AS kept_sha256
FROM k LEFT JOIN gone USING (doc) LEFT JOIN kept USING (doc)
"""

ORACLES = {"op5_chat": CHAT, "op7_nearest_vectors": NEAREST, "op8_near_duplicates": NEAR_DUPLICATES, "op9_repeated_substrings": SUBSTRINGS}
