"""DuckDB SQL for the results of queries that SQL can state."""

from __future__ import annotations

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"
#: crc32 of an id's decimal digits, bit by bit.
CRC32 = """(4294967295 - list_reduce(list_concat([4294967295::BIGINT], range(8 * length(doc_id::VARCHAR))), lambda c, t:
  xor((CASE WHEN t % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (t // 8 + 1)::INTEGER, 1))::BIGINT) ELSE c END) // 2,
      3988292384 * ((CASE WHEN t % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (t // 8 + 1)::INTEGER, 1))::BIGINT) ELSE c END) % 2))))"""

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
m AS (SELECT k, min(doc_id * 1000000000 + i) AS first FROM k GROUP BY k),
g AS (SELECT k.doc_id, i FROM k JOIN m USING (k) WHERE first < doc_id * 1000000000 + i),
b AS (SELECT doc_id, unnest(range(n)) AS i FROM d),
l AS (SELECT b.doc_id, b.i, max(g.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) AS last FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND g.i = b.i),
c AS (SELECT doc_id, i, coalesce(i - last < 100, false) AS gone FROM l),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins,
  gone <> coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), NOT gone) AS turns FROM c),
p AS (SELECT doc_id, i, gone, lead(i, 1, NULL) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM r WHERE turns),
t AS (SELECT doc_id, string_agg(CASE WHEN gone THEN '' ELSE substr(h, 2 * i + 1, 2 * (coalesce(stop, n) - i)) END, '' ORDER BY i) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS k FROM p),
m AS (SELECT k, min(doc_id) AS first FROM k WHERE k IS NOT NULL GROUP BY k),
g AS (SELECT doc_id, i, word, max(CASE WHEN first < doc_id THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM k LEFT JOIN m USING (k)),
s AS (SELECT doc_id, count(*) FILTER (WHERE i - last < 13) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 13) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""

LANGUAGE_MODEL = f"""
WITH d AS (SELECT doc_id, coalesce({CRC32} % 5 = 1, false) AS held_out,
  list_append(coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []), ' ') AS w FROM documents),
p AS (SELECT doc_id, held_out, w, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, held_out, w[i] AS x, CASE WHEN i = 1 THEN '  ' ELSE w[i - 1] END AS h, CASE WHEN i = 2 THEN '  ' WHEN i > 2 THEN w[i - 2] END AS g FROM p),
c1 AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY x),
c2 AS (SELECT h, x, count(*) AS c2 FROM t WHERE NOT held_out GROUP BY h, x),
c3 AS (SELECT g, h, x, count(*) AS c3 FROM t WHERE NOT held_out AND g IS NOT NULL GROUP BY g, h, x),
cg AS (SELECT h AS g, x AS h, c2 AS cg FROM c2),
ch AS (SELECT x AS h, c AS ch FROM c1 UNION ALL SELECT '  ', count(*) FROM d WHERE NOT held_out),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c1),
s AS (SELECT doc_id, held_out, n, c IS NOT NULL AS known, (coalesce(c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p, coalesce(c2, 0) AS c2, coalesce(ch, 0) AS ch, coalesce(c3, 0) AS c3, coalesce(cg, 0) AS cg
  FROM t CROSS JOIN n LEFT JOIN c1 USING (x) LEFT JOIN c2 USING (h, x) LEFT JOIN ch USING (h) LEFT JOIN c3 USING (g, h, x) LEFT JOIN cg USING (g, h)),
q AS (SELECT *, CASE WHEN ch > 0 THEN 0.5::DOUBLE * c2 / ch + 0.5::DOUBLE * p ELSE p END AS p2 FROM s)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, n AS train_tokens, round(sum(log10(p)), 6) AS base_score,
  round(sum(log10(CASE WHEN cg > 0 THEN 0.5::DOUBLE * c3 / cg + 0.5::DOUBLE * p2 ELSE p2 END)), 6) AS score FROM q GROUP BY doc_id, held_out, n"""

MIXING = f"""
WITH RECURSIVE z AS (SELECT doc_id, source, md5(doc_id::VARCHAR) AS ord, len({WORDS})::BIGINT AS size FROM documents),
w AS (SELECT *, [1, 2, 3][number % 3 + 1] AS weight, 3 * source_size AS cap FROM (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM z GROUP BY source)),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap::DOUBLE, coalesce((SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, number LIMIT 1) * weight, cap)) AS target FROM l),
r AS (SELECT doc_id, ord, size, source_size, number, target, round(target)::BIGINT AS quota,
  (sum(size) OVER (PARTITION BY number ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes, [-0.5::DOUBLE, 0::DOUBLE, 0.5::DOUBLE][number % 3 + 1] AS s,
  least(1::DOUBLE, upto / greatest(quota, 1)) AS u FROM r),
b AS (SELECT *, passes + (upto <= quota - passes * source_size)::INTEGER AS base FROM p),
v AS (SELECT *, CASE WHEN size > 0 THEN greatest(3 - base, 0) ELSE 0 END AS spare FROM b),
gap AS (SELECT number, (max(quota) - sum(size * base))::BIGINT AS gap FROM v GROUP BY number),
units AS (SELECT number, size, sum(spare)::BIGINT AS units, row_number() OVER (PARTITION BY number ORDER BY size DESC) AS k FROM v JOIN gap USING (number) WHERE spare > 0 AND size <= gap GROUP BY 1, 2),
fill AS (SELECT number, 0::BIGINT AS k, 0::BIGINT AS size, 0::BIGINT AS extra, gap AS room FROM gap UNION ALL
  SELECT f.number, q.k, q.size, least(q.units, f.room // q.size), f.room - q.size * least(q.units, f.room // q.size) FROM fill f JOIN units q ON q.number = f.number AND q.k = f.k + 1),
x AS (SELECT v.*, coalesce(extra, 0) AS extra, sum(spare) OVER (PARTITION BY v.number, v.size ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) AS spared
  FROM v LEFT JOIN fill f ON f.number = v.number AND f.size = v.size AND f.k > 0),
c AS (SELECT *, (base + greatest(least(extra - spared + spare, spare), 0))::BIGINT AS copies FROM x)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * copies AS taken,
  CASE WHEN copies > 0 THEN round(2 * u / (1 - s + sqrt((1 - s) * (1 - s) + 4 * s * u)), 9) END AS first_due FROM c"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3"""

#: A text or role as the template writes it: control strings get one backslash more.
ESCAPED = r"""regexp_replace(regexp_replace({}, '<(\\*)(/?s>|text>|image>|audio>|document>)', '<\1\\\2', 'g'), '\[(\\*)(/?INST\])', '[\1\\\2', 'g')"""
CHATS = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length('<s>[INST]' || {ESCAPED.format('role')} || '[/INST]' || {ESCAPED.format('text')} || '</s>'))::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

ORACLES = {"op1_suffix_dedup": SUFFIXES, "op2_language_model": LANGUAGE_MODEL, "op4_substring_dedup": SUBSTRINGS, "op8_mixing": MIXING,
           "op9_exact_top_k": TOP_K, "op12_hard_negatives": NEGATIVES, "op13_chat_format": CHATS}
