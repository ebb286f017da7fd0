"""The operators' queries as SQL, where SQL can state them over whole tables."""

WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, CASE (r - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS w0,
  CASE (r - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS w1, source_size * 3 AS cap FROM r),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all, coalesce(sum(cap) OVER p, 0) AS cap_before, coalesce(sum(w) OVER p, 0) AS w_before
  FROM w WINDOW p AS (ORDER BY cap::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap::DOUBLE < (total - cap_before)::DOUBLE / (w_all - w_before)::DOUBLE * w AS stopped FROM o),
t AS (SELECT source, source_size, w0, w1, CASE WHEN stopped THEN cap::DOUBLE ELSE (total - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ())::DOUBLE / (sum(CASE WHEN stopped THEN 0 ELSE w END) OVER ())::DOUBLE * w END AS target FROM f),
p AS (SELECT doc_id, size, source_size, target, w0, w1, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - source_size - start)) + greatest(0, least(size, floor(target) - 2 * source_size - start)) AS BIGINT) AS taken FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE WHEN w1 = w0 THEN start / target ELSE (sqrt(w0 * w0 + 2 * (w1 - w0) * (start / target)) - w0) / (w1 - w0) END, 9) END AS position FROM k"""

LINES = rf"""WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM x),
m AS (SELECT doc_id, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, len(regexp_extract_all(line, '{WORD}')) AS words FROM n),
s AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS e, sum(words) OVER (PARTITION BY doc_id) AS total FROM m WHERE words > 0),
a AS (SELECT *, list(line) OVER f AS fl, max(pos) OVER f AS fend, list(line) OVER b AS bl, min(pos) OVER b AS bstart FROM (SELECT *, e - words AS st FROM s)
  WINDOW f AS (PARTITION BY doc_id ORDER BY st RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
w AS (SELECT doc_id, pos AS a, fend AS b, array_to_string(fl, chr(10)) AS content FROM a WHERE total - st >= 50 UNION SELECT doc_id, bstart, pos, array_to_string(bl, chr(10)) FROM a WHERE e >= 50),
g AS (SELECT content, min((doc_id, a, b)) AS first FROM w GROUP BY content HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM w JOIN g USING (content) WHERE doc_id <> first[1] OR a > first[3]),
kept AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.pos) AS text, count(gone.pos) AS removed FROM (SELECT n.doc_id, n.pos, CASE WHEN gone.pos IS NULL THEN line END AS line, gone.pos AS g FROM n LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.pos = n.pos) n
  LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.pos = n.pos GROUP BY n.doc_id)
SELECT doc_id, removed AS removed_lines, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS kept_words, md5(coalesce(text, '')) AS text_md5 FROM kept"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

SQL = {"op5_mixing": MIXING, "op8_line_dedup": LINES, "op10_topk_search": TOP_K}
