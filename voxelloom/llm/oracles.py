"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '~')), 1, 13))::BIGINT AS k
  FROM documents),
src AS (SELECT skey, min(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src),
weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         2 * source_size AS cap FROM ranked),
filled AS (
  SELECT *, cap::DOUBLE / weight AS ratio,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM weighted),
levels AS (
  SELECT *, row_number() OVER w AS pos,
         (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM filled WINDOW w AS (ORDER BY ratio, rank)),
stopped AS (SELECT *, min(CASE WHEN ratio > level THEN pos END) OVER () AS stop FROM levels),
final AS (
  SELECT *, max(CASE WHEN pos = stop THEN level END) OVER () AS lv FROM stopped),
targets AS (
  SELECT skey, source_size, cap,
         CASE WHEN stop IS NULL OR pos < stop THEN cap::DOUBLE ELSE weight * lv END AS target FROM final),
quota AS (SELECT *, least(round(target)::BIGINT, cap) AS q FROM targets),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.q,
         CASE WHEN t.source_size > 0 THEN t.q // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.k, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM sized s JOIN quota t USING (skey))
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (epochs * size + greatest(0, least(size, q - epochs * source_size - prefix)))::BIGINT AS taken
FROM run
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
it AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS s FROM it WHERE len(w) > 0)),
grams AS (
  SELECT rid, l, j, array_to_string(w[j + 1 : j + l], ' ') AS k
  FROM (SELECT rid, w, l, unnest(range(0, len(w) - l + 1)) AS j
        FROM d CROSS JOIN (SELECT DISTINCT l FROM wins) WHERE len(w) >= l)),
found AS (SELECT g.rid, g.l, g.j, x.item_id FROM grams g JOIN wins x ON g.l = x.l AND g.k = x.k),
hit AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(j, j + l)) AS pos FROM found) GROUP BY rid),
ids AS (
  SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM found) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

OP1 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES = {"op1_exact_top_k": OP1, "op2_source_mixing": OP2, "op5_decontamination": OP5}
