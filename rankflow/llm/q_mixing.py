"""Query and SQL of the mixing operator."""

from .mixing import plan_mix
from .registry import query

SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS turn
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s0),
s2 AS (SELECT *, ((rnk - 1) % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, cap::DOUBLE / w AS ratio FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rnk
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM s3),
fair AS (SELECT ratio, rnk, lvl FROM s4 WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1),
targets AS (SELECT s4.source, s4.source_size,
         CASE WHEN fair.lvl IS NULL OR s4.ratio < fair.ratio OR (s4.ratio = fair.ratio AND s4.rnk < fair.rnk)
              THEN s4.cap::DOUBLE ELSE fair.lvl * s4.w END AS target
  FROM s4 LEFT JOIN fair ON TRUE),
sent AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn, size, rid
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS done FROM sized WHERE size > 0),
sends AS (SELECT sent.rid, sent.turn, sent.size, p.pass_no,
         (p.pass_no * t.source_size + sent.done)::DOUBLE / t.target AS finish
  FROM sent JOIN targets t ON sent.source IS NOT DISTINCT FROM t.source
  CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass_no) p
  WHERE p.pass_no * t.source_size + sent.done - sent.size < t.target),
spent AS (SELECT *, sum(size) OVER (ORDER BY finish, turn, size, rid, pass_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM sends),
copies AS (SELECT rid, count(*) AS n FROM spent
  WHERE used <= (SELECT sum(size) FROM sized) GROUP BY rid)
SELECT d.doc_id, d.size, t.source_size, t.target, (coalesce(c.n, 0) * d.size)::BIGINT AS taken
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN copies c ON c.rid = d.rid
"""


@query("op10_mix_sources", SQL)
def op10_mix_sources(spark, sf_dir):
    decided, _ = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return decided.selectExpr("id AS doc_id", "size", "source_size", "target", "taken")
