"""Query and SQL of the WARC operator."""

from .registry import query
from .warc import round_trip

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND d.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND d.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""


@query("op5_warc", SQL)
def op5_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return round_trip(pages).selectExpr("cast(page_id AS bigint) AS page_id", "payload_bytes", "payload_digest",
                                        "record_type", "cast(refers_to AS bigint) AS refers_to")
