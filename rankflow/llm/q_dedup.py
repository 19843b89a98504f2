"""Queries of the repeated-text operators."""

from pyspark.sql import functions as F

from .parsing import repeated_strings
from .recompression import repeated_substrings
from .registry import query

WORDS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
s AS (SELECT rid, i FROM k WHERE h IN (SELECT h FROM r)),
g AS (SELECT DISTINCT rid, i + unnest(range(0, 35)) AS i FROM s),
t AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
j AS (SELECT t.rid, string_agg(t.word, ' ' ORDER BY t.i) AS kept, count(*) AS n FROM t ANTI JOIN g ON t.rid = g.rid AND t.i = g.i GROUP BY t.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(j.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(j.kept, '')) AS kept_sha256
FROM d LEFT JOIN j ON j.rid = d.rid
"""


@query("op1_substring_dedup", WORDS_SQL)
def op1_substring_dedup(spark, sf_dir):
    found = repeated_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark, sf_dir):
    found = repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
