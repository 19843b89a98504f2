"""Query of the SimHash operator."""

from pyspark.sql import functions as F

from .registry import query
from .simhash import near_duplicates


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
