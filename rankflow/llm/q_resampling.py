"""Query of the importance resampling operator."""

from pyspark.sql import functions as F

from .registry import query
from .resampling import mark_target, select


@query("op6_quality_resampling")
def op6_quality_resampling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
    marked = mark_target(docs, labels.filter("good"))
    return select(marked, F.col("_target")).withColumnRenamed("id", "doc_id")
