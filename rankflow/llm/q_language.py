"""Query of the language operator: learned from two folds, applied to all."""

from pyspark.sql import functions as F

from .language import fit, identify
from .registry import query


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    dictionaries = fit(docs.filter(~held_out))
    return (identify(docs.select("doc_id", "text"), dictionaries)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"))
