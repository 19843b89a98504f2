"""Query of the packing operator."""

from pyspark.sql import functions as F

from .packing import pack_documents
from .registry import query


def vocabulary() -> str:
    """Where the box keeps the vocabulary; another path is a parameter of the operator."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op11_best_fit_packing")
def op11_best_fit_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, vocabulary()).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
