"""Query of the byte-level BPE operator: encode, decode, digests of both."""

from pyspark.sql import functions as F

from .bpe import round_trip
from .registry import query


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = round_trip(docs)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded_ok").alias("well_formed"))
