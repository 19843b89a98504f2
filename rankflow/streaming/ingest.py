"""Incremental ingestion of session documents with Structured Streaming.

New JSON documents dropped into a folder are parsed, flattened and given
their row-wise features, then appended to a parquet table; the checkpoint
folder makes the job restartable after executor or driver loss (exactly
once into the file sink). Per-session features (ranks, session stats) need
the whole session and are computed in batch over the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import engineer_features
from ..sources import documents as D


def document_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Streaming twin of ``read_sessions``: one row per new ``*.json`` file."""
    return (spark.readStream.format("text").option("wholetext", True)
            .option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", max_files_per_trigger)
            .load(source_dir)
            .select("value", F.col("_metadata.file_name").alias("file_name")))


def flattened_stream(spark: SparkSession, source_dir: str, form: str = "full",
                     fare_source: str = "first_fare") -> DataFrame:
    parsed = D.parse_sessions(document_stream(spark, source_dir))
    flat = D.flatten_documents(D.good_documents(parsed), fare_source=fare_source)
    return engineer_features(flat, form)


def start_ingest(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 available_now: bool = True, form: str = "full"):
    """Start the ingest query; with ``available_now`` it processes what is
    there and stops (batch-like backfill), else it runs continuously."""
    q = (flattened_stream(spark, source_dir, form).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()
