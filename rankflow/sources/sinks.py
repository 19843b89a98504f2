"""Sinks (A6-A9). Writers keep Spark's parallel part files; nothing is
funnelled through a single task or the driver."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBMISSION_SCHEMA = "Id string, ranker_id string, selected int"


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """The train / test / sample tables."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_train_test_sample(train: DataFrame, test: DataFrame, sample: DataFrame, out_dir: str) -> None:
    """The three files of the converter, as parquet folders."""
    base = out_dir.rstrip("/")
    write_parquet(train, f"{base}/train.parquet")
    write_parquet(test, f"{base}/test.parquet")
    write_parquet(sample, f"{base}/sample_submission.parquet")


def submission_path(out_dir: str, name: str = "submission", timestamped: bool = False) -> str:
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("_%Y%m%d_%H%M%S") if timestamped else ""
    return f"{out_dir.rstrip('/')}/{name}{stamp}.csv"


def write_submission(sub: DataFrame, out_dir: str, name: str = "submission",
                     timestamped: bool = False) -> str:
    """``Id, ranker_id, selected`` as CSV with a header (a folder of
    part files), default, custom or timestamped name. Returns the path."""
    path = submission_path(out_dir, name, timestamped)
    (sub.select(F.col("Id").cast("string"), F.col("ranker_id").cast("string"),
                F.col("selected").cast("int"))
        .write.mode("overwrite").option("header", True).csv(path))
    return path


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Read a submission back with an explicit schema."""
    return spark.read.schema(SUBMISSION_SCHEMA).option("header", True).csv(path)


def submission_counts(sub: DataFrame) -> DataFrame:
    """Rows and distinct sessions of a submission (one aggregate)."""
    return sub.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ranker_id").alias("sessions"))


def write_params(results: DataFrame, path: str) -> None:
    """Search results / best parameters as JSON lines."""
    results.write.mode("overwrite").json(path)
