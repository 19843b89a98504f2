"""Parquet table access (A1) with explicit column selection.

Reads go through ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the scan; callers select what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_options(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A1: read a flat option table (train / test / sample files)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def check_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """M1: fail early, naming every missing input, before any job runs."""
    missing = []
    for name, p in paths.items():
        try:
            spark.read.text(p)      # the path is resolved, nothing is read
        except AnalysisException:
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(sorted(missing))}")
