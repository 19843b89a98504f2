"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.session import materialize, scratch_path

__all__ = ["WORD", "WHITE", "materialize", "parquet_stage",
           "give_back", "power_of_two", "scratch_path", "small_batches", "word_count"]

# fixed values: the word pattern of the operators' contracts
WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of ``WORD`` matches; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


ROWS_PER_BATCH = "1000"     # long texts: Spark's default of 10,000 rows makes batches of hundreds of MB


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has set a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ROWS_PER_BATCH)


def give_back() -> None:
    """Return a worker's freed memory to the system: workers live on between
    tasks, and what their allocators keep would count against the next stage."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # another C library
        pass


def power_of_two(n: float) -> int:
    """Smallest power of two that is at least ``n`` (1 or more)."""
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length()


def parquet_stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared scratch folder and read back,
    so that a lost executor costs a re-read, never a recomputation with
    other row ids."""
    return materialize(df, name)
