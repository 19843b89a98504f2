"""Per-session ranks that do not need a whole session in one task.

A window ``PARTITION BY session`` sorts every row of a session in one task;
if one session holds a large share of the rows that task becomes the job.
Here the same ranks are computed from counts:

1. ``(session, value) -> n`` with partial aggregation (ties collapse);
2. those pairs are range-partitioned on ``(session, value)`` and stored with
   their partition number (boundaries are sampled, so deriving them twice
   need not agree), so a hot
   session is spread over many partitions, and each partition computes
   running counts per session in its slice;
3. a small table with one row per (partition, session) gives each slice the
   counts of the same session in earlier partitions (its offsets);
4. ranks follow from "rows below", "distinct values below" and the tie
   count, and are joined back on ``(session, value)`` (hash-partitioned on
   both keys, so a hot session's rows spread by value; AQE splits a single
   hot pair).

The value may be a struct, which is how strict ranks are expressed: the
position of the unique key ``(score missing, score, row id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indexing import range_parts


def rank_counts(df: DataFrame, value: str, group: str = "ranker_id",
                partitions: int | None = None) -> DataFrame:
    """``(group, value, avg_rank, pct_rank, min_rank, dense_rank)`` for every
    distinct non-null ``value`` of every session, ascending order."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value)
    pairs = df.filter(v.isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = range_parts(pairs, n, group, value)
    before = Window.partitionBy("_pid", group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_rows_local"),
                         F.coalesce(F.count(F.lit(1)).over(before), F.lit(0)).alias("_vals_local"))
    slices = parts.groupBy("_pid", group).agg(F.sum("_c").alias("_rows_slice"),
                                              F.count(F.lit(1)).alias("_vals_slice"))
    # a session spans at most n slices: this window holds at most n rows per key
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_pid", group,
                            F.coalesce(F.sum("_rows_slice").over(earlier), F.lit(0)).alias("_rows_off"),
                            F.coalesce(F.sum("_vals_slice").over(earlier), F.lit(0)).alias("_vals_off"))
    totals = slices.groupBy(group).agg(F.sum("_rows_slice").alias("_nonnull"))
    j = local.join(offsets, ["_pid", group]).join(totals, group)
    below = F.col("_rows_off") + F.col("_rows_local")
    avg = below + (F.col("_c") + 1) / F.lit(2.0)
    return j.select(group, value, avg.alias("avg_rank"), (avg / F.col("_nonnull")).alias("pct_rank"),
                    (below + 1).alias("min_rank"),
                    (F.col("_vals_off") + F.col("_vals_local") + 1).alias("dense_rank"))


def add_avg_rank_skew_safe(df: DataFrame, value: str, group: str = "ranker_id",
                           name: str = "avg_rank", pct_name: str | None = None) -> DataFrame:
    """Same values as ``ranking.avg_rank`` / ``pct_rank`` (null value -> null
    rank) through counts and joins instead of a session window."""
    r = rank_counts(df, value, group).select(group, value, F.col("avg_rank").alias(name),
                                              *([F.col("pct_rank").alias(pct_name)] if pct_name else []))
    return df.join(r, [group, value], "left")


def _desc_key(score: str) -> Column:
    """Ascending order of this key = score descending (numeric score)."""
    return -F.col(score)


def add_dense_rank_desc_skew_safe(df: DataFrame, score: str, group: str = "ranker_id",
                                  name: str = "dense_rank") -> DataFrame:
    """Same values as ``ranking.dense_rank_desc`` (numeric score; null -> null)."""
    k = df.withColumn("_key", _desc_key(score))
    r = rank_counts(k, "_key", group).select(group, "_key", F.col("dense_rank").cast("int").alias(name))
    return k.join(r, [group, "_key"], "left").drop("_key")


def add_strict_rank_skew_safe(df: DataFrame, score: str, group: str = "ranker_id",
                              tiebreak: str = "Id", ascending: bool = False,
                              name: str = "strict_rank") -> DataFrame:
    """Same values as ``ranking.strict_rank``: a permutation 1..n per session,
    best (numeric) score first, missing scores last, ties by ``tiebreak``."""
    s = F.col(score)
    k = df.withColumn("_key", F.struct(s.isNull().alias("m"), (s if ascending else -s).alias("s"),
                                       F.col(tiebreak).alias("t")))
    r = rank_counts(k, "_key", group).select(group, "_key", F.col("min_rank").cast("int").alias(name))
    return k.join(r, [group, "_key"], "left").drop("_key")


def add_random_rank_skew_safe(df: DataFrame, group: str = "ranker_id", row_id: str = "Id", seed: int = 42,
                              name: str = "random_rank") -> DataFrame:
    """Same values as ``ranking.random_rank``: the position of the unique key
    (seeded hash, row id) in its session."""
    k = df.withColumn("_key", F.struct(F.md5(F.concat(F.lit(f"{seed}_"), F.col(row_id).cast("string"))).alias("h"), F.col(row_id).alias("t")))
    r = rank_counts(k, "_key", group).select(group, "_key", F.col("min_rank").cast("int").alias(name))
    return k.join(r, [group, "_key"], "left").drop("_key")
