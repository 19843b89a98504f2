"""Distributed 0-based global index over a sorted DataFrame.

A window without ``partitionBy`` would put every row on one task. Instead
the rows are range-partitioned on the sort key, written with the number of
their partition, numbered inside each partition, and shifted by the row count
of all earlier partitions (a table with one row per partition). Writing them
once matters: range boundaries are sampled anew whenever a plan runs, so the
two branches below would not have to agree on partitions otherwise. Use it on distinct keys (sessions, category
values), never on raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_parts(df: DataFrame, n: int, *order) -> DataFrame:
    """``df`` range-partitioned by ``order`` with its partition as ``_pid``,
    stored in the shared scratch folder: the same in all that is derived from it."""
    from ..session import materialize
    return materialize(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "range-parts")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles of numeric columns, ``(column, p) ->
    value`` (missing without values). Values are counted, their counts are
    range-partitioned and accumulated, and only the rows that hold a wanted
    position are looked up: no task sees all values of a column."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v"))
                                          for i, c in enumerate(columns)]))).filter("v IS NOT NULL AND NOT isnan(v)")
    parts = range_parts(values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")), n, "c", "v")
    sums = parts.groupBy("c", "_pid").agg(F.sum("n").alias("s"))
    before = Window.partitionBy("c").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("c", "_pid", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("o"))
    totals = {r["c"]: r["n"] for r in sums.groupBy("c").agg(F.sum("s").alias("n")).collect()}   # a row per column
    wanted = {(c, k) for c, total in totals.items() for p in probabilities
              for k in (int((total - 1) * p), min(int((total - 1) * p) + 1, total - 1))}
    if not wanted:
        return {}
    upto = Window.partitionBy("c", "_pid").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (parts.withColumn("hi", F.sum("n").over(upto)).join(offsets, ["c", "_pid"])
              .select("c", "v", (F.col("o") + F.col("hi") - F.col("n")).alias("lo"), (F.col("o") + F.col("hi")).alias("hi")))
    asked = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).cast("long").alias("k")) for c, k in sorted(wanted)])
    hits = (placed.withColumn("k", F.explode(F.transform(F.filter(
        asked, lambda a: (a["c"] == F.col("c")) & (a["k"] >= F.col("lo")) & (a["k"] < F.col("hi"))), lambda a: a["k"])))
        .select("c", "k", "v").collect())                                    # two rows per column and probability
    at = {(r["c"], r["k"]): r["v"] for r in hits}
    out = {}
    for c, total in totals.items():
        for p in probabilities:
            place = (total - 1) * p
            k = int(place)
            low, high = at[c, k], at[c, min(k + 1, total - 1)]
            out[columns[c], p] = low + (high - low) * (place - k)
    return out


def global_index(df: DataFrame, order: list[Column], name: str = "_idx",
                 partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = range_parts(df, n, *order)
    local = parts.withColumn("_local", F.row_number().over(
        Window.partitionBy("_pid").orderBy(*order)) - 1)
    counts = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # at most n rows: one per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
                 .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
                 .drop("_pid", "_local", "_off"))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (fitted thresholds, a count) to
    every row: a broadcast equi-join on a constant key, never a cartesian
    product of two data-sized inputs."""
    r = one_row.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(r), "_one").drop("_one")
