"""Column statistics that grow with the table.

A store keeps, for each partition of a table and each column, exact counts and
two mergeable sketches: KLL for quantiles and HyperLogLog for distinct values.
When a partition arrives, only its rows are read; what is asked of the whole
table is answered from the stored rows, a few kilobytes each. The exact forms
(``MedianImputer``, ``PriceTiers``, ``profile_missing(exact=True)``) stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from .clean import MedianImputerModel
from .features import PriceTiers

KLL_K = 1024            # rank error 0.44 % at 99 % confidence, merged or not
HLL_LG_K = 14           # relative standard error 0.8 %
RANK_BOUND = 0.01       # stated bound of a quantile's rank
DISTINCT_BOUND = 0.04   # stated relative bound of a distinct count

_SCHEMA = ("`column` string, dtype string, n long, missing long, numbers long, lo double, hi double, total double, "
           "kll binary, hll binary, part string")


def sketch_columns(df: DataFrame, columns: list[str], part: Column | None = None) -> DataFrame:
    """A row per partition value and column. Cells are stacked inside a task and
    aggregated there; what is shuffled is one row per partition, column and task.
    Null and NaN are missing to the quantiles, null alone to the counts."""
    def number(c):
        kind = df.schema[c].dataType
        if not isinstance(kind, NumericType) or isinstance(kind, BooleanType):
            return F.lit(None).cast("double")
        d = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(d), d)

    cells = df.select((F.lit("") if part is None else part.cast("string")).alias("part"), F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
        F.col(f"`{c}`").cast("string").alias("v"), number(c).alias("x")) for c in columns])))
    return cells.groupBy("part", "column", "dtype").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.count("x").alias("numbers"),
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("total"),
        F.kll_sketch_agg_double("x", F.lit(KLL_K)).alias("kll"), F.hll_sketch_agg("v", F.lit(HLL_LG_K)).alias("hll"))


@dataclass
class SketchStore:
    """Sketches under ``path``, a folder per partition of the table."""
    spark: SparkSession
    path: str
    columns: list[str]

    def add(self, rows: DataFrame, part: Column) -> "SketchStore":
        """Take in the partitions that ``rows`` holds whole; ``part`` names the
        partition of a row. A partition that is there already is replaced, so a
        repeated call after a failure changes nothing."""
        (sketch_columns(rows, self.columns, part).select(*[c.split()[0].strip("`") for c in _SCHEMA.split(", ")])
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path))
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def merged(self) -> DataFrame:
        """A row per column, over all partitions."""
        return self.rows().groupBy("column", "dtype").agg(
            *[F.sum(c).alias(c) for c in ("n", "missing", "numbers")], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.sum("total").alias("total"), F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll").alias("hll"))

    def quantiles(self, probabilities) -> DataFrame:
        """``column, p, value``: a value whose rank is within RANK_BOUND of p.
        Columns without numbers have no row."""
        at = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("kll", F.lit(float(p))).alias("value"))
                       for p in probabilities])
        return self.merged().filter("numbers > 0").select("column", F.inline(at))

    def profile(self) -> DataFrame:
        """N2 and the scalars of G3 / G5: ``column, missing_count, missing_pct,
        dtype, unique_count`` (estimated), ``min, max, mean`` of numeric columns."""
        return self.merged().select(
            "column", F.col("missing").alias("missing_count"), (F.col("missing") * 100.0 / F.col("n")).alias("missing_pct"), "dtype",
            F.when(F.col("n") == F.col("missing"), F.lit(0)).otherwise(F.hll_sketch_estimate("hll")).cast("long").alias("unique_count"),
            F.col("lo").alias("min"), F.col("hi").alias("max"), F.try_divide("total", "numbers").alias("mean"))

    def median_imputer(self, columns: list[str] | None = None) -> MedianImputerModel:
        """C6 without reading the table again."""
        found = self.quantiles([0.5]).collect()         # a row per column
        return MedianImputerModel({r["column"]: r["value"] for r in found if columns is None or r["column"] in columns})

    def price_tiers(self, column: str = "totalPrice", q=(0.25, 0.75, 0.9)) -> PriceTiers:
        """E9 without reading the table again."""
        tiers = PriceTiers(column, q)
        found = {r["p"]: r["value"] for r in self.quantiles(q).filter(F.col("column") == column).collect()}
        tiers.thresholds = tuple(found.get(float(p)) for p in q)
        return tiers


def rank_errors(df: DataFrame, quantiles: DataFrame, columns: list[str]) -> DataFrame:
    """``column, p, n, rank_error``: how far the values of ``quantiles`` are
    from having rank p in ``df``, counted exactly. A value's rank is an interval
    where it occurs more than once."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x"))
                                         for c in columns]))).filter("x IS NOT NULL AND NOT isnan(x)")
    # one row per column, with all its quantiles in an array
    asked = quantiles.groupBy("column").agg(F.collect_list(F.struct("p", "value")).alias("asked"))
    counted = (cells.groupBy("column", "x").agg(F.count(F.lit(1)).alias("k")).join(asked, "column")
               .select("column", "x", "k", F.inline("asked")).groupBy("column", "p").agg(
                   F.sum("k").alias("n"), F.sum(F.when(F.col("x") < F.col("value"), F.col("k")).otherwise(0)).alias("below"),
                   F.sum(F.when(F.col("x") <= F.col("value"), F.col("k")).otherwise(0)).alias("upto")))
    p = F.col("p")
    return counted.select("column", "p", "n", F.greatest(
        F.col("below") / F.col("n") - p, p - F.col("upto") / F.col("n"), F.lit(0.0)).alias("rank_error"))
