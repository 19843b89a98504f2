"""Dataset profiling (N1-N3): one or two aggregate passes each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.indexing import attach_row


def profile_dataset(df: DataFrame, group: str = "ranker_id", user: str = "profileId",
                    label: str = "selected", large: int = 10) -> DataFrame:
    """Rows, columns, sessions, target rate, sessions per user, session
    size mean / median / max and the count and share of large sessions."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"),
                                F.sum(F.col(label)).alias("_pos") if label in df.columns else F.lit(0).alias("_pos"))
    sess = per.agg(F.count(F.lit(1)).alias("sessions"), F.sum("_n").alias("rows"),
                   F.avg("_n").alias("avg_session_size"), F.median("_n").alias("median_session_size"),
                   F.max("_n").alias("max_session_size"),
                   F.count_if(F.col("_n") > large).alias("large_sessions_count"),
                   (F.avg((F.col("_n") > large).cast("int")) * 100).alias("large_sessions_pct"),
                   (F.sum("_pos") / F.sum("_n")).alias("target_rate"))
    users = (df.groupBy(user).agg(F.count_distinct(group).alias("_k"))
               .agg(F.avg("_k").alias("sessions_per_user")))
    return attach_row(sess, users).select(
        "rows", F.lit(len(df.columns)).alias("columns"), "sessions", "target_rate", "sessions_per_user",
        "avg_session_size", F.col("median_session_size").cast("double").alias("median_session_size"),
        "max_session_size", "large_sessions_count", "large_sessions_pct")


def profile_missing(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Per column missing count / pct, type and distinct count.

    Values are stacked as ``(column number, value-as-text)`` rows, so every count
    is a narrow aggregate per column (partial aggregation leaves one row per
    column and task) instead of hundreds of aggregate expressions in one
    operator. For exact distinct counts the values are counted first, in the same
    pass, and the counts are added up per column; ``exact=False`` uses HyperLogLog
    per column instead, and no value is shuffled."""
    cols = columns or df.columns
    types = {c: df.schema[c].dataType.simpleString() for c in cols}
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))
                                         for i, c in enumerate(cols)])))
    v = F.col("v")
    if exact:
        base = pairs.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(
            F.sum("n").alias("_rows"), F.sum(F.when(v.isNull(), F.col("n")).otherwise(F.lit(0))).alias("missing_count"),
            F.count("v").alias("unique_count"))
    else:
        base = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("_rows"), F.count_if(v.isNull()).alias("missing_count"),
                                      F.approx_count_distinct(v).alias("unique_count"))
    base = base.withColumn("column", F.array(*[F.lit(c) for c in cols])[F.col("i")])
    dtype = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return base.select("column", "missing_count",
                       (F.col("missing_count") * 100.0 / F.col("_rows")).alias("missing_pct"),
                       dtype[F.col("column")].alias("dtype"), F.col("unique_count").cast("long").alias("unique_count"))


def profile_correlation(df: DataFrame, label: str = "selected", min_non_null: int = 100,
                        columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every numeric column with the label over rows where
    both are set (pairwise complete), for columns with more than
    ``min_non_null`` values. ``(feature, x, y)`` rows are aggregated per
    feature (narrow aggregate). Constant columns give null r and abs 0 (no
    divide-by-zero under ANSI)."""
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
                       and f.name != label]
    y = F.col(label).cast("double")
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"),
                                                 y.alias("y")) for c in cols])))
    x, yy = F.col("x"), F.col("y")
    both = x.isNotNull() & yy.isNotNull()
    agg = rows.groupBy("feature").agg(
        F.count(x).alias("non_null"),
        F.covar_pop(F.when(both, x), F.when(both, yy)).alias("_c"),
        F.var_pop(F.when(both, x)).alias("_vx"),
        F.var_pop(F.when(both, yy)).alias("_vy"))
    den = F.sqrt(F.col("_vx") * F.col("_vy"))
    r = F.when(den > 0, F.col("_c") / den)
    return (agg.filter(F.col("non_null") > min_non_null)
               .select("feature", "non_null", r.alias("correlation"),
                       F.coalesce(F.abs(r), F.lit(0.0)).alias("abs_correlation")))
