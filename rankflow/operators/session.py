"""Session layer: aggregates (G), window ranks (H), top-k (I), joins (F).

Per-session window columns are always added in one ``select`` so that Spark
plans one Exchange on the session key for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..functions.indexing import exact_quantiles
from ..functions.ranking import avg_rank, group_count

GROUP = "ranker_id"


# ---------------------------------------------------------------- G: aggregates

def session_stats(df: DataFrame, group: str = GROUP, price: str = "totalPrice",
                  duration: str = "legs0_duration") -> DataFrame:
    """G1: per-session price min/max/mean/std and duration min/max/mean,
    missing -> 0 (sample std of a singleton is missing too)."""
    p, d = F.col(price), F.col(duration)
    aggs = [F.min(p).alias(f"session_{price}_min"), F.max(p).alias(f"session_{price}_max"),
            F.avg(p).alias(f"session_{price}_mean"), F.stddev_samp(p).alias(f"session_{price}_std"),
            F.min(d).alias(f"session_{duration}_min"), F.max(d).alias(f"session_{duration}_max"),
            F.avg(d).alias(f"session_{duration}_mean")]
    out = df.groupBy(group).agg(*aggs)
    return out.select(group, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                               for c in out.columns if c != group])


def session_stats_columns(group: str = GROUP, price: str = "totalPrice",
                          duration: str = "legs0_duration") -> dict[str, Column]:
    """G1 as window columns (no join): same names and values as ``session_stats``."""
    w = Window.partitionBy(group)
    p, d = F.col(price), F.col(duration)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        f"session_{price}_min": z(F.min(p).over(w)),
        f"session_{price}_max": z(F.max(p).over(w)),
        f"session_{price}_mean": z(F.avg(p).over(w)),
        f"session_{price}_std": z(F.stddev_samp(p).over(w)),
        f"session_{duration}_min": z(F.min(d).over(w)),
        f"session_{duration}_max": z(F.max(d).over(w)),
        f"session_{duration}_mean": z(F.avg(d).over(w)),
    }


def session_sizes(df: DataFrame, group: str = GROUP) -> DataFrame:
    """Rows per session (the group-size array, one row per key)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Distinct non-null values of each column, one pass (HyperLogLog by
    default; ``exact=True`` for exact counts)."""
    fn = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(*[fn(F.col(c)).alias(f"n_{c}") for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Histogram of a column (nulls form their own bucket)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def global_stats(df: DataFrame, column: str, quantiles=(0.25, 0.75, 0.9)) -> DataFrame:
    """Mean, min, max, sample std, median and linear-interpolated quantiles."""
    c = F.col(column)
    found = exact_quantiles(df, [column], (0.5, *quantiles))
    at = lambda q: F.lit(found.get((column, q))).cast("double")
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"),
                  F.max(c).alias("max"), F.stddev_samp(c).alias("std")).select(
        "*", at(0.5).alias("median"), *[at(q).alias(f"q{int(round(q * 100)):02d}") for q in quantiles])


def category_mean_count(df: DataFrame, category: str, target: str = "selected") -> DataFrame:
    """Mean and count of the target per category; null keys dropped."""
    return (df.filter(F.col(category).isNotNull()).groupBy(category)
              .agg(F.avg(target).alias("mean"), F.count(F.col(target)).alias("count")))


def group_separation(df: DataFrame, value: str, group: str = GROUP) -> DataFrame:
    """Per-session range (max - min) and its mean/min/max/zero count."""
    rng = df.groupBy(group).agg((F.max(value) - F.min(value)).alias("_range"))
    return rng.agg(F.avg("_range").alias("mean_range"), F.min("_range").alias("min_range"),
                   F.max("_range").alias("max_range"),
                   F.count_if(F.col("_range") == 0).alias("groups_no_separation"))


def large_session_share(df: DataFrame, group: str = GROUP, threshold: int = 10) -> DataFrame:
    """Count and percentage of sessions with more than ``threshold`` rows."""
    sizes = session_sizes(df, group)
    big = (F.col("size") > threshold).cast("int")
    return sizes.agg(F.count(F.lit(1)).alias("sessions"), F.sum(big).cast("long").alias("large_sessions"),
                     (F.avg(big) * 100).alias("large_pct"))


# ---------------------------------------------------------------- H: windows

def session_rank_columns(group: str = GROUP, price: str = "totalPrice",
                         duration: str = "legs0_duration") -> dict[str, Column]:
    """H1: average ranks of price and duration inside the session."""
    return {"price_rank_in_session": avg_rank(price, group),
            "duration_rank_in_session": avg_rank(duration, group)}


def relative_columns(group: str = GROUP, price: str = "totalPrice") -> dict[str, Column]:
    """H4-H6: price against the session mean; cheapest / most expensive flags.
    Ties at an extreme give 0 (the average rank is then fractional); the row
    count includes null prices."""
    mean = F.coalesce(F.avg(price).over(Window.partitionBy(group)), F.lit(0.0))
    r = avg_rank(price, group)
    return {
        "price_vs_session_avg": F.col(price) - mean,
        "price_ratio_vs_session_avg": safe_div(F.col(price), mean),
        "is_cheapest_in_session": F.coalesce(r == 1, F.lit(False)).cast("int"),
        "is_most_expensive_in_session": F.coalesce(r == group_count(group), F.lit(False)).cast("int"),
    }


def add_session_features(df: DataFrame, group: str = GROUP, price: str = "totalPrice",
                         duration: str = "legs0_duration") -> DataFrame:
    """The FULL aggregation family: G1 + H1 + H4-H6 in one projection."""
    cols = {}
    cols.update(session_stats_columns(group, price, duration))
    cols.update(session_rank_columns(group, price, duration))
    cols.update(relative_columns(group, price))
    return df.withColumns(cols)


# ---------------------------------------------------------------- I: top-k

def topk_per_session(df: DataFrame, order: Column, k: int, group: str = GROUP,
                     tiebreak: str = "Id") -> DataFrame:
    """The k first rows of each session by ``order``. ``row_number() <= k``
    becomes a partial WindowGroupLimit before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order, F.col(tiebreak)))
    return df.withColumn("pos", rn).filter(F.col("pos") <= k)


def global_topn(df: DataFrame, order: Column, n: int, tiebreak: str = "Id") -> DataFrame:
    """I1 + I3: sort descending, keep n (TakeOrderedAndProject: per-partition
    top-n, then a merge of n x partitions rows)."""
    return df.orderBy(order, F.col(tiebreak)).limit(n)


# ---------------------------------------------------------------- F: joins

def stats_left_join(df: DataFrame, stats: DataFrame, key: str = GROUP) -> DataFrame:
    """F1 in join form (used when sessions are too skewed for one window task)."""
    return df.join(stats, key, "left")


def dictionary_lookup(df: DataFrame, dictionary: DataFrame, key: str, value: str,
                      out: str, default=None) -> DataFrame:
    """``Series.map(dict).fillna(default)``. The dictionary has one row
    per key; the planner picks the join by its bytes."""
    d = dictionary.select(F.col(key).alias("_k"), F.col(value).alias(out))
    j = df.join(d, df[key] == d["_k"], "left").drop("_k")
    if default is not None:
        j = j.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return j


def semi_join(df: DataFrame, keys: DataFrame, key: str = GROUP) -> DataFrame:
    """rows whose key is in ``keys`` (``isin``)."""
    return df.join(keys.select(key), key, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in ``keys`` (``~isin``); a null key is never
    in the set, so it is kept, as in pandas."""
    k = keys.select(F.col(key).alias("_k")).filter(F.col("_k").isNotNull())
    return df.join(k, df[key] == k["_k"], "left_anti")


def add_session_features_skew_safe(df: DataFrame, group: str = GROUP, price: str = "totalPrice",
                                   duration: str = "legs0_duration", row_id: str = "Id") -> DataFrame:
    """The same columns as ``add_session_features`` without any window over
    a whole session. Everything is computed on the narrow frame
    ``(row_id, group, price, duration)``: statistics and sizes are partial
    aggregates, ranks come from range-partitioned value counts
    (``functions.skew``). The result is joined back to the wide rows on the
    row id, a key with no hot values, so a session holding a large share of
    all rows is never processed by one task. Costs more shuffles than the
    window form; use it when ``profile_dataset`` shows a very large session."""
    from ..functions.skew import add_avg_rank_skew_safe
    narrow = df.select(row_id, group, price, duration)
    stats = session_stats(narrow, group, price, duration)
    sizes = narrow.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    r = add_avg_rank_skew_safe(narrow, price, group, name="price_rank_in_session")
    r = add_avg_rank_skew_safe(r, duration, group, name="duration_rank_in_session")
    r = r.join(stats, group, "left").join(sizes, group, "left")
    mean = F.col(f"session_{price}_mean")
    pr = F.col("price_rank_in_session")
    feats = r.select(
        row_id, *[F.col(c) for c in stats.columns if c != group],
        pr, F.col("duration_rank_in_session"),
        (F.col(price) - mean).alias("price_vs_session_avg"),
        safe_div(F.col(price), mean).alias("price_ratio_vs_session_avg"),
        F.coalesce(pr == 1, F.lit(False)).cast("int").alias("is_cheapest_in_session"),
        F.coalesce(pr == F.col("_n"), F.lit(False)).cast("int").alias("is_most_expensive_in_session"))
    return df.join(feats, row_id, "left")
