"""Ranking metrics.

Every metric is a handful of aggregations: per-session work uses partial
aggregation or a top-k window (which Catalyst turns into a partial
``WindowGroupLimit`` before the shuffle), and the final number is a one-row
global aggregate. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag
from ..functions.indexing import attach_row, exact_quantiles
from ..functions.ranking import dense_rank_desc, strict_rank, random_rank

LARGE_SESSION = 10  # sessions with more options than this are "large"


def _sessions_over(df: DataFrame, group: str, min_group_size: int) -> DataFrame:
    """Keys of sessions with more than ``min_group_size`` rows (partial agg)."""
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") > min_group_size).select(group))


def hitrate_rows(df: DataFrame, rank_col: str = "rank", label: str = "selected",
                 group: str = "ranker_id", k: int = 3, min_group_size: int = 0) -> DataFrame:
    """L1: share of positive rows whose rank is <= k. Optionally only sessions
    with more than ``min_group_size`` rows. No positive rows -> 0.0."""
    if min_group_size > 0:
        df = df.join(_sessions_over(df, group, min_group_size), group, "left_semi")
    pos = df.filter(F.col(label) == 1)
    return pos.agg(
        F.count(F.lit(1)).alias("positives"),
        F.sum(flag(F.col(rank_col) <= k)).cast("long").alias("hits"),
    ).select(F.lit(k).alias("k"), F.lit(min_group_size).alias("min_group_size"),
             F.col("positives"), F.coalesce(F.col("hits"), F.lit(0)).cast("long").alias("hits"),
             F.when(F.col("positives") > 0, F.col("hits") / F.col("positives"))
              .otherwise(F.lit(0.0)).alias("hitrate"))


def hitrate_sessions(df: DataFrame, score_col: str = "score", label: str = "selected",
                     group: str = "ranker_id", k: int = 3, min_group_size: int = LARGE_SESSION,
                     tiebreak: str = "Id") -> DataFrame:
    """L2: share of sessions (more than ``min_group_size`` rows) that have a
    positive among their k best-scored rows. Ties in score go by ``tiebreak``."""
    top = (df.withColumn("_r", strict_rank(score_col, group, tiebreak))
             .filter(F.col("_r") <= k)
             .groupBy(group).agg(F.max(F.coalesce(F.col(label), F.lit(0))).alias("_hit")))
    sessions = (df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") > min_group_size).select(group))
    return (sessions.join(top, group, "left")
            .agg(F.count(F.lit(1)).alias("sessions"),
                 F.sum(F.when(F.col("_hit") > 0, 1).otherwise(0)).cast("long").alias("hits"))
            .select(F.lit(k).alias("k"), F.lit(min_group_size).alias("min_group_size"),
                    "sessions", F.coalesce(F.col("hits"), F.lit(0)).cast("long").alias("hits"),
                    F.when(F.col("sessions") > 0, F.col("hits") / F.col("sessions"))
                     .otherwise(F.lit(0.0)).alias("hitrate")))


def ndcg_at_k(df: DataFrame, rank_col: str = "rank", label: str = "selected",
              group: str = "ranker_id", k: int = 10, tiebreak: str = "Id") -> DataFrame:
    """L3: mean over sessions of binary-relevance NDCG@k; rows are read in
    ascending ``rank_col`` order (ties by ``tiebreak``); no positive -> 0."""
    rel = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    pos = F.row_number().over(Window.partitionBy(group).orderBy(
        F.col(rank_col).asc_nulls_last(), F.col(tiebreak)))
    dcg = (df.withColumn("_p", pos).filter(F.col("_p") <= k)
             .groupBy(group).agg(F.sum(rel / F.log2(F.col("_p") + 1)).alias("_dcg")))
    ideal = df.groupBy(group).agg(F.sum(rel).alias("_npos"))
    m = F.least(F.lit(k), F.col("_npos")).cast("int")
    idcg = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0),
                                     lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1)))
    per = (ideal.join(dcg, group, "left")
           .select(group, F.when(idcg > 0, F.coalesce(F.col("_dcg"), F.lit(0.0)) / idcg)
                   .otherwise(F.lit(0.0)).alias("ndcg")))
    return per.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("sessions"),
                   F.avg("ndcg").alias("ndcg"))


def ndcg_per_session(df: DataFrame, rank_col: str = "rank", label: str = "selected",
                     group: str = "ranker_id", k: int = 10, tiebreak: str = "Id") -> DataFrame:
    """Per-session NDCG@k (used by the boosting loop's early stopping)."""
    rel = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    pos = F.row_number().over(Window.partitionBy(group).orderBy(
        F.col(rank_col).asc_nulls_last(), F.col(tiebreak)))
    dcg = (df.withColumn("_p", pos).filter(F.col("_p") <= k)
             .groupBy(group).agg(F.sum(rel / F.log2(F.col("_p") + 1)).alias("_dcg")))
    ideal = df.groupBy(group).agg(F.sum(rel).alias("_npos"))
    m = F.least(F.lit(k), F.col("_npos")).cast("int")
    idcg = F.when(m > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0),
                                     lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1)))
    return (ideal.join(dcg, group, "left")
            .select(group, F.when(idcg > 0, F.coalesce(F.col("_dcg"), F.lit(0.0)) / idcg)
                    .otherwise(F.lit(0.0)).alias("ndcg")))


def cv_summary(fold_scores: DataFrame, metric_cols=("hitrate_all", "hitrate_large")) -> DataFrame:
    """L4: mean and population std of per-fold scores."""
    aggs = []
    for c in metric_cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return fold_scores.agg(F.count(F.lit(1)).alias("folds"), *aggs)


def prediction_analysis(df: DataFrame, score_col: str = "score", group: str = "ranker_id") -> DataFrame:
    """Score distribution plus per-session score range (separation)."""
    s = F.col(score_col)
    stats = df.agg(F.min(s).alias("score_min"), F.max(s).alias("score_max"),
                   F.avg(s).alias("score_mean"), F.stddev_samp(s).alias("score_std"),
                   F.lit(exact_quantiles(df, [score_col], (0.5,)).get((score_col, 0.5))).cast("double").alias("score_median"))
    rng = df.groupBy(group).agg((F.max(s) - F.min(s)).alias("_range"))
    sep = rng.agg(F.avg("_range").alias("mean_range"), F.min("_range").alias("min_range"),
                  F.max("_range").alias("max_range"),
                  F.count_if(F.col("_range") == 0).alias("groups_no_separation"))
    return attach_row(stats, sep)


def rank_distribution(df: DataFrame, score_col: str = "score", group: str = "ranker_id",
                      skew_safe: bool = False) -> DataFrame:
    """How many rows get each dense rank (score descending).
    ``skew_safe`` takes the ranks from range-partitioned counts instead of a
    session window (for very large sessions)."""
    if skew_safe:
        from ..functions.skew import add_dense_rank_desc_skew_safe
        ranked = add_dense_rank_desc_skew_safe(df.select(group, score_col), score_col, group, name="rank")
    else:
        ranked = df.select(dense_rank_desc(score_col, group).alias("rank"))
    return ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def grade(score_col: str = "hitrate") -> F.Column:
    """The reference's qualitative grade of a CV score."""
    s = F.col(score_col)
    return (F.when(s >= 0.7, "excellent").when(s >= 0.5, "great")
             .when(s >= 0.3, "fair").otherwise("improve"))


def baseline_ranks(df: DataFrame, group: str = "ranker_id", row_id: str = "Id",
                   price: str = "totalPrice", duration: str = "legs0_duration",
                   seed: int = 42) -> DataFrame:
    """H9: heuristic rank columns: cheapest first, shortest first, random."""
    return df.select(
        "*",
        strict_rank(price, group, row_id, ascending=True).alias("rank_price"),
        strict_rank(duration, group, row_id, ascending=True).alias("rank_duration"),
        random_rank(group, row_id, seed).alias("rank_random"),
    )


def baseline_hitrates(df: DataFrame, label: str = "selected", group: str = "ranker_id",
                      k: int = 3, large: int = LARGE_SESSION, row_id: str = "Id",
                      price: str = "totalPrice", duration: str = "legs0_duration",
                      seed: int = 42) -> DataFrame:
    """HitRate@k (row form) of each heuristic baseline, over all and over
    large sessions. A positive is a hit when it is among its session's k
    best rows, so only the top k rows per session and baseline are needed:
    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the
    shuffle, and sizes / positives are partial aggregates. No session is ever
    sorted whole, so a hot session costs no more than a small one."""
    pos = F.coalesce(F.col(label), F.lit(0)) == 1
    per = (df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(pos).alias("_p")))
    orders = {
        "price": [F.col(price).asc_nulls_last(), F.col(row_id)],
        "duration": [F.col(duration).asc_nulls_last(), F.col(row_id)],
        "random": [F.md5(F.concat(F.lit(f"{seed}_"), F.col(row_id).cast("string"))), F.col(row_id)],
    }
    for name, order in orders.items():
        rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        hits = (df.select(group, label, rn.alias("_r")).filter(F.col("_r") <= k)
                  .filter(pos).groupBy(group).agg(F.count(F.lit(1)).alias(f"_h_{name}")))
        per = per.join(hits, group, "left")
    aggs, parts = [], []
    for name in orders:
        h = F.coalesce(F.col(f"_h_{name}"), F.lit(0))
        for subset, cond in (("all", F.lit(True)), ("large", F.col("_n") > large)):
            aggs += [F.sum(F.when(cond, F.col("_p")).otherwise(0)).cast("long").alias(f"{name}_{subset}_p"),
                     F.sum(F.when(cond, h).otherwise(0)).cast("long").alias(f"{name}_{subset}_h")]
            parts.append(f"'{name}', '{subset}', {name}_{subset}_p, {name}_{subset}_h")
    one = per.agg(*aggs)
    long = one.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (baseline, subset, positives, hits)")
    return long.select("baseline", "subset", "positives", "hits",
                       F.when(F.col("positives") > 0, F.col("hits") / F.col("positives"))
                       .otherwise(F.lit(0.0)).alias("hitrate"))
