"""Queries for the session layer (G, H, I, F) and the option table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import ranking as R
from ..operators import session as S
from ..sources.views import events_view, options_view
from .oracle import with_events, with_options
from .registry import query
from ..functions.exprs import sql_round


def rounded(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every double column (float sums differ in the last bits between
    engines; the oracle rounds the same way)."""
    return df.select(*[sql_round(F.col(f.name), scale).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def events_with_nulls(spark, sf_dir) -> DataFrame:
    """Events with a value that has ties and nulls: errors carry no value."""
    ev = events_view(spark, sf_dir)
    return ev.withColumn("v", F.when(F.col("event_type") != "error", F.col("score")))


EV_V = ", evn AS (SELECT *, CASE WHEN event_type <> 'error' THEN score END AS v FROM ev)"


@query("options_table", with_options("SELECT * FROM options"))
def q_options_table(spark, sf_dir):
    """The wide option table every other query starts from."""
    return options_view(spark, sf_dir)


@query("session_stats", with_options("""
SELECT ranker_id,
  coalesce(min(totalPrice), 0.0) AS session_totalPrice_min, coalesce(max(totalPrice), 0.0) AS session_totalPrice_max,
  round(coalesce(avg(totalPrice), 0.0), 6) AS session_totalPrice_mean,
  round(coalesce(stddev_samp(totalPrice), 0.0), 6) AS session_totalPrice_std,
  coalesce(min(legs0_duration), 0.0) AS session_legs0_duration_min,
  coalesce(max(legs0_duration), 0.0) AS session_legs0_duration_max,
  round(coalesce(avg(legs0_duration), 0.0), 6) AS session_legs0_duration_mean
FROM options GROUP BY ranker_id"""))
def q_session_stats(spark, sf_dir):
    """G1: per-session price and duration statistics."""
    return rounded(S.session_stats(options_view(spark, sf_dir)))


@query("session_sizes", with_options("SELECT ranker_id, count(*) AS size FROM options GROUP BY ranker_id"))
def q_session_sizes(spark, sf_dir):
    """Group sizes."""
    return S.session_sizes(options_view(spark, sf_dir))


@query("group_separation", with_options("""
SELECT round(avg(rg), 6) AS mean_range, min(rg) AS min_range, max(rg) AS max_range,
       count(*) FILTER (WHERE rg = 0) AS groups_no_separation
FROM (SELECT ranker_id, max(totalPrice) - min(totalPrice) AS rg FROM options GROUP BY ranker_id)"""))
def q_group_separation(spark, sf_dir):
    """Price range per session."""
    return rounded(S.group_separation(options_view(spark, sf_dir), "totalPrice"))


@query("global_stats", with_options("""
SELECT count(totalPrice) AS n, round(avg(totalPrice), 6) AS mean, min(totalPrice) AS min, max(totalPrice) AS max,
       round(stddev_samp(totalPrice), 6) AS std, round(quantile_cont(totalPrice, 0.5), 6) AS median,
       round(quantile_cont(totalPrice, 0.25), 6) AS q25, round(quantile_cont(totalPrice, 0.75), 6) AS q75,
       round(quantile_cont(totalPrice, 0.9), 6) AS q90
FROM options"""))
def q_global_stats(spark, sf_dir):
    """Scalar statistics of the price."""
    return rounded(S.global_stats(options_view(spark, sf_dir), "totalPrice"))


@query("distinct_counts", with_options("""
SELECT count(DISTINCT ranker_id) AS n_ranker_id, count(DISTINCT nationality) AS n_nationality,
       count(DISTINCT corporateTariffCode) AS n_corporateTariffCode,
       count(DISTINCT legs0_segments0_marketingCarrier_code) AS n_legs0_segments0_marketingCarrier_code,
       count(DISTINCT legs0_segments0_aircraft_code) AS n_legs0_segments0_aircraft_code
FROM options"""))
def q_distinct_counts(spark, sf_dir):
    """Distinct values of several columns in one pass."""
    return S.distinct_counts(options_view(spark, sf_dir),
                             ["ranker_id", "nationality", "corporateTariffCode",
                              "legs0_segments0_marketingCarrier_code", "legs0_segments0_aircraft_code"],
                             exact=True)


@query("large_session_share", with_options("""
SELECT count(*) AS sessions, CAST(sum(CASE WHEN size > 10 THEN 1 ELSE 0 END) AS BIGINT) AS large_sessions,
       round(avg(CASE WHEN size > 10 THEN 1 ELSE 0 END) * 100, 6) AS large_pct
FROM (SELECT ranker_id, count(*) AS size FROM options GROUP BY ranker_id)"""))
def q_large_session_share(spark, sf_dir):
    """Share of sessions above ten options."""
    return rounded(S.large_session_share(options_view(spark, sf_dir)))


@query("category_mean_count", with_options("""
SELECT nationality, round(avg(selected), 6) AS mean, count(selected) AS count
FROM options WHERE nationality IS NOT NULL GROUP BY nationality"""))
def q_category_mean_count(spark, sf_dir):
    """Label mean and count per category."""
    return rounded(S.category_mean_count(options_view(spark, sf_dir), "nationality"))


@query("avg_rank", with_events(EV_V + """
SELECT Id, ranker_id, v,
  CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY ranker_id ORDER BY v ASC NULLS LAST)
       + (count(*) OVER (PARTITION BY ranker_id, v) - 1) / 2.0 END AS avg_rank
FROM evn"""))
def q_avg_rank(spark, sf_dir):
    """H1: average rank with ties and nulls."""
    ev = events_with_nulls(spark, sf_dir)
    return ev.select("Id", "ranker_id", "v", R.avg_rank("v").alias("avg_rank"))


@query("pct_rank", with_events(EV_V + """
SELECT Id, ranker_id, v,
  round(CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY ranker_id ORDER BY v ASC NULLS LAST)
       + (count(*) OVER (PARTITION BY ranker_id, v) - 1) / 2.0) / count(v) OVER (PARTITION BY ranker_id) END, 6)
  AS pct_rank
FROM evn"""))
def q_pct_rank(spark, sf_dir):
    """H2: percentile rank (average rank / non-null count)."""
    ev = events_with_nulls(spark, sf_dir)
    return ev.select("Id", "ranker_id", "v", sql_round(R.pct_rank("v"), 6).alias("pct_rank"))


@query("dense_rank_desc", with_events(EV_V + """
SELECT Id, ranker_id, v,
  CASE WHEN v IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY ranker_id ORDER BY v DESC NULLS LAST) AS INTEGER) END
  AS dense_rank
FROM evn"""))
def q_dense_rank(spark, sf_dir):
    """H3: dense rank of a score, best first, nulls stay null."""
    ev = events_with_nulls(spark, sf_dir)
    return ev.select("Id", "ranker_id", "v", R.dense_rank_desc("v").alias("dense_rank"))


@query("strict_rank", with_events(EV_V + """
SELECT Id, ranker_id, v,
  CAST(row_number() OVER (PARTITION BY ranker_id ORDER BY v DESC NULLS LAST, Id) AS INTEGER) AS strict_rank
FROM evn"""))
def q_strict_rank(spark, sf_dir):
    """H7: permutation rank 1..n per session."""
    ev = events_with_nulls(spark, sf_dir)
    return ev.select("Id", "ranker_id", "v", R.strict_rank("v").alias("strict_rank"))


@query("random_rank", with_options("""
SELECT Id, ranker_id,
  CAST(row_number() OVER (PARTITION BY ranker_id ORDER BY md5('42_' || CAST(Id AS VARCHAR)), Id) AS INTEGER)
  AS random_rank
FROM options"""))
def q_random_rank(spark, sf_dir):
    """H8: seeded random permutation per session."""
    return options_view(spark, sf_dir).select("Id", "ranker_id", R.random_rank(seed=42).alias("random_rank"))


@query("random_rank_skew_safe", with_options("""
SELECT Id, ranker_id,
  CAST(row_number() OVER (PARTITION BY ranker_id ORDER BY md5('42_' || CAST(Id AS VARCHAR)), Id) AS INTEGER)
  AS random_rank
FROM options"""))
def q_random_rank_skew_safe(spark, sf_dir):
    """H8 without a session window: position of the unique key (hash, Id) from
    range-partitioned counts."""
    from ..functions.skew import add_random_rank_skew_safe
    return add_random_rank_skew_safe(options_view(spark, sf_dir).select("Id", "ranker_id"), seed=42).select("Id", "ranker_id", "random_rank")


@query("relative_to_session", with_options("""
SELECT Id, ranker_id, totalPrice,
  round(totalPrice - coalesce(avg(totalPrice) OVER w, 0.0), 6) AS price_vs_session_avg,
  round(CASE WHEN coalesce(avg(totalPrice) OVER w, 0.0) = 0 THEN 0.0
             ELSE totalPrice / coalesce(avg(totalPrice) OVER w, 0.0) END, 6) AS price_ratio_vs_session_avg
FROM options WINDOW w AS (PARTITION BY ranker_id)"""))
def q_relative(spark, sf_dir):
    """H4: price against the session mean."""
    c = S.relative_columns()
    return rounded(options_view(spark, sf_dir).select(
        "Id", "ranker_id", "totalPrice", c["price_vs_session_avg"].alias("price_vs_session_avg"),
        c["price_ratio_vs_session_avg"].alias("price_ratio_vs_session_avg")))


@query("session_extremes", with_events(EV_V + """
, r AS (SELECT *, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY ranker_id ORDER BY v ASC NULLS LAST)
       + (count(*) OVER (PARTITION BY ranker_id, v) - 1) / 2.0 END AS ar,
       count(*) OVER (PARTITION BY ranker_id) AS n FROM evn)
SELECT Id, ranker_id, v, n AS group_size,
  CAST(coalesce(ar = 1, false) AS INTEGER) AS is_cheapest_in_session,
  CAST(coalesce(ar = n, false) AS INTEGER) AS is_most_expensive_in_session
FROM r"""))
def q_session_extremes(spark, sf_dir):
    """H5 + H6: cheapest / most expensive flags (ties give 0), group size."""
    ev = events_with_nulls(spark, sf_dir)
    c = S.relative_columns(price="v")
    return ev.select("Id", "ranker_id", "v", R.group_count().alias("group_size"),
                     c["is_cheapest_in_session"].alias("is_cheapest_in_session"),
                     c["is_most_expensive_in_session"].alias("is_most_expensive_in_session"))


@query("topk_per_session", with_options("""
SELECT Id, ranker_id, totalPrice, pos FROM (
  SELECT Id, ranker_id, totalPrice,
         CAST(row_number() OVER (PARTITION BY ranker_id ORDER BY totalPrice, Id) AS INTEGER) AS pos
  FROM options) WHERE pos <= 3"""))
def q_topk(spark, sf_dir):
    """The three cheapest options of every session."""
    o = options_view(spark, sf_dir).select("Id", "ranker_id", "totalPrice")
    return S.topk_per_session(o, F.col("totalPrice").asc(), 3)


@query("global_topn", with_options("""
SELECT Id, ranker_id, totalPrice FROM options ORDER BY totalPrice DESC, Id LIMIT 20"""))
def q_global_topn(spark, sf_dir):
    """I1 + I3: the 20 most expensive options overall (a top-n report)."""
    o = options_view(spark, sf_dir).select("Id", "ranker_id", "totalPrice")
    return S.global_topn(o, F.col("totalPrice").desc(), 20)


@query("stats_left_join", with_options("""
SELECT o.Id, o.ranker_id, o.totalPrice, s.session_totalPrice_min, s.session_totalPrice_max,
       s.session_totalPrice_mean, s.session_totalPrice_std, s.session_legs0_duration_min,
       s.session_legs0_duration_max, s.session_legs0_duration_mean
FROM options o LEFT JOIN (
  SELECT ranker_id,
    coalesce(min(totalPrice), 0.0) AS session_totalPrice_min, coalesce(max(totalPrice), 0.0) AS session_totalPrice_max,
    round(coalesce(avg(totalPrice), 0.0), 6) AS session_totalPrice_mean,
    round(coalesce(stddev_samp(totalPrice), 0.0), 6) AS session_totalPrice_std,
    coalesce(min(legs0_duration), 0.0) AS session_legs0_duration_min,
    coalesce(max(legs0_duration), 0.0) AS session_legs0_duration_max,
    round(coalesce(avg(legs0_duration), 0.0), 6) AS session_legs0_duration_mean
  FROM options GROUP BY ranker_id) s ON o.ranker_id = s.ranker_id"""))
def q_stats_left_join(spark, sf_dir):
    """session statistics joined back onto the options (join form)."""
    o = options_view(spark, sf_dir)
    return rounded(S.stats_left_join(o.select("Id", "ranker_id", "totalPrice"), S.session_stats(o)))


@query("dictionary_lookup", with_options("""
SELECT o.Id, o.nationality, coalesce(d.mean, 0.0) AS nationality_rate
FROM options o LEFT JOIN (
  SELECT nationality, round(avg(selected), 6) AS mean FROM options
  WHERE nationality IS NOT NULL GROUP BY nationality) d ON o.nationality = d.nationality"""))
def q_dictionary_lookup(spark, sf_dir):
    """map a fitted dictionary onto rows, default for misses."""
    o = options_view(spark, sf_dir)
    d = rounded(S.category_mean_count(o, "nationality"))
    return S.dictionary_lookup(o.select("Id", "nationality"), d, "nationality", "mean",
                               "nationality_rate", default=0.0)


@query("semi_join_sessions", with_options("""
SELECT Id, ranker_id FROM options
WHERE ranker_id IN (SELECT ranker_id FROM options GROUP BY ranker_id HAVING count(*) > 10)"""))
def q_semi_join(spark, sf_dir):
    """options of sessions with more than ten options."""
    o = options_view(spark, sf_dir)
    big = S.session_sizes(o).filter(F.col("size") > 10)
    return S.semi_join(o.select("Id", "ranker_id"), big)


@query("unseen_categories", with_options("""
, tr AS (SELECT * FROM options WHERE CAST(('0x' || substr(md5('42_' || CAST(ranker_id AS VARCHAR)), 1, 8)) AS BIGINT)
                                     / CAST(4294967296 AS DOUBLE) < 0.7),
te AS (SELECT * FROM options WHERE CAST(('0x' || substr(md5('42_' || CAST(ranker_id AS VARCHAR)), 1, 8)) AS BIGINT)
                                     / CAST(4294967296 AS DOUBLE) >= 0.7)
SELECT te.Id, te.legs1_segments3_aircraft_code FROM te
WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.legs1_segments3_aircraft_code = te.legs1_segments3_aircraft_code)"""))
def q_unseen_categories(spark, sf_dir):
    """test rows whose category never occurs in training (``~isin``;
    a missing value is never in the set, so it is kept)."""
    from ..operators.split import group_split
    o = options_view(spark, sf_dir).select("Id", "ranker_id", "legs1_segments3_aircraft_code")
    train, test = group_split(o, label=None)
    c = "legs1_segments3_aircraft_code"
    return S.anti_join(test, train.select(c), c).select("Id", c)


@query("avg_rank_skew_safe", with_events(EV_V + """
SELECT Id, ranker_id, v,
  CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY ranker_id ORDER BY v ASC NULLS LAST)
       + (count(*) OVER (PARTITION BY ranker_id, v) - 1) / 2.0 END AS avg_rank,
  round(CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY ranker_id ORDER BY v ASC NULLS LAST)
       + (count(*) OVER (PARTITION BY ranker_id, v) - 1) / 2.0) / count(v) OVER (PARTITION BY ranker_id) END, 6)
  AS pct_rank
FROM evn"""))
def q_avg_rank_skew_safe(spark, sf_dir):
    """H1 + H2 without a session window: counts per (session, value), range
    partitioned so a hot session spreads over tasks, offsets, join back."""
    from ..functions.skew import add_avg_rank_skew_safe
    ev = events_with_nulls(spark, sf_dir).select("Id", "ranker_id", "v")
    out = add_avg_rank_skew_safe(ev, "v", name="avg_rank", pct_name="pct_rank")
    return out.select("Id", "ranker_id", "v", "avg_rank", sql_round(F.col("pct_rank"), 6).alias("pct_rank"))


@query("strict_rank_skew_safe", with_events(EV_V + """
SELECT Id, ranker_id, v,
  CAST(row_number() OVER (PARTITION BY ranker_id ORDER BY v DESC NULLS LAST, Id) AS INTEGER) AS strict_rank
FROM evn"""))
def q_strict_rank_skew_safe(spark, sf_dir):
    """H7 without a session window: position of the unique key
    (missing, -v, Id) from range-partitioned counts."""
    from ..functions.skew import add_strict_rank_skew_safe
    ev = events_with_nulls(spark, sf_dir).select("Id", "ranker_id", "v")
    return add_strict_rank_skew_safe(ev, "v")


@query("dense_rank_skew_safe", with_events(EV_V + """
SELECT Id, ranker_id, v,
  CASE WHEN v IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY ranker_id ORDER BY v DESC NULLS LAST) AS INTEGER) END
  AS dense_rank
FROM evn"""))
def q_dense_rank_skew_safe(spark, sf_dir):
    """H3 without a session window: distinct values above, from counts."""
    from ..functions.skew import add_dense_rank_desc_skew_safe
    ev = events_with_nulls(spark, sf_dir).select("Id", "ranker_id", "v")
    return add_dense_rank_desc_skew_safe(ev, "v")
