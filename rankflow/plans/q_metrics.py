"""Queries for the metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import sql_round
from ..functions.ranking import dense_rank_desc
from ..operators import metrics as M
from ..sources.views import events_view, options_view
from .oracle import with_events, with_options
from .q_session import rounded
from .registry import query


def _events_ranked(spark, sf_dir):
    ev = events_view(spark, sf_dir)
    return ev.withColumn("rank", dense_rank_desc("score"))


@query("hitrate_rows", with_events("""
, r AS (
  SELECT *, CASE WHEN score IS NOT NULL THEN dense_rank() OVER (
           PARTITION BY ranker_id ORDER BY score DESC NULLS LAST) END AS rnk,
         count(*) OVER (PARTITION BY ranker_id) AS n
  FROM ev)
SELECT 3 AS k, m AS min_group_size, count(*) AS positives,
       CAST(coalesce(sum(CASE WHEN rnk <= 3 THEN 1 ELSE 0 END), 0) AS BIGINT) AS hits,
       CASE WHEN count(*) > 0 THEN sum(CASE WHEN rnk <= 3 THEN 1 ELSE 0 END) / count(*) ELSE 0.0 END AS hitrate
FROM r, (VALUES (0), (10)) t(m)
WHERE selected = 1 AND n > m
GROUP BY m"""))
def q_hitrate_rows(spark, sf_dir):
    """L1 on the events sessions (tied scores), dense ranks as in CV."""
    df = _events_ranked(spark, sf_dir)
    return M.hitrate_rows(df, "rank", k=3, min_group_size=0).unionByName(
        M.hitrate_rows(df, "rank", k=3, min_group_size=10))


@query("hitrate_sessions", with_options("""
SELECT 3 AS k, 10 AS min_group_size, count(*) AS sessions,
       CAST(sum(CASE WHEN hit > 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       CASE WHEN count(*) > 0 THEN sum(CASE WHEN hit > 0 THEN 1 ELSE 0 END) / count(*) ELSE 0.0 END AS hitrate
FROM (
  SELECT ranker_id, max(CASE WHEN rnk <= 3 THEN coalesce(selected, 0) END) AS hit, max(n) AS n
  FROM (SELECT ranker_id, selected,
               row_number() OVER (PARTITION BY ranker_id ORDER BY -totalPrice DESC NULLS LAST, Id) AS rnk,
               count(*) OVER (PARTITION BY ranker_id) AS n
        FROM options) GROUP BY ranker_id)
WHERE n > 10"""))
def q_hitrate_sessions(spark, sf_dir):
    """L2 with the price baseline as the score (cheapest = best)."""
    df = options_view(spark, sf_dir).withColumn("score", -F.col("totalPrice"))
    return M.hitrate_sessions(df, "score", k=3, min_group_size=10)


BASELINE_SQL = with_options("""
SELECT baseline, subset, positives, hits,
       round(CASE WHEN positives > 0 THEN hits / positives ELSE 0.0 END, 6) AS hitrate
FROM (
  SELECT b.baseline, s.subset,
         count(*) AS positives,
         count(*) FILTER (WHERE CASE b.baseline WHEN 'price' THEN rp WHEN 'duration' THEN rd ELSE rr END <= 3) AS hits
  FROM (SELECT *,
          row_number() OVER (PARTITION BY ranker_id ORDER BY totalPrice ASC NULLS LAST, Id) AS rp,
          row_number() OVER (PARTITION BY ranker_id ORDER BY legs0_duration ASC NULLS LAST, Id) AS rd,
          row_number() OVER (PARTITION BY ranker_id ORDER BY md5('42_' || CAST(Id AS VARCHAR)), Id) AS rr,
          count(*) OVER (PARTITION BY ranker_id) AS n
        FROM options) o,
       (VALUES ('price'), ('duration'), ('random')) b(baseline),
       (VALUES ('all'), ('large')) s(subset)
  WHERE o.selected = 1 AND (s.subset = 'all' OR o.n > 10)
  GROUP BY b.baseline, s.subset)""")


@query("baseline_hitrates", BASELINE_SQL)
def q_baseline_hitrates(spark, sf_dir):
    """Cheapest-first, shortest-first and random baselines."""
    return rounded(M.baseline_hitrates(options_view(spark, sf_dir)))


@query("ndcg_at_k", with_events("""
, p AS (
  SELECT ranker_id, selected, row_number() OVER (
           PARTITION BY ranker_id ORDER BY rnk ASC NULLS LAST, Id) AS pos
  FROM (SELECT *, CASE WHEN score IS NOT NULL THEN dense_rank() OVER (
                    PARTITION BY ranker_id ORDER BY score DESC NULLS LAST) END AS rnk FROM ev)),
s AS (
  SELECT ranker_id,
         sum(CASE WHEN pos <= 10 THEN coalesce(CAST(selected AS DOUBLE), 0.0) / log2(pos + 1) END) AS dcg,
         sum(coalesce(CAST(selected AS DOUBLE), 0.0)) AS npos
  FROM p GROUP BY ranker_id),
t AS (
  SELECT CASE WHEN least(10, npos) > 0
              THEN coalesce(dcg, 0.0) / list_sum(list_transform(range(1, CAST(least(10, npos) AS INTEGER) + 1),
                                                                lambda i: 1.0 / log2(i + 1)))
              ELSE 0.0 END AS ndcg
  FROM s)
SELECT 10 AS k, count(*) AS sessions, round(avg(ndcg), 6) AS ndcg FROM t"""))
def q_ndcg(spark, sf_dir):
    """L3 on the events sessions, dense ranks with ties broken by Id."""
    return rounded(M.ndcg_at_k(_events_ranked(spark, sf_dir), "rank", k=10))


@query("prediction_analysis", with_events("""
SELECT * FROM
  (SELECT min(score) AS score_min, max(score) AS score_max, round(avg(score), 6) AS score_mean,
          round(stddev_samp(score), 6) AS score_std, round(quantile_cont(score, 0.5), 6) AS score_median FROM ev) a,
  (SELECT round(avg(rg), 6) AS mean_range, min(rg) AS min_range, max(rg) AS max_range,
          count(*) FILTER (WHERE rg = 0) AS groups_no_separation
   FROM (SELECT ranker_id, max(score) - min(score) AS rg FROM ev GROUP BY ranker_id)) b"""))
def q_prediction_analysis(spark, sf_dir):
    """Score stats and per-session separation."""
    found = M.prediction_analysis(events_view(spark, sf_dir), "score")
    return found.withColumns({c: sql_round(F.col(c), 6) for c in ("score_mean", "score_std", "score_median", "mean_range")})


@query("value_histogram", with_events("""
SELECT rnk AS rank, count(*) AS n FROM (
  SELECT CASE WHEN score IS NOT NULL THEN CAST(dense_rank() OVER (
           PARTITION BY ranker_id ORDER BY score DESC NULLS LAST) AS INTEGER) END AS rnk FROM ev)
GROUP BY rnk"""))
def q_value_histogram(spark, sf_dir):
    """G4 + L5: distribution of dense ranks (value counts)."""
    return M.rank_distribution(events_view(spark, sf_dir), "score")
