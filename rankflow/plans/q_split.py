"""Queries for splits and folds (K1-K3) and the CV summary (L4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import flag
from ..functions.ranking import strict_rank
from ..operators import metrics as M
from ..operators import split as K
from ..sources.views import options_view
from .oracle import options_ctes, with_options
from .q_session import rounded
from .registry import query

H32 = "CAST(('0x' || substr(md5({s}), 1, 8)) AS BIGINT)"


@query("group_split", with_options(f"""
SELECT DISTINCT ranker_id,
  {H32.format(s="'42_' || CAST(ranker_id AS VARCHAR)")} / CAST(4294967296 AS DOUBLE) >= 0.7 AS is_test
FROM options"""))
def q_group_split(spark, sf_dir):
    """K1 (hash mode): test flag per session, about 30 % of sessions."""
    o = options_view(spark, sf_dir)
    return o.select("ranker_id", K.split_flag().alias("is_test")).distinct()


@query("group_split_exact", with_options("""
SELECT ranker_id, i >= floor(n * 0.7) AS is_test FROM (
  SELECT ranker_id, row_number() OVER (ORDER BY md5('42_' || CAST(ranker_id AS VARCHAR)), ranker_id) - 1 AS i,
         count(*) OVER () AS n
  FROM (SELECT DISTINCT ranker_id FROM options))"""))
def q_group_split_exact(spark, sf_dir):
    """K1 (exact mode): the first floor(0.7 n) sessions by md5 are train."""
    return K.exact_split_keys(options_view(spark, sf_dir))


@query("group_folds", with_options(f"""
SELECT DISTINCT ranker_id, CAST({H32.format(s="CAST(ranker_id AS VARCHAR)")} % 5 AS INTEGER) AS fold
FROM options"""))
def q_group_folds(spark, sf_dir):
    """K2 (hash mode): fold of every session, k = 5."""
    return K.hash_folds(options_view(spark, sf_dir), 5).select("ranker_id", "fold").distinct()


@query("group_folds_balanced", with_options("""
SELECT ranker_id, CAST(CASE WHEN floor(i / 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS fold
FROM (SELECT ranker_id, row_number() OVER (ORDER BY size DESC, ranker_id) - 1 AS i
      FROM (SELECT ranker_id, count(*) AS size FROM options GROUP BY ranker_id))"""))
def q_group_folds_balanced(spark, sf_dir):
    """K2 (balanced mode): serpentine deal of sessions by size, k = 5."""
    return K.balanced_fold_keys(options_view(spark, sf_dir), 5)


@query("group_folds_greedy", f"""WITH RECURSIVE {options_ctes()},
z AS MATERIALIZED (SELECT ranker_id, size, row_number() OVER (ORDER BY size DESC, ranker_id) AS i
  FROM (SELECT ranker_id, count(*) AS size FROM options GROUP BY ranker_id)),
g AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS ranker_id, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT z.i, z.ranker_id, list_position(g.loads, list_min(g.loads)) - 1,
         [CASE WHEN f = list_position(g.loads, list_min(g.loads)) THEN g.loads[f] + z.size ELSE g.loads[f] END for f in range(1, 6)]
  FROM g JOIN z ON z.i = g.i + 1)
SELECT ranker_id, CAST(fold AS INTEGER) AS fold FROM g WHERE i > 0""")
def q_group_folds_greedy(spark, sf_dir):
    """K2 (greedy): largest session first, to the fold with the fewest rows, k = 5."""
    return K.greedy_fold_keys(options_view(spark, sf_dir), 5)


@query("cv_summary", with_options(f"""
, f AS (
  SELECT fold, avg(CASE WHEN rp <= 3 THEN 1.0 ELSE 0.0 END) AS hitrate_all,
         CASE WHEN count(*) FILTER (WHERE n > 10) > 0
              THEN (count(*) FILTER (WHERE n > 10 AND rp <= 3)) / (count(*) FILTER (WHERE n > 10))
              ELSE 0.0 END AS hitrate_large
  FROM (SELECT selected, CAST({H32.format(s="CAST(ranker_id AS VARCHAR)")} % 5 AS INTEGER) AS fold,
               row_number() OVER (PARTITION BY ranker_id ORDER BY totalPrice ASC NULLS LAST, Id) AS rp,
               count(*) OVER (PARTITION BY ranker_id) AS n FROM options)
  WHERE selected = 1 GROUP BY fold)
SELECT count(*) AS folds, round(avg(hitrate_all), 6) AS hitrate_all_mean,
       round(stddev_pop(hitrate_all), 6) AS hitrate_all_std,
       round(avg(hitrate_large), 6) AS hitrate_large_mean, round(stddev_pop(hitrate_large), 6) AS hitrate_large_std
FROM f"""))
def q_cv_summary(spark, sf_dir):
    """L4 + K3: per-fold HitRate@3 of the price baseline (all / >10), then
    the mean and population std across the five folds."""
    o = K.hash_folds(options_view(spark, sf_dir), 5)
    r = o.select("selected", "fold", strict_rank("totalPrice", ascending=True).alias("rp"),
                 F.count(F.lit(1)).over(Window.partitionBy("ranker_id")).alias("n"))
    pos = r.filter(F.col("selected") == 1)
    large = F.col("n") > 10
    per_fold = pos.groupBy("fold").agg(
        F.avg(flag(F.col("rp") <= 3).cast("double")).alias("hitrate_all"),
        F.when(F.count_if(large) > 0, F.count_if(large & (F.col("rp") <= 3)) / F.count_if(large))
         .otherwise(F.lit(0.0)).alias("hitrate_large"))
    return rounded(M.cv_summary(per_fold))
