"""Queries for validation (M2-M5) and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import dense_rank_desc, strict_rank
from ..operators import profile as N
from ..operators import validate as V
from ..operators.split import group_split
from ..sources.views import events_view, option_columns, option_types, options_view
from .oracle import with_events, with_options
from .q_features import HASH_TRAIN
from .q_session import rounded
from .registry import query


def _rows(items):
    return "\nUNION ALL ".join(f"SELECT '{c}' AS \"check\", {sev} AS severity, CAST({v} AS DOUBLE) AS value{src}"
                               for c, sev, v, src in items)


@query("check_train_test", with_options(f"""
, tr AS (SELECT * FROM options WHERE {HASH_TRAIN}),
per AS (SELECT ranker_id, sum(selected) AS s, count(*) AS n FROM tr GROUP BY ranker_id),
a AS (SELECT sum(s) AS pos, sum(n) AS nrows, count(*) FILTER (WHERE s <> 1) AS bad FROM per)
{_rows([("label_in_train", "'ok'", 1, ""), ("label_not_in_test", "'ok'", 1, ""),
        ("essential_Id", "'ok'", 1, ""), ("essential_ranker_id", "'ok'", 1, ""),
        ("selection_rate", "CASE WHEN pos / nrows < 0.001 OR pos / nrows > 0.1 THEN 'warning' ELSE 'ok' END",
         "pos / nrows", " FROM a"),
        ("sessions_not_one_selection", "CASE WHEN bad > 0 THEN 'warning' ELSE 'ok' END", "bad", " FROM a")])}"""))
def q_check_train_test(spark, sf_dir):
    """M2: train / test contract on the hash split of the option table."""
    train, test = group_split(options_view(spark, sf_dir))
    return V.check_train_test(train, test)


EV_SUB = """, sub AS (SELECT Id, ranker_id, CAST(dense_rank() OVER (
    PARTITION BY ranker_id ORDER BY score DESC NULLS LAST) AS INTEGER) AS selected FROM ev),
g AS (SELECT ranker_id, min(selected) AS mn, max(selected) AS mx, count(*) AS n,
             count(DISTINCT selected) AS d FROM sub GROUP BY ranker_id)"""


def _events_sub(spark, sf_dir):
    ev = events_view(spark, sf_dir)
    return ev.select("Id", "ranker_id", dense_rank_desc("score").alias("selected")), ev


@query("check_submission", with_events(EV_SUB + """,
a AS (SELECT count(*) FILTER (WHERE NOT (mn = 1 AND mx = n AND d = n)) AS invalid_sessions,
             count(*) FILTER (WHERE d <> n) AS duplicate_rank_sessions,
             CAST(sum(n) AS BIGINT) AS rows_submission FROM g),
t AS (SELECT count(*) AS rows_test FROM ev)
SELECT rows_submission, rows_test, rows_submission = rows_test AS row_count_ok, true AS columns_ok,
       invalid_sessions, duplicate_rank_sessions,
       (rows_submission = rows_test AND invalid_sessions = 0) AS valid
FROM a, t"""))
def q_check_submission(spark, sf_dir):
    """M3: a dense-rank submission (ties!) checked against its test rows."""
    sub, ev = _events_sub(spark, sf_dir)
    return V.check_submission(sub, ev)


@query("submission_report", with_events(EV_SUB + """,
a AS (SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS total_groups,
             count(*) FILTER (WHERE NOT (mn = 1 AND mx = n AND d = n)) AS invalid_sessions,
             CAST(min(mn) AS DOUBLE) AS min_rank, CAST(max(mx) AS DOUBLE) AS max_rank FROM g),
s AS (SELECT coalesce(list(ranker_id ORDER BY ranker_id), []) AS sample_invalid_sessions FROM (
        SELECT ranker_id FROM g WHERE NOT (mn = 1 AND mx = n AND d = n) ORDER BY ranker_id LIMIT 5)),
dup AS (SELECT count(*) FILTER (WHERE c > 1) AS duplicate_ids FROM (SELECT Id, count(*) AS c FROM sub GROUP BY Id)),
np AS (SELECT count(*) FILTER (WHERE selected <= 0) AS non_positive_ranks FROM sub)
SELECT total_rows, total_groups, total_rows / total_groups AS avg_group_size, min_rank, max_rank,
       duplicate_ids, invalid_sessions, sample_invalid_sessions, non_positive_ranks, true AS integer_ranks,
       (duplicate_ids = 0 AND invalid_sessions = 0 AND non_positive_ranks = 0) AS valid
FROM a, s, dup, np"""))
def q_submission_report(spark, sf_dir):
    """M4: full submission report with up to five invalid session keys."""
    sub, _ = _events_sub(spark, sf_dir)
    return V.submission_report(sub)


@query("submission_summary", with_options("""
SELECT count(*) AS sessions, min(mn) AS min_rank, max(mx) AS max_rank, round(avg(n), 6) AS mean_group_size
FROM (SELECT ranker_id, count(*) AS n, min(r) AS mn, max(r) AS mx FROM (
        SELECT ranker_id, CAST(row_number() OVER (PARTITION BY ranker_id ORDER BY totalPrice, Id) AS INTEGER) AS r
        FROM options) GROUP BY ranker_id)"""))
def q_submission_summary(spark, sf_dir):
    """M5: summary of the cheapest-first submission."""
    o = options_view(spark, sf_dir)
    sub = o.select("Id", "ranker_id", strict_rank("totalPrice", ascending=True).alias("selected"))
    return rounded(V.submission_summary(sub))


@query("profile_dataset", with_options(f"""
SELECT s.nrows AS "rows", {len(option_columns())} AS "columns", s.sessions, round(s.target_rate, 6) AS target_rate,
       round(u.sessions_per_user, 6) AS sessions_per_user, round(s.avg_session_size, 6) AS avg_session_size,
       round(s.median_session_size, 6) AS median_session_size, s.max_session_size, s.large_sessions_count,
       round(s.large_sessions_pct, 6) AS large_sessions_pct
FROM (SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS nrows, avg(n) AS avg_session_size,
             quantile_cont(n, 0.5) AS median_session_size, max(n) AS max_session_size,
             count(*) FILTER (WHERE n > 10) AS large_sessions_count,
             avg(CASE WHEN n > 10 THEN 1 ELSE 0 END) * 100 AS large_sessions_pct,
             sum(pos) / sum(n) AS target_rate
      FROM (SELECT ranker_id, count(*) AS n, sum(selected) AS pos FROM options GROUP BY ranker_id)) s,
     (SELECT avg(k) AS sessions_per_user FROM (
        SELECT profileId, count(DISTINCT ranker_id) AS k FROM options GROUP BY profileId)) u"""))
def q_profile_dataset(spark, sf_dir):
    """Dataset statistics of the option table."""
    return rounded(N.profile_dataset(options_view(spark, sf_dir)))


def _missing_sql() -> str:
    cols = option_types()
    aggs = ", ".join(f'count(*) FILTER (WHERE "{c}" IS NULL) AS m{i}, count(DISTINCT "{c}") AS d{i}'
                     for i, c in enumerate(cols))
    rows = "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", m{i} AS missing_count, round(m{i} * 100.0 / nrows, 6) AS missing_pct, "
        f"'{t}' AS dtype, d{i} AS unique_count FROM a" for i, (c, t) in enumerate(cols.items()))
    return with_options(f", a AS MATERIALIZED (SELECT count(*) AS nrows, {aggs} FROM options)\n{rows}")


@query("profile_missing", _missing_sql())
def q_profile_missing(spark, sf_dir):
    """Missing values, type and distinct count of every column."""
    return rounded(N.profile_missing(options_view(spark, sf_dir, materialize=True), exact=True))


def _corr_cols() -> list[str]:
    return [c for c, t in option_types().items()
            if t in ("bigint", "int", "double") and c != "selected"]


def _corr_sql() -> str:
    cols = _corr_cols()
    aggs = ", ".join(f"count({c}) AS n{i}, covar_pop({c}, selected) AS c{i}, var_pop({c}) AS vx{i}, "
                     f"var_pop(CASE WHEN {c} IS NOT NULL THEN CAST(selected AS DOUBLE) END) AS vy{i}"
                     for i, c in enumerate(cols))
    rows = "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, n{i} AS non_null, "
        f"round(CASE WHEN sqrt(vx{i} * vy{i}) > 0 THEN c{i} / sqrt(vx{i} * vy{i}) END, 6) AS correlation, "
        f"round(coalesce(abs(CASE WHEN sqrt(vx{i} * vy{i}) > 0 THEN c{i} / sqrt(vx{i} * vy{i}) END), 0.0), 6) "
        f"AS abs_correlation FROM a WHERE n{i} > 100" for i, c in enumerate(cols))
    return with_options(f", a AS MATERIALIZED (SELECT {aggs} FROM options)\n{rows}")


@query("profile_correlation", _corr_sql())
def q_profile_correlation(spark, sf_dir):
    """Pearson correlation of each numeric column with the label."""
    return rounded(N.profile_correlation(options_view(spark, sf_dir), columns=_corr_cols()))
