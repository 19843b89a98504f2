"""Queries on stored sketches (C6, E9, G3, G5, N1, N2). A sketch's estimates have
no twin in SQL, so the queries report exact counts and whether the estimates are
within their stated bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import sql_round
from ..operators import profile as N
from ..operators import sketch as K
from ..session import note_scratch, scratch_path
from ..sources.views import options_view
from .oracle import with_options
from .q_session import rounded
from .registry import query

NUMBERS = ["totalPrice", "taxes", "companyID", "legs0_segments0_seatsAvailable", "miniRules0_monetaryAmount"]
KEYS = ["ranker_id", "profileId", "searchRoute", "nationality", "corporateTariffCode", "legs0_segments0_marketingCarrier_code"]
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.9)


def _options(spark, sf_dir):
    return options_view(spark, sf_dir, materialize=True, columns=["requestDate", *NUMBERS, *KEYS])


def _store(spark, options) -> K.SketchStore:
    """The store as it grows: all years but the last, then the last alone."""
    path = scratch_path(spark, f"sketches-{uuid.uuid4().hex}")
    note_scratch(path)
    store = K.SketchStore(spark, path, NUMBERS + KEYS)
    year = F.year("requestDate")
    last = options.agg(F.max(year)).first()[0]
    return store.add(options.filter(year < last), year).add(options.filter(year == last), year)


def _partitions_sql() -> str:
    rows = []
    for c in NUMBERS + KEYS:
        x = (f"round(min(CAST({c} AS DOUBLE)), 6) AS lo, round(max(CAST({c} AS DOUBLE)), 6) AS hi"
             if c in NUMBERS else "min(CAST(NULL AS DOUBLE)) AS lo, max(CAST(NULL AS DOUBLE)) AS hi")
        if c in ("ranker_id", "profileId"):
            x = f"CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi"
        rows.append(f"SELECT CAST(year(requestDate) AS VARCHAR) AS part, '{c}' AS \"column\", count(*) AS n, "
                    f"count(*) - count({c}) AS missing, {x} FROM options GROUP BY year(requestDate)")
    return with_options("\nUNION ALL ".join(rows))


@query("sketch_partitions", _partitions_sql())
def q_sketch_partitions(spark, sf_dir):
    """The exact part of what the store holds, per year and column."""
    store = _store(spark, _options(spark, sf_dir))
    return rounded(store.rows().select("part", "column", "n", "missing", "lo", "hi"))


@query("sketch_quantiles", with_options("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, count({c}) AS n, true AS within FROM options HAVING count({c}) > 0"
    for c in NUMBERS for p in QUANTILES)))
def q_sketch_quantiles(spark, sf_dir):
    """Quantiles from merged sketches, checked against exact ranks."""
    options = _options(spark, sf_dir)
    found = _store(spark, options).quantiles(QUANTILES).filter(F.col("column").isin(NUMBERS))
    return K.rank_errors(options, found, NUMBERS).select(
        "column", sql_round("p", 2).alias("p"), "n", (F.col("rank_error") <= K.RANK_BOUND).alias("within"))


@query("sketch_profile", with_options("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct, count(DISTINCT {c}) AS unique_count, "
    f"true AS within FROM options" for c in NUMBERS + KEYS)))
def q_sketch_profile(spark, sf_dir):
    """N2 from merged sketches; the exact distinct count is worked out beside it."""
    options = _options(spark, sf_dir)
    exact = N.profile_missing(options, NUMBERS + KEYS, exact=True).select("column", "unique_count")
    told = _store(spark, options).profile().withColumnRenamed("unique_count", "told")
    off = F.abs(F.col("told") - F.col("unique_count"))
    return rounded(told.join(exact, "column").select(
        "column", "missing_count", "missing_pct", "unique_count",
        (off <= F.greatest(F.lit(1.0), F.col("unique_count") * K.DISTINCT_BOUND)).alias("within")))
