"""Queries for projection / cleaning (C) and row-wise / scalar functions (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import clean as C
from ..operators.split import group_split
from ..sources.views import events_view, options_view
from . import feature_sql as Q
from .oracle import with_events, with_options
from .q_encode import CTE_TR, LABEL_COLS, _dict_sql, _encode_sql
from .q_session import rounded
from .registry import query

_CARRIERS = [Q.sc(L, S, a) for L in Q.LEGS for S in Q.SEGS
             for a in ("marketingCarrier_code", "operatingCarrier_code")]
_SEG_DUR = Q.seg_list("duration")


def _simple_sql() -> str:
    h = "coalesce(hour(requestDate), 12)"
    d = "coalesce(isodow(requestDate) - 1, 0)"
    tot = f"({Q.row_count(_SEG_DUR)})"
    carriers = ", ".join(f"coalesce({c}, 'missing')" for c in _CARRIERS)
    feats = [
        ("totalPrice", "totalPrice"), ("taxes", "taxes"),
        ("price_log", "round(ln(1 + coalesce(totalPrice, 0.0)), 6)"),
        ("tax_ratio", "round(coalesce(taxes, 0.0) / (coalesce(totalPrice, 1.0) + 1e-6), 6)"),
        ("request_hour", h), ("request_day_of_week", d),
        ("is_weekend", Q.flag(f"{d} >= 5")), ("is_business_hours", Q.flag(f"{h} >= 9 AND {h} <= 17")),
        ("total_segments", tot), ("has_connections", Q.flag(f"{tot} > 1")),
        ("route_length", "length(coalesce(searchRoute, ''))"),
        ("is_round_trip", Q.flag("contains(searchRoute, '/')")),
        ("unique_carriers", f"len(list_distinct([{carriers}]))"),
        ("isVip_flag", Q.flag("isVip")), ("bySelf_flag", Q.flag("bySelf")),
        ("isAccess3D_flag", Q.flag("isAccess3D")),
        ("pricingInfo_isAccessTP_flag", Q.flag("pricingInfo_isAccessTP")),
    ] + [(f"{c}_encoded", f"e.{c}_encoded") for c in LABEL_COLS]
    sel = ", ".join(f"coalesce(TRY_CAST({e} AS DOUBLE), 0.0) AS {n}" for n, e in feats)
    return with_options(f"""{CTE_TR}
dict AS ({_dict_sql(LABEL_COLS)}),
enc AS ({_encode_sql(LABEL_COLS, "_encoded")})
SELECT o.Id, o.ranker_id, o.selected, {sel}
FROM od o JOIN enc e ON o.Id = e.Id""")


@query("clean_select", _simple_sql())
def q_clean_select(spark, sf_dir):
    """C1-C4 + C3: the compact 22-feature table (encoders fitted on train)."""
    o = options_view(spark, sf_dir, materialize=True)
    train, _ = group_split(o, label=None)
    model = C.fit_simple_encoder(C.simple_features(train))
    return rounded(C.select_features(model.transform(C.simple_features(o))))


IMPUTE_COLS = ["taxes", "legs0_duration", "legs1_duration", "miniRules0_monetaryAmount",
               "miniRules1_percentage", "legs1_segments0_seatsAvailable"]


@query("median_impute", with_options(f"""{CTE_TR}
m AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in IMPUTE_COLS)} FROM tr)
SELECT Id, {", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in IMPUTE_COLS)} FROM od, m"""))
def q_median_impute(spark, sf_dir):
    """Nulls filled with medians fitted on the train split."""
    o = options_view(spark, sf_dir, materialize=True, columns=["Id", "ranker_id", *IMPUTE_COLS])
    train, _ = group_split(o, label=None)
    model = C.MedianImputer(IMPUTE_COLS).fit(train)
    return rounded(model.transform(o.select("Id", *IMPUTE_COLS))
                   .select("Id", *[F.col(c).cast("double").alias(c) for c in IMPUTE_COLS]))


@query("epoch_seconds", with_options("""
SELECT Id, date_diff('second', TIMESTAMP '1970-01-01 00:00:00', requestDate) AS requestDate,
       date_diff('second', TIMESTAMP '1970-01-01 00:00:00', legs0_departureAt) AS legs0_departureAt,
       date_diff('second', TIMESTAMP '1970-01-01 00:00:00', legs1_arrivalAt) AS legs1_arrivalAt
FROM options"""))
def q_epoch_seconds(spark, sf_dir):
    """Datetime columns as epoch seconds (missing stays null)."""
    o = options_view(spark, sf_dir).select("Id", "requestDate", "legs0_departureAt", "legs1_arrivalAt")
    return C.datetimes_to_epoch(o)


DOWNSIZE_COLS = ["Id", "profileId", "companyID", "pricingInfo_passengerCount",
                 "legs0_segments0_seatsAvailable", "legs1_segments3_baggageAllowance_quantity",
                 "totalPrice", "taxes", "legs0_duration"]
_TYPES = {"Id": "bigint", "profileId": "bigint", "companyID": "int", "pricingInfo_passengerCount": "int",
          "legs0_segments0_seatsAvailable": "int", "legs1_segments3_baggageAllowance_quantity": "int",
          "totalPrice": "double", "taxes": "double", "legs0_duration": "double"}


def _downsize_sql() -> str:
    parts = []
    for c in DOWNSIZE_COLS:
        t = _TYPES[c]
        mn, mx = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)"
        if t in ("int", "bigint"):
            new = (f"CASE WHEN {mn} > -128 AND {mx} < 127 THEN 'tinyint' "
                   f"WHEN {mn} > -32768 AND {mx} < 32767 THEN 'smallint' "
                   f"WHEN {mn} > -2147483648 AND {mx} < 2147483647 THEN 'int' "
                   f"WHEN {mn} > -9223372036854775808 AND {mx} < 9223372036854775807 THEN 'bigint' "
                   f"ELSE '{t}' END")
        else:
            new = (f"CASE WHEN {mn} > -65504.0 AND {mx} < 65504.0 THEN 'float' "
                   f"WHEN {mn} > -3.4028234663852886e38 AND {mx} < 3.4028234663852886e38 THEN 'float' "
                   f"ELSE 'double' END")
        parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS old_type, {new} AS new_type, {mn} AS min, "
                     f"{mx} AS max FROM options")
    return with_options("\n" + "\nUNION ALL ".join(parts))


@query("downsize_report", _downsize_sql())
def q_downsize_report(spark, sf_dir):
    """Smallest type that holds each numeric column's range."""
    return C.downsize_report(options_view(spark, sf_dir), DOWNSIZE_COLS)


@query("tolerant_parse", with_events(r"""
SELECT Id,
  TRY_CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS ts_parsed,
  TRY_CAST(event_type AS TIMESTAMP) AS bad_ts,
  coalesce(TRY_CAST(CAST(score AS VARCHAR) AS DOUBLE), 0.0) AS value_num,
  coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS bad_num,
  coalesce(TRY_CAST(regexp_extract(props, ':\s*(\d+)', 1) AS DOUBLE), 0.0) AS k_num
FROM ev"""))
def q_tolerant_parse(spark, sf_dir):
    """C12 + C13: tolerant date and number parses (bad input -> null / 0)."""
    ev = events_view(spark, sf_dir)
    return ev.select(
        "Id",
        X.to_ts(F.col("ts").cast("string")).cast("timestamp_ntz").alias("ts_parsed"),
        X.to_ts("event_type").cast("timestamp_ntz").alias("bad_ts"),
        X.numeric_or_zero(F.col("score").cast("string")).alias("value_num"),
        X.numeric_or_zero("event_type").alias("bad_num"),
        X.numeric_or_zero(F.regexp_extract("props", r":\s*(\d+)", 1)).alias("k_num"))


_L1_DUR = Q.seg_list("duration", legs=(1,))
_L1_CAB = Q.seg_list("cabinClass", legs=(1,))
_L1_MK = Q.seg_list("marketingCarrier_code", legs=(1,))


@query("rowwise_ops", with_options(f"""
SELECT Id,
  {Q.row_count(_L1_DUR)} AS n_nonnull,
  least({", ".join(_L1_DUR)}) AS row_min, greatest({", ".join(_L1_DUR)}) AS row_max,
  {Q.row_sum(_L1_DUR)} AS row_sum,
  round(CASE WHEN ({Q.row_count(_L1_DUR)}) > 0 THEN CAST({Q.row_sum(_L1_DUR)} AS DOUBLE) / ({Q.row_count(_L1_DUR)}) END, 6)
    AS row_mean,
  {Q.any_eq(_L1_CAB, "4.0")} AS any_first_class,
  {Q.row_nunique(_L1_MK)} AS nunique_skip,
  CAST(len(list_distinct([{", ".join(f"coalesce({c}, 'missing')" for c in _L1_MK)}])) AS INTEGER) AS nunique_missing,
  {Q.flag("(isVip AND bySelf) OR NOT isAccess3D")} AS bool_combo,
  CAST(NOT coalesce(legs1_segments0_marketingCarrier_code = legs1_segments0_operatingCarrier_code, false)
       AS INTEGER) AS ne_nan
FROM options"""))
def q_rowwise(spark, sf_dir):
    """D8-D12 (+ P2 != on missing): row-wise count, min, max, sum, mean,
    any-equals, distinct counts and boolean combinators over leg-1 columns
    (absent segments are natural nulls)."""
    o = options_view(spark, sf_dir)
    return rounded(o.select(
        "Id", X.row_count(_L1_DUR).alias("n_nonnull"), X.row_min(_L1_DUR).alias("row_min"),
        X.row_max(_L1_DUR).alias("row_max"), X.row_sum(_L1_DUR).alias("row_sum"),
        X.row_mean(_L1_DUR).alias("row_mean"), X.any_equals(_L1_CAB, 4.0).alias("any_first_class"),
        X.row_nunique(_L1_MK).alias("nunique_skip"),
        X.row_nunique(_L1_MK, count_missing=True).alias("nunique_missing"),
        X.flag((F.col("isVip") & F.col("bySelf")) | ~F.col("isAccess3D")).alias("bool_combo"),
        X.ne_nan("legs1_segments0_marketingCarrier_code",
                 "legs1_segments0_operatingCarrier_code").cast("int").alias("ne_nan")))


@query("scalar_ops", with_options(f"""
SELECT Id,
  CAST(hour(legs0_departureAt) AS INTEGER) AS dep_hour, CAST(isodow(legs0_departureAt) - 1 AS INTEGER) AS dep_weekday,
  CAST(month(legs0_departureAt) AS INTEGER) AS dep_month, CAST(dayofyear(legs0_departureAt) AS INTEGER) AS dep_doy,
  CAST(floor(date_diff('second', legs0_departureAt, legs0_arrivalAt) / 86400) AS INTEGER) AS trip_days,
  round(date_diff('second', requestDate, legs0_departureAt) / CAST(3600.0 AS DOUBLE), 6) AS lead_hours,
  round(ln(1 + taxes), 6) AS taxes_log1p,
  round({Q.safe_div("totalPrice", "(pricingInfo_passengerCount - 1)")}, 6) AS safe_ratio,
  round(totalPrice / ((pricingInfo_passengerCount - 1) + 1e-6), 6) AS eps_ratio,
  CASE WHEN legs1_duration - 20 IS NULL THEN NULL ELSE greatest(legs1_duration - 20, 0.0) END AS clipped,
  {Q.flag("contains(searchRoute, '/')")} AS has_slash, CAST(length(searchRoute) AS INTEGER) AS route_len
FROM options"""))
def q_scalar(spark, sf_dir):
    """Calendar parts, floored day differences, log1p, safe and
    epsilon division, lower clip, contains / length."""
    o = options_view(spark, sf_dir)
    dep, arr = F.col("legs0_departureAt"), F.col("legs0_arrivalAt")
    den = F.col("pricingInfo_passengerCount") - 1
    return rounded(o.select(
        "Id", F.hour(dep).alias("dep_hour"), X.weekday0(dep).alias("dep_weekday"),
        F.month(dep).alias("dep_month"), F.dayofyear(dep).alias("dep_doy"),
        X.floor_days(arr, dep).alias("trip_days"),
        (X.seconds_between(dep, F.col("requestDate")) / F.lit(3600.0)).alias("lead_hours"),
        F.ln(F.lit(1.0) + F.col("taxes")).alias("taxes_log1p"),
        X.safe_div("totalPrice", den).alias("safe_ratio"), X.eps_div("totalPrice", den).alias("eps_ratio"),
        X.clip_lower(F.col("legs1_duration") - 20).alias("clipped"),
        X.flag(F.col("searchRoute").contains("/")).alias("has_slash"),
        F.char_length("searchRoute").alias("route_len")))


def _per_passenger(pdf):
    """A user's row function (pandas): price per passenger, upper-case route."""
    import pandas as pd
    return pd.DataFrame({"Id": pdf["Id"],
                         "price_per_passenger": pdf["totalPrice"] / pdf["pricingInfo_passengerCount"],
                         "route_upper": pdf["searchRoute"].str.upper()})


@query("user_rows_fn", with_options("""
SELECT Id, totalPrice / pricingInfo_passengerCount AS price_per_passenger, upper(searchRoute) AS route_upper
FROM options"""))
def q_user_rows_fn(spark, sf_dir):
    """P2u: a pandas row function applied with mapInPandas (Arrow batches)."""
    from ..operators.udf import apply_rows
    o = options_view(spark, sf_dir).select("Id", "totalPrice", "pricingInfo_passengerCount", "searchRoute")
    return apply_rows(o, _per_passenger, "Id long, price_per_passenger double, route_upper string")
