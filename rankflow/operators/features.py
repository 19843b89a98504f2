"""Feature families (E1-E22): each is ``DataFrame -> DataFrame`` and adds its
columns in one ``withColumns`` projection.

Column discovery (``'cabinClass' in name`` and the like) is done on
``df.columns`` at plan time, so no job runs to decide the schema. Output
columns are always emitted when their inputs exist (no data-dependent schema).

Where the reference's three feature sets disagree on a definition, the
``form`` argument picks it: ``"full"`` (the comprehensive set, default),
``"opt"`` (the optimised set) or ``"simple"`` (the compact 22-feature set).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.indexing import attach_row, exact_quantiles
from ..functions.exprs import (col, lit, all_equal_first, any_equals, clip_lower, eps_div, flag,
                               floor_days, ne_nan, numeric_or_zero, row_count, row_max,
                               row_mean, row_min, row_nunique, row_sum, safe_div,
                               seconds_between, tolerant_double, weekday0)

LEGS = (0, 1)
SEGMENTS = (0, 1, 2, 3)


# ---------------------------------------------------------------- helpers

def seg_col(L: int, S: int, attr: str) -> str:
    return f"legs{L}_segments{S}_{attr}"


def seg_cols(df: DataFrame, attr: str, legs=LEGS, segments=SEGMENTS) -> list[str]:
    """Existing per-segment columns for ``attr`` in (leg, segment) order."""
    have = set(df.columns)   # one schema fetch, not one per candidate
    return [seg_col(L, S, attr) for L in legs for S in segments if seg_col(L, S, attr) in have]


def cols_with(df: DataFrame, *parts: str) -> list[str]:
    """Columns whose name contains every ``part`` (the reference's pattern pick)."""
    return [c for c in df.columns if all(p in c for p in parts)]


def as_ts(df: DataFrame, name: str) -> Column:
    """Timestamps pass through; strings are parsed tolerantly (bad -> null)."""
    if isinstance(df.schema[name].dataType, StringType):
        return F.try_to_timestamp(col(name))
    return col(name)


def _hour_flags(h: Column, prefix: str) -> dict[str, Column]:
    return {
        f"{prefix}_is_early_morning": flag(h <= 6),
        f"{prefix}_is_morning": flag((h > 6) & (h <= 12)),
        f"{prefix}_is_afternoon": flag((h > 12) & (h <= 18)),
        f"{prefix}_is_evening": flag((h > 18) & (h <= 22)),
        f"{prefix}_is_late_night": flag(h > 22),
        f"{prefix}_is_red_eye": flag((h >= 22) | (h <= 6)),
        f"{prefix}_is_business_hours": flag((h >= 8) & (h <= 18)),
        f"{prefix}_is_early_flight": flag(h <= 6),
        f"{prefix}_is_late_flight": flag(h >= 22),
    }


# ---------------------------------------------------------------- E1-E4 time

def request_time_features(df: DataFrame, form: str = "full") -> DataFrame:
    """Request hour / weekday / month / day-of-year and flags."""
    if "requestDate" not in df.columns:
        return df
    t = as_ts(df, "requestDate")
    if form == "simple":
        h = F.coalesce(F.hour(t), lit(12))
        d = F.coalesce(weekday0(t), lit(0))
        return df.withColumns({"request_hour": h, "request_day_of_week": d,
                               "is_weekend": flag(d >= 5), "is_business_hours": flag((h >= 9) & (h <= 17))})
    h, d = F.hour(t), weekday0(t)
    cols = {"request_hour": h, "request_day_of_week": d, "request_month": F.month(t)}
    if form == "full":
        cols["request_day_of_year"] = F.dayofyear(t)
    cols["request_is_weekend"] = flag(d >= 5)
    cols["request_is_business_hours"] = flag((h >= 9) & (h <= 17))
    if form == "full":
        cols["request_is_morning"] = flag(h < 12)
        cols["request_is_evening"] = flag(h >= 18)
    return df.withColumns(cols)


def leg_time_features(df: DataFrame) -> DataFrame:
    """E2 + E3: departure hour / weekday / month with day-part flags, and
    arrival hour / weekday, per leg."""
    cols = {}
    for L in LEGS:
        dep, arr = f"legs{L}_departureAt", f"legs{L}_arrivalAt"
        if dep in df.columns:
            t = as_ts(df, dep)
            h, d = F.hour(t), weekday0(t)
            cols[f"leg{L}_departure_hour"] = h
            cols[f"leg{L}_departure_day_of_week"] = d
            cols[f"leg{L}_departure_month"] = F.month(t)
            cols.update(_hour_flags(h, f"leg{L}"))
            cols[f"leg{L}_is_weekend"] = flag(d >= 5)
        if arr in df.columns:
            t = as_ts(df, arr)
            cols[f"leg{L}_arrival_hour"] = F.hour(t)
            cols[f"leg{L}_arrival_day_of_week"] = weekday0(t)
    return df.withColumns(cols) if cols else df


def booking_lead_features(df: DataFrame) -> DataFrame:
    """Time from request to first departure. Days floor (-10 h is -1)."""
    if "requestDate" not in df.columns or "legs0_departureAt" not in df.columns:
        return df
    dep, req = as_ts(df, "legs0_departureAt"), as_ts(df, "requestDate")
    days = floor_days(dep, req)
    return df.withColumns({
        "days_to_departure": days,
        "hours_to_departure": seconds_between(dep, req) / lit(3600.0),
        "is_last_minute": flag(days <= 1),
        "is_advance_booking": flag(days >= 14),
    })


# ---------------------------------------------------------------- E5-E7 route

def segment_features(df: DataFrame) -> DataFrame:
    """E5: which segments exist (by duration), counts and connection flags."""
    cols, per_leg = {}, {}
    for L in LEGS:
        present = []
        for S in SEGMENTS:
            c = seg_col(L, S, "duration")
            if c in df.columns:
                cols[f"leg{L}_has_segment{S}"] = col(c).isNotNull().cast("int")
                present.append(c)
        per_leg[L] = row_count(present) if present else lit(0)
        cols[f"total_segments_leg{L}"] = per_leg[L]
    total = per_leg[0] + per_leg[1]
    cols.update({
        "total_segments": total,
        "has_connections_leg0": flag(per_leg[0] > 1),
        "has_connections_leg1": flag(per_leg[1] > 1),
        "has_any_connections": flag((per_leg[0] > 1) | (per_leg[1] > 1)),
        "has_connections_total": flag(total > 1),
        "is_round_trip": flag(per_leg[1] > 0),
        "is_complex_route": flag(total > 2),
        "max_segments_per_leg": F.greatest(per_leg[0], per_leg[1]),
    })
    return df.withColumns(cols)


def layover_features(df: DataFrame) -> DataFrame:
    """Leg duration minus its segments' durations, floored at 0, and
    short (<1) / medium [1, 4) / long (>=4) flags."""
    cols = {}
    for L in LEGS:
        d = f"legs{L}_duration"
        segs = seg_cols(df, "duration", legs=(L,))
        if d not in df.columns or not segs:
            continue
        lay = clip_lower(tolerant_double(d) - row_sum([tolerant_double(c) for c in segs]).cast("double"))
        cols[f"leg{L}_layover_time"] = lay
        cols[f"leg{L}_short_layover"] = flag(lay < 1)
        cols[f"leg{L}_medium_layover"] = flag((lay >= 1) & (lay < 4))
        cols[f"leg{L}_long_layover"] = flag(lay >= 4)
    return df.withColumns(cols) if cols else df


def search_route_features(df: DataFrame, form: str = "full") -> DataFrame:
    """E7: '/' in the search route (round trip) and its length
    (null stays null in the full form, 0 in the simple form)."""
    if "searchRoute" not in df.columns:
        return df
    r = col("searchRoute")
    slash = flag(r.contains("/"))
    if form == "simple":
        return df.withColumns({"route_length": F.char_length(F.coalesce(r, lit(""))),
                               "is_round_trip": slash})
    return df.withColumns({"route_contains_slash": slash, "is_round_trip_search": slash,
                           "route_length": F.char_length(r)})


# ---------------------------------------------------------------- E8-E10 price

def price_features(df: DataFrame, form: str = "full") -> DataFrame:
    """Price per hour, tax ratio, base price, high-tax flag, log price."""
    if "totalPrice" not in df.columns:
        return df
    p = col("totalPrice")
    cols = {}
    if "legs0_duration" in df.columns:
        dur = numeric_or_zero("legs0_duration")
        if "legs1_duration" in df.columns:
            dur = dur + numeric_or_zero("legs1_duration")
        cols["price_per_hour"] = safe_div(p, dur) if form == "full" else eps_div(p, dur)
    if "taxes" in df.columns:
        tx = col("taxes")
        if form == "full":
            ratio = safe_div(tx, p)
        elif form == "opt":
            ratio = eps_div(tx, p)
        else:
            ratio = eps_div(F.coalesce(tx, lit(0.0)), F.coalesce(p, lit(1.0)))
        cols["tax_ratio"] = ratio
        if form == "full":
            cols["base_price"] = p - F.coalesce(tx, lit(0.0))
            cols["has_high_taxes"] = flag(ratio > 0.2)
    cols["price_log"] = F.log1p(F.coalesce(p, lit(0.0)))
    return df.withColumns(cols)


def penalty_features(df: DataFrame) -> DataFrame:
    """Cancel (rule 0) and exchange (rule 1) penalties: sums, flags,
    percentage sums and ratios to the price."""
    cols = {}
    for rule, name in ((0, "cancel"), (1, "exchange")):
        amt = cols_with(df, f"miniRules{rule}", "monetaryAmount")
        pct = cols_with(df, f"miniRules{rule}", "percentage")
        if amt:
            tot = row_sum(amt).cast("double")
            cols[f"total_{name}_penalty"] = tot
            cols[f"has_{name}_penalty"] = flag(tot > 0)
            if "totalPrice" in df.columns:
                cols[f"{name}_penalty_ratio"] = eps_div(tot, col("totalPrice"))
        if pct:
            cols[f"total_{name}_penalty_pct"] = row_sum(pct).cast("double")
    return df.withColumns(cols) if cols else df


class PriceTiers:
    """Budget / premium / luxury flags from quantiles of the training
    prices (linear interpolation, as pandas). ``fit`` is one aggregate job;
    the fitted thresholds are literals in the transform."""

    def __init__(self, column: str = "totalPrice", q=(0.25, 0.75, 0.9)):
        self.column, self.q = column, tuple(q)
        self.thresholds: tuple[float, float, float] | None = None

    def fit(self, df: DataFrame) -> "PriceTiers":
        found = exact_quantiles(df, [self.column], self.q)
        self.thresholds = tuple(found.get((self.column, q)) for q in self.q)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        lo, hi, top = self.thresholds
        p = col(self.column)
        return df.withColumns({
            "is_budget_flight": flag(p < lit(lo)),
            "is_premium_flight": flag(p > lit(hi)),
            "is_luxury_flight": flag(p > lit(top)),
        })

    @staticmethod
    def transform_with(df: DataFrame, thresholds: DataFrame, column: str = "totalPrice") -> DataFrame:
        """Same transform against a one-row thresholds table (q25, q75, q90)
        kept on the cluster, for pipelines that never bring values back."""
        p = col(column)
        return (attach_row(df, thresholds)
                  .withColumns({"is_budget_flight": flag(p < col("q25")),
                                "is_premium_flight": flag(p > col("q75")),
                                "is_luxury_flight": flag(p > col("q90"))})
                  .drop("q25", "q75", "q90"))


# ---------------------------------------------------------------- E11-E13 carriers

def carrier_features(df: DataFrame, form: str = "full") -> DataFrame:
    """Main carrier and carrier consistency.
    full: distinct non-null marketing carriers == 1 (multi when > 1);
    opt: every later carrier null or equal to the first;
    simple: distinct carriers over marketing and operating codes with
    'missing' counted, and the first one as ``primary_carrier``."""
    mk = seg_cols(df, "marketingCarrier_code")
    if not mk:
        return df
    if form == "simple":
        cc = [c for c in df.columns if "Carrier_code" in c]
        return df.withColumns({"unique_carriers": row_nunique(cc, count_missing=True),
                               "primary_carrier": F.coalesce(col(cc[0]).cast("string"), lit("missing"))})
    cols = {"main_carrier": col(mk[0])}
    if len(mk) > 1:
        if form == "opt":
            cols["carrier_consistency"] = all_equal_first(mk)
        else:
            n = row_nunique(mk)
            cols["carrier_consistency"] = flag(n == 1)
            cols["multi_carrier_flight"] = flag(n > 1)
    return df.withColumns(cols)


def ff_match_features(df: DataFrame) -> DataFrame:
    """The frequent-flyer programme matches any marketing carrier."""
    mk = seg_cols(df, "marketingCarrier_code")
    if not mk or "frequentFlyer" not in df.columns:
        return df
    return df.withColumn("ff_carrier_match", any_equals(mk, col("frequentFlyer")))


def codeshare_features(df: DataFrame) -> DataFrame:
    """Marketing != operating per segment, paired by (leg, segment);
    a missing side counts as different (pandas ``!=``)."""
    cols, i = {}, 0
    for L in LEGS:
        for S in SEGMENTS:
            m, o = seg_col(L, S, "marketingCarrier_code"), seg_col(L, S, "operatingCarrier_code")
            if m in df.columns and o in df.columns:
                cols[f"seg{i}_codeshare"] = ne_nan(m, o).cast("int")
                i += 1
    return df.withColumns(cols) if cols else df


# ---------------------------------------------------------------- E14-E16 service

def cabin_features(df: DataFrame) -> DataFrame:
    """Best / worst cabin, consistency, class presence flags, and
    per-segment economy / business / first flags."""
    cc = cols_with(df, "cabinClass")
    if not cc:
        return df
    best, worst = row_max(cc), row_min(cc)
    cons = flag(best == worst)
    cols = {"best_cabin_class": best, "worst_cabin_class": worst, "cabin_class_consistency": cons,
            "has_economy": any_equals(cc, 1.0), "has_comfort": any_equals(cc, 2.0),
            "has_business": any_equals(cc, 3.0), "has_first": any_equals(cc, 4.0),
            "is_all_economy": flag(best == 1.0), "is_all_business_or_higher": flag(worst >= 3.0),
            "has_mixed_classes": lit(1) - cons}
    for L in LEGS:
        for S in SEGMENTS:
            c = seg_col(L, S, "cabinClass")
            if c in df.columns:
                cols[f"leg{L}_seg{S}_is_economy"] = flag(col(c) == 1.0)
                cols[f"leg{L}_seg{S}_is_business"] = flag(col(c) == 3.0)
                cols[f"leg{L}_seg{S}_is_first"] = flag(col(c) == 4.0)
    return df.withColumns(cols)


def seat_features(df: DataFrame) -> DataFrame:
    """Min / max / total / mean seats and availability bands."""
    sc = cols_with(df, "seatsAvailable")
    if not sc:
        return df
    mn = row_min(sc)
    return df.withColumns({
        "min_seats_available": mn, "max_seats_available": row_max(sc),
        "total_seats_available": row_sum(sc), "avg_seats_available": row_mean(sc),
        "very_limited_seats": flag(mn <= 2), "limited_seats": flag((mn > 2) & (mn <= 5)),
        "good_availability": flag(mn > 5),
    })


def baggage_features(df: DataFrame) -> DataFrame:
    """Min / max / total baggage allowance and consistency."""
    bc = cols_with(df, "baggageAllowance_quantity")
    if not bc:
        return df
    mn, mx = row_min(bc), row_max(bc)
    return df.withColumns({"min_baggage_allowance": mn, "max_baggage_allowance": mx,
                           "total_baggage_allowance": row_sum(bc),
                           "baggage_consistency": flag(mn == mx)})


# ---------------------------------------------------------------- E17-E21 user, policy, extras

USER_FLAGS = ("isVip", "bySelf", "isAccess3D")


def user_features(df: DataFrame) -> DataFrame:
    """User flags as 0/1 ints (missing -> 0) and VIP combinations."""
    cols = {c: flag(col(c).cast("boolean")) for c in USER_FLAGS if c in df.columns}
    if "isVip" in df.columns and "bySelf" in df.columns:
        vip, own = col("isVip").cast("boolean"), col("bySelf").cast("boolean")
        cols["vip_independent"] = flag(vip & own)
        cols["vip_managed"] = flag(vip & ~F.coalesce(own, lit(False)))
    return df.withColumns(cols) if cols else df


def flag_features(df: DataFrame, columns=("isVip", "bySelf", "isAccess3D", "pricingInfo_isAccessTP")) -> DataFrame:
    """C3 (simple form): ``<col>_flag`` = boolean filled with false, as int."""
    cols = {f"{c}_flag": flag(col(c).cast("boolean")) for c in columns if c in df.columns}
    return df.withColumns(cols) if cols else df


def policy_features(df: DataFrame) -> DataFrame:
    """Travel-policy compliance, corporate tariff, passenger count."""
    cols = {}
    if "pricingInfo_isAccessTP" in df.columns:
        cols["policy_compliant"] = flag(col("pricingInfo_isAccessTP").cast("boolean"))
    if "corporateTariffCode" in df.columns:
        cols["has_corporate_tariff"] = col("corporateTariffCode").isNotNull().cast("int")
    if "pricingInfo_passengerCount" in df.columns:
        n = col("pricingInfo_passengerCount")
        cols["is_single_passenger"] = flag(n == 1)
        cols["is_group_booking"] = flag(n > 1)
    return df.withColumns(cols) if cols else df


def route_extra_features(df: DataFrame) -> DataFrame:
    """Distinct airports (airport codes only, nulls skipped), total
    flight duration (tolerant parse, missing -> 0), aircraft consistency."""
    cols = {}
    ap = [c for c in df.columns if ("departureFrom" in c or "arrivalTo" in c)
          and c.endswith("airport_iata")]
    if ap:
        cols["unique_airports"] = row_nunique(ap)
    dur = [c for c in df.columns if c.startswith("legs") and c.endswith("_duration") and "segments" not in c]
    if dur:
        cols["total_flight_duration"] = row_sum([numeric_or_zero(c) for c in dur])
    ac = cols_with(df, "aircraft_code")
    if len(ac) > 1:
        cols["aircraft_consistency"] = all_equal_first(ac)
    return df.withColumns(cols) if cols else df


def efficiency_features(df: DataFrame) -> DataFrame:
    """Price per unit of first-leg duration."""
    if "totalPrice" not in df.columns or "legs0_duration" not in df.columns:
        return df
    return df.withColumn("duration_efficiency", eps_div(col("totalPrice"), col("legs0_duration")))


def domestic_features(df: DataFrame, airport_country: DataFrame | None) -> DataFrame:
    """1 when the first departure and the last arrival of leg 0 are both
    airports in the traveller's country. ``airport_country(iata, country)`` is
    a caller-supplied dimension; the planner, which knows its bytes, picks the join."""
    dep = seg_col(0, 0, "departureFrom_airport_iata")
    arrs = seg_cols(df, "arrivalTo_airport_iata", legs=(0,))
    if airport_country is None or "nationality" not in df.columns or dep not in df.columns or not arrs:
        return df.withColumn("domestic_flight", lit(0))
    last_arr = F.coalesce(*[col(c) for c in reversed(arrs)])
    dim = airport_country.select(col("iata").alias("_iata"), col("country").alias("_country"))
    d1 = dim.select(col("_iata").alias("_dep_iata"), col("_country").alias("_dep_country"))
    d2 = dim.select(col("_iata").alias("_arr_iata"), col("_country").alias("_arr_country"))
    out = (df.withColumn("_last_arr", last_arr)
             .join(d1, col(dep) == col("_dep_iata"), "left")
             .join(d2, col("_last_arr") == col("_arr_iata"), "left"))
    nat = col("nationality")
    return (out.withColumn("domestic_flight",
                           flag((col("_dep_country") == nat) & (col("_arr_country") == nat)))
               .drop("_last_arr", "_dep_iata", "_dep_country", "_arr_iata", "_arr_country"))


# ---------------------------------------------------------------- E22 composer

def family_pipeline(form: str = "full") -> list[Callable[[DataFrame], DataFrame]]:
    """The families of one feature set, in the reference's order."""
    if form == "simple":
        return [lambda d: price_features(d, "simple"), flag_features,
                lambda d: request_time_features(d, "simple"),
                lambda d: search_route_features(d, "simple"),
                lambda d: carrier_features(d, "simple")]
    if form == "opt":
        return [lambda d: request_time_features(d, "opt"), leg_time_features, segment_features,
                layover_features, lambda d: price_features(d, "opt"), policy_features,
                penalty_features, ff_match_features, lambda d: carrier_features(d, "opt"),
                user_features, cabin_features, seat_features, baggage_features,
                lambda d: search_route_features(d, "full"), route_extra_features]
    return [request_time_features, leg_time_features, booking_lead_features, segment_features,
            layover_features, search_route_features, price_features, penalty_features,
            carrier_features, ff_match_features, codeshare_features, cabin_features,
            seat_features, baggage_features, user_features, policy_features,
            route_extra_features, efficiency_features]


class _ColumnCollector:
    """Stand-in for the input DataFrame while the families of one feature set
    are planned: families read ``columns`` / ``schema`` and call
    ``withColumns``; the collector only records the expressions, so the whole
    set is applied as ONE projection (one analysis, one schema) instead of a
    new DataFrame per family."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema
        self.columns = list(df.columns)
        self.cols: dict[str, Column] = {}

    def withColumns(self, cols: dict) -> "_ColumnCollector":
        self.cols.update(cols)
        return self

    def withColumn(self, name: str, c: Column) -> "_ColumnCollector":
        self.cols[name] = c
        return self


_FAMILY_CACHE: dict = {}


def engineer_features(df: DataFrame, form: str = "full",
                      extra: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Every family of ``form`` in one projection (plus P3u user-added
    functions, applied afterwards with ``DataFrame.transform``). Row-wise
    only: no shuffle. Session aggregates (``operators.session``), price tiers
    and encoders are separate because they are per-session or fitted.

    The expressions depend only on the input schema and are unresolved
    (by column name), so the set built for one schema is reused for the next
    DataFrame with the same schema instead of being rebuilt from Python."""
    from pyspark import SparkContext
    collector = _ColumnCollector(df)
    key = (id(SparkContext._active_spark_context), form,
           tuple((f.name, f.dataType.simpleString()) for f in collector.schema.fields))
    cols = _FAMILY_CACHE.get(key)
    if cols is None:
        for fn in family_pipeline(form):
            fn(collector)
        cols = collector.cols
        if len(_FAMILY_CACHE) > 64:
            _FAMILY_CACHE.clear()
        _FAMILY_CACHE[key] = cols
    out = df.withColumns(cols) if cols else df
    for fn in extra or []:
        out = out.transform(fn)
    return out
