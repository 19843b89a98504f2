"""DuckDB expressions for the feature families, over the ``options`` CTE.

Each family returns ``[(name, sql, is_double)]``; the query modules wrap
double outputs in ``round(.., 6)`` as the Spark side does.
"""

from __future__ import annotations

from ..sources.views import MAX_LEGS, MAX_SEGMENTS, RULE_COLUMNS, SEGMENT_ATTRS, ARRIVAL_ATTR

LEGS = range(MAX_LEGS)
SEGS = range(MAX_SEGMENTS)


def sc(L, S, a):
    return f"legs{L}_segments{S}_{a}"


def seg_list(a, legs=LEGS):
    return [sc(L, S, a) for L in legs for S in SEGS]


def flag(cond):
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def i(x):
    return f"CAST({x} AS INTEGER)"


def row_sum(cs):
    return " + ".join(f"coalesce({c}, 0)" for c in cs)


def row_count(cs):
    return " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cs)


def row_nunique(cs):
    return f"CAST(len(list_distinct([{', '.join(cs)}])) AS INTEGER)"


def any_eq(cs, v):
    return f"greatest({', '.join(flag(f'{c} = {v}') for c in cs)})"


def all_equal_first(cs):
    first = cs[0]
    return flag(" AND ".join(f"({c} IS NULL OR coalesce({c} = {first}, false))" for c in cs[1:]))


def safe_div(n, d):
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE {n} / {d} END"


def hour_flags(h, p):
    return [(f"{p}_is_early_morning", flag(f"{h} <= 6"), False),
            (f"{p}_is_morning", flag(f"{h} > 6 AND {h} <= 12"), False),
            (f"{p}_is_afternoon", flag(f"{h} > 12 AND {h} <= 18"), False),
            (f"{p}_is_evening", flag(f"{h} > 18 AND {h} <= 22"), False),
            (f"{p}_is_late_night", flag(f"{h} > 22"), False),
            (f"{p}_is_red_eye", flag(f"{h} >= 22 OR {h} <= 6"), False),
            (f"{p}_is_business_hours", flag(f"{h} >= 8 AND {h} <= 18"), False),
            (f"{p}_is_early_flight", flag(f"{h} <= 6"), False),
            (f"{p}_is_late_flight", flag(f"{h} >= 22"), False)]


def request_time():
    h, d = "hour(requestDate)", "(isodow(requestDate) - 1)"
    return [("request_hour", i(h), False), ("request_day_of_week", i(d), False),
            ("request_month", i("month(requestDate)"), False),
            ("request_day_of_year", i("dayofyear(requestDate)"), False),
            ("request_is_weekend", flag(f"{d} >= 5"), False),
            ("request_is_business_hours", flag(f"{h} >= 9 AND {h} <= 17"), False),
            ("request_is_morning", flag(f"{h} < 12"), False),
            ("request_is_evening", flag(f"{h} >= 18"), False)]


def leg_time():
    out = []
    for L in LEGS:
        t = f"legs{L}_departureAt"
        h, d = f"hour({t})", f"(isodow({t}) - 1)"
        out += [(f"leg{L}_departure_hour", i(h), False), (f"leg{L}_departure_day_of_week", i(d), False),
                (f"leg{L}_departure_month", i(f"month({t})"), False)]
        out += hour_flags(h, f"leg{L}")
        out.append((f"leg{L}_is_weekend", flag(f"{d} >= 5"), False))
        a = f"legs{L}_arrivalAt"
        out += [(f"leg{L}_arrival_hour", i(f"hour({a})"), False),
                (f"leg{L}_arrival_day_of_week", i(f"(isodow({a}) - 1)"), False)]
    return out


def booking_lead():
    secs = "date_diff('second', requestDate, legs0_departureAt)"
    days = f"CAST(floor({secs} / 86400) AS INTEGER)"
    return [("days_to_departure", days, False),
            ("hours_to_departure", f"{secs} / CAST(3600.0 AS DOUBLE)", True),
            ("is_last_minute", flag(f"{days} <= 1"), False),
            ("is_advance_booking", flag(f"{days} >= 14"), False)]


def segments():
    out = []
    per = {}
    for L in LEGS:
        for S in SEGS:
            out.append((f"leg{L}_has_segment{S}", f"CAST({sc(L, S, 'duration')} IS NOT NULL AS INTEGER)", False))
        per[L] = f"({row_count([sc(L, S, 'duration') for S in SEGS])})"
        out.append((f"total_segments_leg{L}", per[L], False))
    tot = f"({per[0]} + {per[1]})"
    out += [("total_segments", tot, False),
            ("has_connections_leg0", flag(f"{per[0]} > 1"), False),
            ("has_connections_leg1", flag(f"{per[1]} > 1"), False),
            ("has_any_connections", flag(f"{per[0]} > 1 OR {per[1]} > 1"), False),
            ("has_connections_total", flag(f"{tot} > 1"), False),
            ("is_round_trip", flag(f"{per[1]} > 0"), False),
            ("is_complex_route", flag(f"{tot} > 2"), False),
            ("max_segments_per_leg", f"greatest({per[0]}, {per[1]})", False)]
    return out


def layover():
    out = []
    for L in LEGS:
        x = f"(CAST(legs{L}_duration AS DOUBLE) - ({row_sum([sc(L, S, 'duration') for S in SEGS])}))"
        lay = f"(CASE WHEN {x} IS NULL THEN NULL ELSE greatest({x}, 0.0) END)"
        out += [(f"leg{L}_layover_time", lay, True), (f"leg{L}_short_layover", flag(f"{lay} < 1"), False),
                (f"leg{L}_medium_layover", flag(f"{lay} >= 1 AND {lay} < 4"), False),
                (f"leg{L}_long_layover", flag(f"{lay} >= 4"), False)]
    return out


def search_route():
    s = flag("contains(searchRoute, '/')")
    return [("route_contains_slash", s, False), ("is_round_trip_search", s, False),
            ("route_length", i("length(searchRoute)"), False)]


def price():
    dur = "(coalesce(legs0_duration, 0.0) + coalesce(legs1_duration, 0.0))"
    ratio = safe_div("taxes", "totalPrice")
    return [("price_per_hour", safe_div("totalPrice", dur), True), ("tax_ratio", ratio, True),
            ("base_price", "totalPrice - coalesce(taxes, 0.0)", True),
            ("has_high_taxes", flag(f"({ratio}) > 0.2"), False),
            ("price_log", "ln(1 + coalesce(totalPrice, 0.0))", True)]


def penalties():
    out = []
    for r, name in ((0, "cancel"), (1, "exchange")):
        tot = f"CAST({row_sum([f'miniRules{r}_monetaryAmount'])} AS DOUBLE)"
        out += [(f"total_{name}_penalty", tot, True), (f"has_{name}_penalty", flag(f"{tot} > 0"), False),
                (f"{name}_penalty_ratio", f"{tot} / (totalPrice + 1e-6)", True),
                (f"total_{name}_penalty_pct", f"CAST({row_sum([f'miniRules{r}_percentage'])} AS DOUBLE)", True)]
    return out


def carriers():
    mk = seg_list("marketingCarrier_code")
    n = row_nunique(mk)
    return [("main_carrier", mk[0], False), ("carrier_consistency", flag(f"{n} = 1"), False),
            ("multi_carrier_flight", flag(f"{n} > 1"), False)]


def ff_match():
    return [("ff_carrier_match", any_eq(seg_list("marketingCarrier_code"), "frequentFlyer"), False)]


def codeshare():
    out, k = [], 0
    for L in LEGS:
        for S in SEGS:
            m, o = sc(L, S, "marketingCarrier_code"), sc(L, S, "operatingCarrier_code")
            out.append((f"seg{k}_codeshare", f"CAST(NOT coalesce({m} = {o}, false) AS INTEGER)", False))
            k += 1
    return out


def cabin():
    cc = seg_list("cabinClass")
    best, worst = f"greatest({', '.join(cc)})", f"least({', '.join(cc)})"
    cons = flag(f"{best} = {worst}")
    out = [("best_cabin_class", best, True), ("worst_cabin_class", worst, True),
           ("cabin_class_consistency", cons, False),
           ("has_economy", any_eq(cc, "1.0"), False), ("has_comfort", any_eq(cc, "2.0"), False),
           ("has_business", any_eq(cc, "3.0"), False), ("has_first", any_eq(cc, "4.0"), False),
           ("is_all_economy", flag(f"{best} = 1.0"), False),
           ("is_all_business_or_higher", flag(f"{worst} >= 3.0"), False),
           ("has_mixed_classes", f"1 - {cons}", False)]
    for L in LEGS:
        for S in SEGS:
            c = sc(L, S, "cabinClass")
            out += [(f"leg{L}_seg{S}_is_economy", flag(f"{c} = 1.0"), False),
                    (f"leg{L}_seg{S}_is_business", flag(f"{c} = 3.0"), False),
                    (f"leg{L}_seg{S}_is_first", flag(f"{c} = 4.0"), False)]
    return out


def seats():
    s = seg_list("seatsAvailable")
    mn = f"least({', '.join(s)})"
    n = f"({row_count(s)})"
    return [("min_seats_available", mn, False), ("max_seats_available", f"greatest({', '.join(s)})", False),
            ("total_seats_available", f"({row_sum(s)})", False),
            ("avg_seats_available", f"CASE WHEN {n} > 0 THEN CAST({row_sum(s)} AS DOUBLE) / {n} END", True),
            ("very_limited_seats", flag(f"{mn} <= 2"), False),
            ("limited_seats", flag(f"{mn} > 2 AND {mn} <= 5"), False),
            ("good_availability", flag(f"{mn} > 5"), False)]


def baggage():
    b = seg_list("baggageAllowance_quantity")
    mn, mx = f"least({', '.join(b)})", f"greatest({', '.join(b)})"
    return [("min_baggage_allowance", mn, False), ("max_baggage_allowance", mx, False),
            ("total_baggage_allowance", f"({row_sum(b)})", False),
            ("baggage_consistency", flag(f"{mn} = {mx}"), False)]


def user():
    return [("isVip", flag("isVip"), False), ("bySelf", flag("bySelf"), False),
            ("isAccess3D", flag("isAccess3D"), False),
            ("vip_independent", flag("isVip AND bySelf"), False),
            ("vip_managed", flag("isVip AND NOT coalesce(bySelf, false)"), False)]


def policy():
    return [("policy_compliant", flag("pricingInfo_isAccessTP"), False),
            ("has_corporate_tariff", "CAST(corporateTariffCode IS NOT NULL AS INTEGER)", False),
            ("is_single_passenger", flag("pricingInfo_passengerCount = 1"), False),
            ("is_group_booking", flag("pricingInfo_passengerCount > 1"), False)]


def route_extras():
    ap = []
    for L in LEGS:
        for S in SEGS:
            ap += [sc(L, S, "departureFrom_airport_iata"), sc(L, S, ARRIVAL_ATTR)]
    dur = [f"legs{L}_duration" for L in LEGS]
    return [("unique_airports", row_nunique(ap), False),
            ("total_flight_duration", " + ".join(f"coalesce(TRY_CAST({d} AS DOUBLE), 0.0)" for d in dur), True),
            ("aircraft_consistency", all_equal_first(seg_list("aircraft_code")), False)]


def efficiency():
    return [("duration_efficiency", "totalPrice / (legs0_duration + 1e-6)", True)]


FULL_FAMILIES = [request_time, leg_time, booking_lead, segments, layover, search_route, price,
                 penalties, carriers, ff_match, codeshare, cabin, seats, baggage, user, policy,
                 route_extras, efficiency]


def session_items():
    avg_rank = lambda v: (f"CASE WHEN {v} IS NOT NULL THEN rank() OVER (PARTITION BY ranker_id ORDER BY {v} ASC NULLS LAST)"  # noqa: E731
                          f" + (count(*) OVER (PARTITION BY ranker_id, {v}) - 1) / 2.0 END")
    w = "OVER (PARTITION BY ranker_id)"
    mean = f"coalesce(avg(totalPrice) {w}, 0.0)"
    pr = avg_rank("totalPrice")
    return [("session_totalPrice_min", f"coalesce(min(totalPrice) {w}, 0.0)", True),
            ("session_totalPrice_max", f"coalesce(max(totalPrice) {w}, 0.0)", True),
            ("session_totalPrice_mean", mean, True),
            ("session_totalPrice_std", f"coalesce(stddev_samp(totalPrice) {w}, 0.0)", True),
            ("session_legs0_duration_min", f"coalesce(min(legs0_duration) {w}, 0.0)", True),
            ("session_legs0_duration_max", f"coalesce(max(legs0_duration) {w}, 0.0)", True),
            ("session_legs0_duration_mean", f"coalesce(avg(legs0_duration) {w}, 0.0)", True),
            ("price_rank_in_session", pr, True),
            ("duration_rank_in_session", avg_rank("legs0_duration"), True),
            ("price_vs_session_avg", f"totalPrice - {mean}", True),
            ("price_ratio_vs_session_avg", safe_div("totalPrice", mean), True),
            ("is_cheapest_in_session", flag(f"({pr}) = 1"), False),
            ("is_most_expensive_in_session", flag(f"({pr}) = count(*) {w}"), False)]


def render(items, rnd: bool = True) -> str:
    return ",\n  ".join(f"round({sql}, 6) AS {name}" if (dbl and rnd) else f"{sql} AS {name}"
                        for name, sql, dbl in items)


def base_doubles() -> list[str]:
    """Double columns of the options view (rounded the same way in Spark)."""
    out = ["totalPrice", "taxes"] + [f"legs{L}_duration" for L in LEGS]
    for L in LEGS:
        for S in SEGS:
            out += [sc(L, S, "duration"), sc(L, S, "cabinClass")]
    return out + RULE_COLUMNS


_ = SEGMENT_ATTRS
