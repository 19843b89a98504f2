"""Queries for the feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as E
from ..operators import session as S
from ..operators.split import group_split
from ..sources.tables import load_table
from ..sources.views import options_view
from . import feature_sql as Q
from .oracle import with_options
from .q_session import rounded
from .registry import query

FAMILIES = {
    "feat_request_time": (E.request_time_features, Q.request_time),
    "feat_leg_time": (E.leg_time_features, Q.leg_time),
    "feat_booking_lead": (E.booking_lead_features, Q.booking_lead),
    "feat_segments": (E.segment_features, Q.segments),
    "feat_layover": (E.layover_features, Q.layover),
    "feat_search_route": (E.search_route_features, Q.search_route),
    "feat_route_extras": (E.route_extra_features, Q.route_extras),
    "feat_price": (E.price_features, Q.price),
    "feat_penalties": (E.penalty_features, Q.penalties),
    "feat_efficiency": (E.efficiency_features, Q.efficiency),
    "feat_carriers": (E.carrier_features, Q.carriers),
    "feat_ff_match": (E.ff_match_features, Q.ff_match),
    "feat_codeshare": (E.codeshare_features, Q.codeshare),
    "feat_cabin": (E.cabin_features, Q.cabin),
    "feat_seats": (E.seat_features, Q.seats),
    "feat_baggage": (E.baggage_features, Q.baggage),
    "feat_user": (E.user_features, Q.user),
    "feat_policy": (E.policy_features, Q.policy),
    "feat_session": (S.add_session_features, Q.session_items),
}


def _family_query(key, fn, sql_items):
    names = [n for n, _, _ in sql_items()]

    def build(spark, sf_dir):
        return rounded(fn(options_view(spark, sf_dir)).select("Id", *names))
    build.__name__ = f"q_{key}"
    build.__doc__ = (fn.__doc__ or "").strip().split("\n")[0]
    query(key, with_options(f"SELECT Id,\n  {Q.render(sql_items())}\nFROM options"))(build)


for _k, (_fn, _sql) in FAMILIES.items():
    _family_query(_k, _fn, _sql)


HASH_TRAIN = ("CAST(('0x' || substr(md5('42_' || CAST(ranker_id AS VARCHAR)), 1, 8)) AS BIGINT)"
              " / CAST(4294967296 AS DOUBLE) < 0.7")


@query("feat_price_tiers", with_options(f"""
, th AS (SELECT quantile_cont(totalPrice, 0.25) AS q25, quantile_cont(totalPrice, 0.75) AS q75,
                quantile_cont(totalPrice, 0.9) AS q90 FROM options WHERE {HASH_TRAIN})
SELECT Id, totalPrice,
  CAST(coalesce(totalPrice < q25, false) AS INTEGER) AS is_budget_flight,
  CAST(coalesce(totalPrice > q75, false) AS INTEGER) AS is_premium_flight,
  CAST(coalesce(totalPrice > q90, false) AS INTEGER) AS is_luxury_flight
FROM options, th"""))
def q_price_tiers(spark, sf_dir):
    """Quantile tiers fitted on the train sessions, applied to all rows."""
    o = options_view(spark, sf_dir, materialize=True, columns=["Id", "ranker_id", "totalPrice"])
    train, _ = group_split(o)
    tiers = E.PriceTiers().fit(train)
    return tiers.transform(o.select("Id", "totalPrice"))


@query("feat_domestic", with_options("""
SELECT o.Id, CAST(coalesce(d1.country = o.nationality AND d2.country = o.nationality, false) AS INTEGER)
       AS domestic_flight
FROM options o
LEFT JOIN (SELECT n_name AS iata, n_name AS country FROM nation) d1
  ON o.legs0_segments0_departureFrom_airport_iata = d1.iata
LEFT JOIN (SELECT n_name AS iata, n_name AS country FROM nation) d2
  ON coalesce(o.legs0_segments3_arrivalTo_airport_iata, o.legs0_segments2_arrivalTo_airport_iata,
              o.legs0_segments1_arrivalTo_airport_iata, o.legs0_segments0_arrivalTo_airport_iata) = d2.iata"""))
def q_domestic(spark, sf_dir):
    """Domestic flag via an airport -> country dimension (here: nations)."""
    o = options_view(spark, sf_dir)
    n = load_table(spark, sf_dir, "nation")
    dim = n.select(F.col("n_name").alias("iata"), F.col("n_name").alias("country"))
    return E.domestic_features(o, dim).select("Id", "domestic_flight")


def _all_sql() -> str:
    user = [it for it in Q.user() if it[0] in ("isVip", "bySelf", "isAccess3D")]
    user_names = {n for n, _, _ in user}
    replace = [f"{sql} AS {name}" for name, sql, _ in user] + \
              [f"round({c}, 6) AS {c}" for c in Q.base_doubles()]
    items = [it for fam in Q.FULL_FAMILIES for it in fam() if it[0] not in user_names] + Q.session_items()
    return with_options(f"SELECT * REPLACE ({', '.join(replace)}),\n  {Q.render(items)}\nFROM options")


@query("feat_all", _all_sql())
def q_feat_all(spark, sf_dir):
    """Every full-form family plus the session family, one Exchange on the
    session key, of options whose lines are not yet columns. The row-wise families
    follow the windows, so these do not sort what they do not read."""
    o = options_view(spark, sf_dir, by_session=True)
    session = [n for n, _, _ in Q.session_items()]
    x = E.engineer_features(S.add_session_features(o), "full")
    return rounded(x.select(*[c for c in x.columns if c not in session], *session))


@query("feat_session_skew_safe", with_options(f"SELECT Id,\n  {Q.render(Q.session_items())}\nFROM options"))
def q_feat_session_skew_safe(spark, sf_dir):
    """G1 + H1 + H4-H6 without session windows (narrow aggregates, count-based
    ranks, join back on Id): same values as ``feat_session``."""
    names = [n for n, _, _ in Q.session_items()]
    o = options_view(spark, sf_dir, materialize=True)
    return rounded(S.add_session_features_skew_safe(o).select("Id", *names))
