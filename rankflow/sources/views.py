"""Session tables derived from the driver tables.

The driver supplies no flight data, so the option table is derived from the
star schema: session = customer, segment = line item, option = ``max_legs`` x
``max_segments`` lines of an order in ``SEGMENT_ORDER``. An order with more
lines gives several options, so every line is a segment of exactly one option.
The mapping is ours; the DuckDB twin lives in ``rankflow.plans.oracle`` and is
generated from the same definitions below.

Plan shape (what makes it hold at scale):
* lines are shuffled by part, whose attributes they take along, and once by
  order: the window that numbers an order's lines, the money sums, the wide
  pivot of each option and the join with its order share that exchange;
* orders take their customer's attributes along before they meet the options, so
  no wide row is shuffled;
* the label ("first order of the customer by md5") is a partial ``min`` per
  customer joined back, not a window over the whole session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load_table
from ..functions.exprs import sql_round

MAX_LEGS = 2
MAX_SEGMENTS = 4
PARTS = 1 << 20      # Id = order * PARTS + number of the option within the order
SESSION_ROWS = 50_000    # options that are sorted by session in one task, about: as columns they take some 100 MB
SEGMENT_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]

# Segment attributes: (output suffix, Spark expression over the joined line,
# DuckDB expression over the same line). Arrival airport is the customer's
# nation and is filled after the customer join.
SEGMENT_ATTRS = [
    ("departureFrom_airport_iata", lambda: F.col("s_nation"), "s_nation"),
    ("marketingCarrier_code", lambda: F.col("p_brand"), "p_brand"),
    ("operatingCarrier_code",
     lambda: F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")),
     "'Brand#' || CAST(l_suppkey % 25 + 1 AS VARCHAR)"),
    ("duration", lambda: F.col("l_quantity").cast("double"), "CAST(l_quantity AS DOUBLE)"),
    ("aircraft_code", lambda: F.col("p_type"), "p_type"),
    ("cabinClass", lambda: (F.lit(1) + F.col("l_partkey") % 4).cast("double"),
     "CAST(1 + l_partkey % 4 AS DOUBLE)"),
    ("seatsAvailable", lambda: (F.col("l_suppkey") % 10).cast("int"),
     "CAST(l_suppkey % 10 AS INTEGER)"),
    ("baggageAllowance_quantity", lambda: (F.col("l_linenumber") % 3).cast("int"),
     "CAST(l_linenumber % 3 AS INTEGER)"),
]
ARRIVAL_ATTR = "arrivalTo_airport_iata"
PART_ATTRS = {"marketingCarrier_code": "p_brand", "aircraft_code": "p_type"}


def segment_columns(max_legs: int = MAX_LEGS, max_segments: int = MAX_SEGMENTS) -> list[str]:
    out = []
    for L in range(max_legs):
        for S in range(max_segments):
            p = f"legs{L}_segments{S}_"
            out += [p + a[0] for a in SEGMENT_ATTRS[:1]] + [p + ARRIVAL_ATTR] + \
                   [p + a[0] for a in SEGMENT_ATTRS[1:]]
    return out


def leg_columns(max_legs: int = MAX_LEGS) -> list[str]:
    return [f"legs{L}_{c}" for L in range(max_legs) for c in ("departureAt", "arrivalAt", "duration")]


SESSION_COLUMNS = ["Id", "ranker_id", "profileId", "companyID", "nationality",
                   "isVip", "bySelf", "isAccess3D", "searchRoute", "requestDate",
                   "totalPrice", "taxes", "corporateTariffCode", "frequentFlyer",
                   "pricingInfo_isAccessTP", "pricingInfo_passengerCount"]
RULE_COLUMNS = ["miniRules0_monetaryAmount", "miniRules0_percentage",
                "miniRules1_monetaryAmount", "miniRules1_percentage"]


def option_columns(max_legs: int = MAX_LEGS, max_segments: int = MAX_SEGMENTS) -> list[str]:
    return SESSION_COLUMNS + leg_columns(max_legs) + segment_columns(max_legs, max_segments) \
        + RULE_COLUMNS + ["selected"]


def _no_repeats(table: DataFrame, key: str) -> bool:
    return table.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty()


def options_view(spark: SparkSession, sf_dir: str, max_legs: int = MAX_LEGS,
                 max_segments: int = MAX_SEGMENTS, materialize: bool = False, columns: list[str] | None = None,
                 by_session: bool = False) -> DataFrame:
    """The wide option table. ``materialize`` writes it once for callers that
    run several jobs over it. ``by_session`` deals it by session, for callers that
    group by it, before an option's lines become columns. With ``columns`` it has only these, and lines take
    along only what they are made of; a part or supplier key that repeats orders
    an option's lines by all their attributes, so then all are kept until the end."""
    if materialize:
        from ..session import materialize as _m
        return _m(options_view(spark, sf_dir, max_legs, max_segments, columns=columns, by_session=by_session), "options")
    t = lambda n: load_table(spark, sf_dir, n)
    nslots = max_legs * max_segments
    exprs = dict(zip(option_columns(max_legs, max_segments), option_select_exprs(max_legs, max_segments)))
    narrow = columns is not None and _no_repeats(t("part"), "p_partkey") and _no_repeats(t("supplier"), "s_suppkey")
    if narrow:
        used = "\n".join(exprs[c] for c in columns)
        slots = [k for k in range(nslots) if f"get(_segs, {k})" in used]
        attrs = [a for a in SEGMENT_ATTRS if f").{a[0]} " in used]
    else:
        used, slots, attrs = "\n".join(exprs.values()), list(range(nslots)), SEGMENT_ATTRS
    # parts of one slot only are looked up by option, not by line
    part_slots = [k for k in slots if any(f"get(_segs, {k}).{a} " in used for a in PART_ATTRS)]
    by_option = narrow and len(part_slots) == 1
    if by_option:
        attrs = [a for a in attrs if a[0] not in PART_ATTRS]
        for a, source in PART_ATTRS.items():
            exprs = {c: e.replace(f"get(_segs, {part_slots[0]}).{a} ", f"{source} ") for c, e in exprs.items()}
    names = {a[0] for a in attrs}
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                              "l_returnflag", "l_shipdate")

    ep, disc, rf = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_returnflag")
    money = [
        sql_round(F.sum(ep * F.col("l_tax")), 4).alias("taxes"),
        sql_round(F.sum(F.when(rf == "R", ep * disc)), 4).alias("miniRules0_monetaryAmount"),
        F.max(F.when(rf == "R", disc)).alias("miniRules0_percentage"),
        sql_round(F.sum(F.when(rf == "A", ep * disc)), 4).alias("miniRules1_monetaryAmount"),
        F.max(F.when(rf == "A", disc)).alias("miniRules1_percentage"),
    ]

    # Parts and suppliers are joined before the lines are dealt by order, one row
    # per key and the others of a key that repeats as a list: lines are numbered
    # once each, and the other rows follow after that.
    def by_key(name: str, key: str, *cols: str) -> DataFrame:
        if narrow:
            return t(name).select(key, *cols)
        rows = t(name).groupBy(key).agg(F.collect_list(F.struct(*cols)).alias("r"))
        return rows.select(key, *[F.col("r")[0][c].alias(f"_{c}") for c in cols],
                           F.when(F.size("r") > 1, F.slice("r", 2, F.size("r"))).alias(f"_more_{name}"))

    def all_rows(df: DataFrame, name: str, *cols: str) -> DataFrame:
        if narrow:
            return df
        first_row = F.struct(*[F.col(f"_{c}").alias(c) for c in cols])
        return (df.select("*", F.inline(F.concat(F.array(first_row), F.coalesce(f"_more_{name}", F.array()))))
                .drop(f"_more_{name}", *[f"_{c}" for c in cols]))

    if not narrow or names & set(PART_ATTRS):
        part = by_key("part", "p_partkey", "p_brand", "p_type")
        li = li.join(part, li.l_partkey == part.p_partkey, "left").drop("p_partkey")
    if not narrow or "departureFrom_airport_iata" in names:
        sup = by_key("supplier", "s_suppkey", "s_nationkey")
        li = li.join(sup, li.l_suppkey == sup.s_suppkey, "left").drop("s_suppkey")
    w = Window.partitionBy("l_orderkey").orderBy(*SEGMENT_ORDER)
    rn0 = F.row_number().over(w) - 1
    top = li.withColumn("rn0", rn0).withColumns({"part": F.expr(f"rn0 div {nslots}"), "pos": F.col("rn0") % nslots})
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    top = all_rows(all_rows(top, "part", "p_brand", "p_type"), "supplier", "s_nationkey")
    seg = top
    if "s_nationkey" in top.columns:
        seg = top.join(F.broadcast(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation"))), "s_nationkey", "left")

    # Pivot: at most nslots lines per option, so one bounded array per option
    # (sorted by position) replaces dozens of conditional aggregates; slot k is
    # element k. Elements up to the last slot that is used are at positions up to it.
    line = F.struct(F.col("pos"), *[F.col(c) for c in ("l_shipdate", "l_quantity") if f").{c}" in used],
                    *([F.col("l_partkey")] if by_option else []),
                    *[fn().alias(name) for name, fn, _ in attrs])
    if narrow:
        line = F.when(F.col("pos") <= max(slots, default=-1), line)
    wide = seg.groupBy("l_orderkey", "part").agg(F.array_sort(F.collect_list(line)).alias("_segs"), *money)

    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                           "o_orderdate", "o_orderpriority")
    first = (o.groupBy("o_custkey")
              .agg(F.min(F.struct(F.md5(F.col("o_orderkey").cast("string")).alias("h"),
                                  F.col("o_orderkey").alias("k"))).alias("m"))
              .select(F.col("o_custkey").alias("f_custkey"), F.col("m.k").alias("first_orderkey")))
    cust = t("customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # orders meet their customers while they are narrow, then their options
    base = (o.join(cust, o.o_custkey == cust.c_custkey, "left").drop("c_custkey")
             .join(first, o.o_custkey == first.f_custkey, "left").drop("f_custkey")
             .join(wide, o.o_orderkey == wide.l_orderkey, "left").drop("l_orderkey")
             .withColumn("part", F.coalesce("part", F.lit(0))))
    if by_option:
        parts = t("part").select("p_partkey", *PART_ATTRS.values())
        base = base.join(parts, F.expr(f"get(_segs, {part_slots[0]}).l_partkey") == F.col("p_partkey"), "left")
    base = (base.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(F.broadcast(t("region").select("r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"), "left"))

    if by_session:
        parts = max(spark.sparkContext.defaultParallelism, -(-t("orders").count() // SESSION_ROWS))
        base = base.repartition(parts, "o_custkey")

    # One selectExpr: the ~110 output expressions are parsed on the JVM in a
    # single call instead of being assembled node by node from Python.
    return base.selectExpr(*[exprs[c] for c in columns or exprs])


def option_select_exprs(max_legs: int = MAX_LEGS, max_segments: int = MAX_SEGMENTS) -> list[str]:
    """Spark SQL expressions of the option table over the joined base."""
    sel = [
        f"o_orderkey * {PARTS}L + CASE WHEN part < {PARTS} THEN part ELSE"
        f" raise_error('an order has more than {PARTS} options: Id would repeat') END AS Id", "o_custkey AS ranker_id", "o_custkey AS profileId",
        "c_nationkey AS companyID", "n_name AS nationality",
        "c_acctbal > 8000 AS isVip", "o_orderkey % 10 < 7 AS bySelf",
        "nullif(o_orderstatus, 'P') = 'F' AS isAccess3D",
        "concat(n_name, CASE WHEN o_orderkey % 2 = 0 THEN concat('/', r_name) ELSE '' END) AS searchRoute",
        "o_orderdate AS requestDate", "o_totalprice AS totalPrice", "taxes",
        "nullif(c_mktsegment, 'MACHINERY') AS corporateTariffCode",
        "concat('Brand#', CAST(o_custkey % 25 + 1 AS STRING)) AS frequentFlyer",
        "o_orderpriority IN ('1-URGENT', '2-HIGH') AS pricingInfo_isAccessTP",
        "CAST(1 + o_orderkey % 3 AS INT) AS pricingInfo_passengerCount",
    ]
    slot = lambda L, S: f"get(_segs, {L * max_segments + S})"
    for L in range(max_legs):
        ships = ", ".join(f"{slot(L, S)}.l_shipdate" for S in range(max_segments))
        qty = " + ".join(f"coalesce({slot(L, S)}.l_quantity, 0.0)" for S in range(max_segments))
        sel += [f"least({ships}) AS legs{L}_departureAt", f"greatest({ships}) AS legs{L}_arrivalAt",
                f"CAST(CASE WHEN {slot(L, 0)} IS NOT NULL THEN {qty} + o_orderkey % 6 END AS DOUBLE)"
                f" AS legs{L}_duration"]
    for L in range(max_legs):
        for S in range(max_segments):
            p, s_ = f"legs{L}_segments{S}_", slot(L, S)
            sel.append(f"{s_}.{SEGMENT_ATTRS[0][0]} AS {p}{SEGMENT_ATTRS[0][0]}")
            sel.append(f"CASE WHEN {s_} IS NOT NULL THEN n_name END AS {p}{ARRIVAL_ATTR}")
            sel += [f"{s_}.{name} AS {p}{name}" for name, _, _ in SEGMENT_ATTRS[1:]]
    sel += RULE_COLUMNS
    sel.append("CAST(o_orderkey = first_orderkey AND part = 0 AS INT) AS selected")
    return sel



def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second session table with natural ties: session = user, row = event,
    score = value; label = the user's first event by md5 (one per session)."""
    e = load_table(spark, sf_dir, "events")
    first = (e.groupBy("user_id")
              .agg(F.min(F.struct(F.md5(F.col("event_id").cast("string")).alias("h"),
                                  F.col("event_id").alias("k"))).alias("m"))
              .select(F.col("user_id").alias("f_user"), F.col("m.k").alias("first_id")))
    return (e.join(first, e.user_id == first.f_user, "left")
             .select(F.col("event_id").alias("Id"), F.col("user_id").alias("ranker_id"),
                     "ts", "event_type", F.col("value").alias("score"), "props",
                     (F.col("event_id") == F.col("first_id")).cast("int").alias("selected")))


def option_types(max_legs: int = MAX_LEGS, max_segments: int = MAX_SEGMENTS) -> dict[str, str]:
    """Spark type names of the option table (kept static for the oracle)."""
    t = {"Id": "bigint", "ranker_id": "bigint", "profileId": "bigint", "companyID": "int",
         "nationality": "string", "isVip": "boolean", "bySelf": "boolean", "isAccess3D": "boolean",
         "searchRoute": "string", "requestDate": "timestamp_ntz", "totalPrice": "double",
         "taxes": "double", "corporateTariffCode": "string", "frequentFlyer": "string",
         "pricingInfo_isAccessTP": "boolean", "pricingInfo_passengerCount": "int"}
    seg = {"departureFrom_airport_iata": "string", ARRIVAL_ATTR: "string",
           "marketingCarrier_code": "string", "operatingCarrier_code": "string", "duration": "double",
           "aircraft_code": "string", "cabinClass": "double", "seatsAvailable": "int",
           "baggageAllowance_quantity": "int"}
    for c in leg_columns(max_legs):
        t[c] = "double" if c.endswith("duration") else "timestamp_ntz"
    for c in segment_columns(max_legs, max_segments):
        t[c] = seg[c.split("_", 2)[2]]
    for c in RULE_COLUMNS:
        t[c] = "double"
    t["selected"] = "int"
    return {c: t[c] for c in option_columns(max_legs, max_segments)}
