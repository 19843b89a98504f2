"""DuckDB twins of the Spark session tables, used by the SQL oracle.

The CTE text is generated from the same slot and attribute definitions as
``rankflow.sources.views`` so the two cannot drift apart.
"""

from __future__ import annotations

from ..sources.views import (ARRIVAL_ATTR, MAX_LEGS, MAX_SEGMENTS, PARTS, RULE_COLUMNS,
                             SEGMENT_ATTRS, SEGMENT_ORDER)


def options_ctes(max_legs: int = MAX_LEGS, max_segments: int = MAX_SEGMENTS) -> str:
    nslots = max_legs * max_segments
    wide = []
    for L in range(max_legs):
        for S in range(max_segments):
            k = L * max_segments + S
            p = f"legs{L}_segments{S}_"
            wide += [f"max(CASE WHEN pos = {k} THEN {sql} END) AS {p}{name}"
                     for name, _, sql in SEGMENT_ATTRS]
            wide.append(f"max(CASE WHEN pos = {k} THEN 1 END) AS _has_{L}_{S}")
        inleg = f"pos >= {L * max_segments} AND pos < {(L + 1) * max_segments}"
        wide += [f"min(CASE WHEN {inleg} THEN l_shipdate END) AS legs{L}_departureAt",
                 f"max(CASE WHEN {inleg} THEN l_shipdate END) AS legs{L}_arrivalAt",
                 f"sum(CASE WHEN {inleg} THEN l_quantity END) AS _dursum_{L}"]
    sel = [
        f"o.o_orderkey * {PARTS} + coalesce(w.part, 0) AS Id", "o.o_custkey AS ranker_id", "o.o_custkey AS profileId",
        "c.c_nationkey AS companyID", "n.n_name AS nationality",
        "c.c_acctbal > 8000 AS isVip", "o.o_orderkey % 10 < 7 AS bySelf",
        "nullif(o.o_orderstatus, 'P') = 'F' AS isAccess3D",
        "n.n_name || CASE WHEN o.o_orderkey % 2 = 0 THEN '/' || r.r_name ELSE '' END AS searchRoute",
        "o.o_orderdate AS requestDate", "o.o_totalprice AS totalPrice", "m.taxes",
        "nullif(c.c_mktsegment, 'MACHINERY') AS corporateTariffCode",
        "'Brand#' || CAST(o.o_custkey % 25 + 1 AS VARCHAR) AS frequentFlyer",
        "o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS pricingInfo_isAccessTP",
        "CAST(1 + o.o_orderkey % 3 AS INTEGER) AS pricingInfo_passengerCount",
    ]
    for L in range(max_legs):
        sel += [f"w.legs{L}_departureAt", f"w.legs{L}_arrivalAt",
                f"CAST(w._dursum_{L} + o.o_orderkey % 6 AS DOUBLE) AS legs{L}_duration"]
    for L in range(max_legs):
        for S in range(max_segments):
            p = f"legs{L}_segments{S}_"
            sel.append(f"w.{p}{SEGMENT_ATTRS[0][0]}")
            sel.append(f"CASE WHEN w._has_{L}_{S} = 1 THEN n.n_name END AS {p}{ARRIVAL_ATTR}")
            sel += [f"w.{p}{name}" for name, _, _ in SEGMENT_ATTRS[1:]]
    sel += [f"m.{c}" for c in RULE_COLUMNS]
    sel.append("CAST(o.o_orderkey = f.first_orderkey AND coalesce(w.part, 0) = 0 AS INTEGER) AS selected")
    order = ", ".join(SEGMENT_ORDER)
    return f"""
_li_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS rn FROM lineitem
),
_seg AS (
  SELECT l.*, (l.rn - 1) % {nslots} AS pos, (l.rn - 1) // {nslots} AS part, p.p_brand, p.p_type, sn.n_name AS s_nation
  FROM _li_ranked l
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey
),
_wide AS (
  SELECT l_orderkey, part, {", ".join(wide)} FROM _seg GROUP BY l_orderkey, part
),
_money AS (
  SELECT l_orderkey, part,
    round(sum(l_extendedprice * l_tax), 4) AS taxes,
    round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount END), 4) AS miniRules0_monetaryAmount,
    max(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS miniRules0_percentage,
    round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * l_discount END), 4) AS miniRules1_monetaryAmount,
    max(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS miniRules1_percentage
  FROM _seg GROUP BY l_orderkey, part
),
_firsts AS (
  SELECT o_custkey AS f_custkey, o_orderkey AS first_orderkey FROM (
    SELECT o_custkey, o_orderkey, row_number() OVER (
      PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn
    FROM orders) WHERE rn = 1
),
options AS (
  SELECT {", ".join(sel)}
  FROM orders o
  LEFT JOIN _wide w ON o.o_orderkey = w.l_orderkey
  LEFT JOIN _money m ON m.l_orderkey = w.l_orderkey AND m.part = w.part
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN _firsts f ON o.o_custkey = f.f_custkey
)"""


EVENTS_CTE = """
_efirst AS (
  SELECT user_id AS f_user, event_id AS first_id FROM (
    SELECT user_id, event_id, row_number() OVER (
      PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn
    FROM events) WHERE rn = 1
),
ev AS (
  SELECT e.event_id AS Id, e.user_id AS ranker_id, e.ts, e.event_type, e.value AS score, e.props,
         CAST(e.event_id = f.first_id AS INTEGER) AS selected
  FROM events e LEFT JOIN _efirst f ON e.user_id = f.f_user
)"""


def with_options(body: str, extra_ctes: str = "") -> str:
    """``WITH <options view>[, extra] <body>``."""
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {options_ctes()}{extra}\n{body}"


def with_events(body: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {EVENTS_CTE}{extra}\n{body}"
