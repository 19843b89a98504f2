"""Queries for the encoders (J1-J6). Every encoder is fitted on the hash
train split and applied to all (or the test) rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.encode import (CardinalityEncoder, FrequencyEncoder, LabelEncoder, OrderedTargetEncoder,
                                TargetEncoder)
from ..operators.split import group_split
from ..sources.views import options_view
from .oracle import with_options
from .q_features import HASH_TRAIN
from .q_session import rounded
from .registry import query

LABEL_COLS = ["corporateTariffCode", "profileId", "companyID", "nationality", "primary_carrier"]
ROUTE_COLS = ["nationality", "searchRoute", "corporateTariffCode", "frequentFlyer",
              "legs0_segments0_aircraft_code"]
INTEGRAL = {"profileId", "companyID"}


CARRIER = "legs0_segments0_marketingCarrier_code"


def _options(spark, sf_dir, *columns):
    """These columns of the options and what rows are split by, stored once."""
    return options_view(spark, sf_dir, materialize=True, columns=list(dict.fromkeys(["Id", "ranker_id", *columns])))


def _with_primary(o):
    return o.withColumn("primary_carrier",
                        F.coalesce(F.col("legs0_segments0_marketingCarrier_code"), F.lit("missing")))


def _key(c, missing=True):
    """SQL key text of a category column (integral columns as decimal text);
    ``c`` may be qualified (``x.profileId``)."""
    k = f"CAST({c} AS VARCHAR)" if c.split(".")[-1] in INTEGRAL else c
    return f"coalesce({k}, 'missing')" if missing else k


def _dict_sql(cols, missing=True, src="tr"):
    parts = [f"SELECT '{c}' AS feature, {_key(c, missing)} AS value FROM {src}" for c in cols]
    if missing:
        parts += [f"SELECT '{c}', 'missing'" for c in cols]
    where = "" if missing else "WHERE value IS NOT NULL"
    return (f"SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER)"
            f" AS code FROM (SELECT DISTINCT feature, value FROM ({' UNION ALL '.join(parts)}) {where})")


def _encode_sql(cols, suffix, missing=True, src_all="od"):
    sel, joins = [], []
    for n, c in enumerate(cols):
        if missing:
            sel.append(f"coalesce(d{n}.code, m{n}.code) AS {c}{suffix}")
            joins.append(f"LEFT JOIN dict d{n} ON d{n}.feature = '{c}' AND d{n}.value = {_key('x.' + c, True)}")
            joins.append(f"LEFT JOIN dict m{n} ON m{n}.feature = '{c}' AND m{n}.value = 'missing'")
        else:
            sel.append(f"coalesce(d{n}.code, -1) AS {c}{suffix}")
            joins.append(f"LEFT JOIN dict d{n} ON d{n}.feature = '{c}' AND d{n}.value = {_key('x.' + c, False)}")
    return f"SELECT x.Id, {', '.join(sel)} FROM {src_all} x {' '.join(joins)}"


PRIMARY = "coalesce(legs0_segments0_marketingCarrier_code, 'missing') AS primary_carrier"
CTE_TR = f""",
od AS (SELECT *, {PRIMARY} FROM options),
tr AS (SELECT * FROM od WHERE {HASH_TRAIN}),"""


LABEL_SQL = with_options(f"""{CTE_TR}
dict AS ({_dict_sql(LABEL_COLS)})
{_encode_sql(LABEL_COLS, "_encoded")}""")


@query("label_encode", LABEL_SQL)
def q_label_encode(spark, sf_dir):
    """Sorted-position codes with a 'missing' class, fitted on train."""
    o = _with_primary(_options(spark, sf_dir, CARRIER, *[c for c in LABEL_COLS if c != "primary_carrier"]))
    train, _ = group_split(o, label=None)
    model = LabelEncoder(LABEL_COLS).fit(train)
    return model.transform(o).select("Id", *[f"{c}_encoded" for c in LABEL_COLS])


ROUTE_SQL = with_options(f"""{CTE_TR}
dict AS ({_dict_sql(ROUTE_COLS)})
{_encode_sql(ROUTE_COLS, "")}""")


@query("cardinality_route", ROUTE_SQL)
def q_cardinality_route(spark, sf_dir):
    """Cardinality-routed encoding (<= 1000 distinct -> label codes in
    place, else frequency); here every column routes to label codes."""
    o = _options(spark, sf_dir, *ROUTE_COLS)
    train, _ = group_split(o, label=None)
    model = CardinalityEncoder(ROUTE_COLS, threshold=1000, exact=True).fit(train)
    return model.transform(o).select("Id", *ROUTE_COLS)


FREQ_COLS = ["legs0_segments0_aircraft_code", "nationality"]


@query("freq_encode", with_options(f"""{CTE_TR}
f0 AS (SELECT legs0_segments0_aircraft_code AS v, count(*) AS n FROM tr
       WHERE legs0_segments0_aircraft_code IS NOT NULL GROUP BY 1),
f1 AS (SELECT nationality AS v, count(*) AS n FROM tr WHERE nationality IS NOT NULL GROUP BY 1)
SELECT o.Id, coalesce(f0.n, 0) AS legs0_segments0_aircraft_code_freq, coalesce(f1.n, 0) AS nationality_freq
FROM od o LEFT JOIN f0 ON o.legs0_segments0_aircraft_code = f0.v LEFT JOIN f1 ON o.nationality = f1.v"""))
def q_freq_encode(spark, sf_dir):
    """Training frequency of the value, unseen -> 0, source dropped."""
    o = _options(spark, sf_dir, *FREQ_COLS)
    train, _ = group_split(o, label=None)
    model = FrequencyEncoder(FREQ_COLS).fit(train)
    return model.transform(o.select("Id", *FREQ_COLS))


CODE_COLS = ["nationality", "corporateTariffCode", "legs0_segments0_aircraft_code"]


@query("category_codes", with_options(f"""{CTE_TR}
dict AS ({_dict_sql(CODE_COLS, missing=False)})
{_encode_sql(CODE_COLS, "_code", missing=False)}"""))
def q_category_codes(spark, sf_dir):
    """Category codes, null / unseen -> -1."""
    o = _options(spark, sf_dir, *CODE_COLS)
    train, _ = group_split(o, label=None)
    model = LabelEncoder(CODE_COLS, suffix="_code", with_missing=False).fit(train)
    return model.transform(o).select("Id", *[f"{c}_code" for c in CODE_COLS])


TE_COLS = ["corporateTariffCode", "main_carrier", "nationality", "frequentFlyer"]
# corporateTariffCode has 4 distinct values (<= 10) and is not encoded;
# the other three have 25 at every scale of the driver data.
TE_KEEP = ["main_carrier", "nationality", "frequentFlyer"]


def _te_sql(rows_src: str) -> str:
    stats = ",\n".join(
        f"s_{c} AS (SELECT {c} AS v, sum(selected) AS s, count(selected) AS n FROM tr "
        f"WHERE {c} IS NOT NULL GROUP BY 1)" for c in TE_KEEP)
    sel = ", ".join(f"round(coalesce((s_{c}.s + g.gm * 10.0) / (s_{c}.n + 10.0), g.gm), 6) AS {c}_target_encoded"
                    for c in TE_KEEP)
    joins = " ".join(f"LEFT JOIN s_{c} ON x.{c} = s_{c}.v" for c in TE_KEEP)
    return with_options(f""",
od AS (SELECT *, legs0_segments0_marketingCarrier_code AS main_carrier FROM options),
tr AS (SELECT * FROM od WHERE {HASH_TRAIN}),
te AS (SELECT * FROM od WHERE NOT ({HASH_TRAIN})),
g AS (SELECT avg(selected) AS gm FROM tr),
{stats}
SELECT x.Id, {sel} FROM {rows_src} x {joins}, g""")


def _te_fit(spark, sf_dir):
    o = _options(spark, sf_dir, CARRIER, "selected", *[c for c in TE_COLS if c != "main_carrier"]).withColumn("main_carrier", F.col(CARRIER))
    train, test = group_split(o)
    return TargetEncoder(TE_COLS, smoothing=10.0).fit(train), train, test


@query("target_encode", _te_sql("tr"))
def q_target_encode(spark, sf_dir):
    """Smoothed target encoding of the training rows (in-sample)."""
    model, train, _ = _te_fit(spark, sf_dir)
    return rounded(model.transform(train).select("Id", *[f"{c}_target_encoded" for c in model.columns]))


@query("target_encode_apply", _te_sql("te"))
def q_target_encode_apply(spark, sf_dir):
    """The training statistics applied to test rows; unseen -> global mean."""
    model, _, test = _te_fit(spark, sf_dir)
    return rounded(model.transform(test).select("Id", *[f"{c}_target_encoded" for c in model.columns]))


def _ordered_sql() -> str:
    def code(c):
        w = f"(PARTITION BY {c} ORDER BY md5('42_' || CAST(Id AS VARCHAR)), Id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return (f"round(CASE WHEN {c} IS NULL THEN gm ELSE (coalesce(sum(selected) OVER {w}, 0) + gm * 10.0)"
                f" / (count(selected) OVER {w} + 10.0) END, 6) AS {c}_target_ordered")
    return with_options(f""",
od AS (SELECT *, legs0_segments0_marketingCarrier_code AS main_carrier FROM options),
tr AS (SELECT * FROM od WHERE {HASH_TRAIN}),
g AS (SELECT avg(selected) AS gm FROM tr)
SELECT Id, {", ".join(map(code, TE_COLS))} FROM tr, g""")


@query("target_encode_ordered", _ordered_sql())
def q_target_encode_ordered(spark, sf_dir):
    """J5 (ordered): target statistics of the rows before, in a seeded order."""
    o = options_view(spark, sf_dir).withColumn("main_carrier", F.col("legs0_segments0_marketingCarrier_code"))
    train, _ = group_split(o)
    _, coded = OrderedTargetEncoder(TE_COLS).fit_transform(train.select("Id", "selected", *TE_COLS))
    return rounded(coded.select("Id", *[f"{c}_target_ordered" for c in TE_COLS]))
