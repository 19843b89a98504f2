"""Queries of the sinks (A6-A9, M1), small filters (C8, C11), the model matrix
(O1), grades (O11) and the user-function surface (P1u, P3u)."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.ranking import strict_rank
from ..operators import clean as C
from ..operators import metrics as M
from ..operators import model as O
from ..operators import udf as U
from ..operators.split import group_split, hash_folds
from ..session import scratch_path
from ..sources import sinks
from ..sources.tables import check_inputs, read_options
from ..sources.views import options_view
from .oracle import with_options
from .q_session import rounded
from .q_split import H32
from .registry import query

HASH_TEST = f"{H32.format(s="'42_' || CAST(ranker_id AS VARCHAR)")} / CAST(4294967296 AS DOUBLE) >= 0.7"
NARROW = ["Id", "ranker_id", "totalPrice", "selected"]


def _folder(spark) -> str:
    return scratch_path(spark, f"out-{uuid.uuid4().hex}")


@query("parquet_sink", with_options(f"""
SELECT CASE WHEN {HASH_TEST} THEN 'test' ELSE 'train' END AS part, count(*) AS rows, count(DISTINCT ranker_id) AS sessions,
       CAST(CASE WHEN {HASH_TEST} THEN NULL ELSE sum(selected) END AS BIGINT) AS positives, round(sum(totalPrice), 2) AS price
FROM options GROUP BY {HASH_TEST}
UNION ALL SELECT 'sample', count(*), count(DISTINCT ranker_id), CAST(count(*) AS BIGINT), CAST(NULL AS DOUBLE) FROM options WHERE {HASH_TEST}"""))
def q_parquet_sink(spark, sf_dir):
    """A6 + A1 + M1: train, test and sample tables written, found and read back."""
    train, test = group_split(options_view(spark, sf_dir).select(*NARROW))
    out = _folder(spark)
    sinks.write_train_test_sample(train, test, test.select("Id", "ranker_id", F.lit(1).alias("selected")), out)
    paths = {n: f"{out}/{n}.parquet" for n in ("train", "test", "sample_submission")}
    check_inputs(spark, paths)
    tr, te, sample = (read_options(spark, p) for p in paths.values())
    none = F.lit(None).cast("long")
    counts = [F.count(F.lit(1)).alias("rows"), F.count_distinct("ranker_id").alias("sessions")]
    return (tr.agg(*counts, F.sum("selected").alias("positives"), F.sum("totalPrice").alias("price")).select(F.lit("train").alias("part"), "*")
            .unionByName(te.agg(*counts, F.max(none).alias("positives"), F.sum("totalPrice").alias("price")).select(F.lit("test").alias("part"), "*"))
            .unionByName(sample.agg(*counts, F.sum("selected").cast("long").alias("positives"), F.max(F.lit(None).cast("double")).alias("price"))
                         .select(F.lit("sample").alias("part"), "*"))
            .withColumn("price", F.round("price", 2)))


@query("csv_sink", with_options("""
SELECT CAST(Id AS VARCHAR) AS Id, CAST(ranker_id AS VARCHAR) AS ranker_id,
       CAST(row_number() OVER (PARTITION BY ranker_id ORDER BY totalPrice ASC NULLS LAST, Id) AS INTEGER) AS selected
FROM options"""))
def q_csv_sink(spark, sf_dir):
    """A7 + A8: a submission (by price) written as CSV and read back."""
    o = options_view(spark, sf_dir)
    sub = o.select("Id", "ranker_id", strict_rank("totalPrice", ascending=True).alias("selected"))
    return sinks.read_submission(spark, sinks.write_submission(sub, _folder(spark), "by_price"))


@query("json_sink", with_options("""
SELECT nationality AS name, count(*) AS rows, round(avg(totalPrice), 4) AS price FROM options GROUP BY nationality"""))
def q_json_sink(spark, sf_dir):
    """A table of results written as JSON lines and read back."""
    results = options_view(spark, sf_dir).groupBy(F.col("nationality").alias("name")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("totalPrice").alias("price"))
    path = _folder(spark)
    sinks.write_params(results, path)
    return rounded(spark.read.schema("name string, rows long, price double").json(path), 4)


@query("keep_numeric", with_options("SELECT Id, ranker_id, isVip, totalPrice, pricingInfo_passengerCount, legs0_duration FROM options"))
def q_keep_numeric(spark, sf_dir):
    """The numeric (and boolean) columns of a frame."""
    return C.keep_numeric(options_view(spark, sf_dir).select(
        "Id", "ranker_id", "nationality", "isVip", "requestDate", "totalPrice", "pricingInfo_passengerCount", "legs0_duration", "frequentFlyer"))


@query("labelled_large_sessions", with_options("""
SELECT Id, ranker_id FROM options WHERE selected = 1
  AND ranker_id IN (SELECT ranker_id FROM options GROUP BY ranker_id HAVING count(*) > 10)"""))
def q_labelled_large_sessions(spark, sf_dir):
    """C11: positive rows of sessions with more than ten rows."""
    o = options_view(spark, sf_dir)
    return C.filter_labelled(C.filter_group_size(o, 10)).select("Id", "ranker_id")


MATRIX = ["totalPrice", "legs0_duration", "miniRules0_percentage", "pricingInfo_passengerCount"]


@query("matrix_columns", with_options(f""",
m AS (SELECT {", ".join(f"coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0.0) AS m_{c}" for c in MATRIX)} FROM options WHERE NOT ({HASH_TEST}))
SELECT Id, ranker_id, {", ".join(f"round(coalesce(CAST({c} AS DOUBLE), m_{c}), 6) AS {c}" for c in MATRIX)} FROM options, m WHERE {HASH_TEST}"""))
def q_matrix_columns(spark, sf_dir):
    """O1: the test rows' matrix, missing values filled by medians of the training rows."""
    o = options_view(spark, sf_dir, materialize=True, columns=["Id", "ranker_id", "selected", *MATRIX])
    train, test = group_split(o)
    x = O.MatrixPrep().fit(train).transform(test)
    v = vector_to_array("features")
    return rounded(x.select("Id", "ranker_id", *[v[i].alias(c) for i, c in enumerate(MATRIX)]))


@query("grades", with_options(f"""
SELECT CAST({H32.format(s="CAST(ranker_id AS VARCHAR)")} % 5 AS INTEGER) AS fold,
       CASE WHEN avg(h) >= 0.7 THEN 'excellent' WHEN avg(h) >= 0.5 THEN 'great' WHEN avg(h) >= 0.3 THEN 'fair' ELSE 'improve' END AS grade
FROM (SELECT ranker_id, selected, CASE WHEN dense_rank() OVER (PARTITION BY ranker_id ORDER BY totalPrice) <= 3 THEN 1.0 ELSE 0.0 END AS h FROM options)
WHERE selected = 1 GROUP BY 1"""))
def q_grades(spark, sf_dir):
    """The grade of each fold's HitRate@3 of the price baseline."""
    o = hash_folds(options_view(spark, sf_dir), 5)
    ranked = o.select("ranker_id", "fold", "selected", M.dense_rank_desc(-F.col("totalPrice")).alias("rank"))
    rates = ranked.filter("selected = 1").groupBy("fold").agg(F.avg((F.col("rank") <= 3).cast("double")).alias("hitrate"))
    return rates.select("fold", M.grade("hitrate").alias("grade"))


def _running(state, rows):
    """Spend of the session so far, and the largest price so far."""
    total, top = state
    spent = total + rows["price"].cumsum()
    high = rows["price"].cummax().clip(lower=top)
    return (float(spent.iloc[-1]), float(high.iloc[-1])), rows[["Id"]].assign(spent=spent, highest=high)


@query("user_group_fn", with_options("""
, x AS (SELECT Id, ranker_id, CAST(round(coalesce(totalPrice, 0)) AS DOUBLE) AS p FROM options)
SELECT Id, sum(p) OVER w AS spent, max(p) OVER w AS highest FROM x
WINDOW w AS (PARTITION BY ranker_id ORDER BY Id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".lstrip()))
def q_user_group_fn(spark, sf_dir):
    """P1u: a running per-session user function, batch by batch."""
    o = options_view(spark, sf_dir).select("Id", "ranker_id", F.round(F.coalesce("totalPrice", F.lit(0.0))).alias("price"))
    return U.stream_groups(o, "ranker_id", "Id", _running, "Id long, spent double, highest double", lambda: (0.0, 0.0))


def price_per_hour(df):
    """A user feature: price by the hour of the first leg."""
    return df.withColumn("price_per_hour", F.try_divide("totalPrice", "legs0_duration"))


@query("user_features", with_options("SELECT Id, round(CASE WHEN legs0_duration <> 0 THEN totalPrice / legs0_duration END, 4) AS price_per_hour FROM options"))
def q_user_features(spark, sf_dir):
    """P3u: registered feature functions applied to the option table."""
    o = options_view(spark, sf_dir).select("Id", "totalPrice", "legs0_duration")
    U.register_feature("price_per_hour")(price_per_hour)
    try:
        for feature in U.registered_features():
            o = feature(o)
    finally:    # not left to other users of the session
        U.unregister_feature("price_per_hour")
    return rounded(o.select("Id", "price_per_hour"), 4)
