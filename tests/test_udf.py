"""User-function surface: row functions, group functions, feature registry."""

import pandas as pd
from pyspark.sql import functions as F

from rankflow.operators import features as E
from rankflow.operators import udf as U


def test_apply_rows_and_groups(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 4.0), (3, 2, 5.0)], "Id long, ranker_id long, v double")
    out = U.apply_rows(df, lambda p: p.assign(w=p["v"] * 2)[["Id", "w"]], "Id long, w double")
    assert sorted(r["w"] for r in out.collect()) == [4.0, 8.0, 10.0]

    def span(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ranker_id": [p["ranker_id"].iloc[0]], "span": [p["v"].max() - p["v"].min()]})
    g = {r["ranker_id"]: r["span"] for r in U.apply_groups(df, "ranker_id", span, "ranker_id long, span double").collect()}
    assert g == {1: 2.0, 2: 0.0}


def test_registered_feature_runs_in_pipeline(spark):
    @U.register_feature("price_squared")
    def price_squared(df):
        return df.withColumn("price_squared", F.col("totalPrice") * F.col("totalPrice"))

    df = spark.createDataFrame([(1, 3.0)], "Id long, totalPrice double")
    out = E.engineer_features(df, "full", extra=U.registered_features())
    r = out.first()
    assert r["price_squared"] == 9.0 and r["price_log"] > 0


def test_queries_leave_no_feature_behind(spark):
    from rankflow.plans.registry import QUERIES, load_all
    load_all()
    before = set(U.FEATURE_REGISTRY)
    assert QUERIES["user_features"](spark, "/root/testdata/sf0.001").columns == ["Id", "price_per_hour"]
    assert set(U.FEATURE_REGISTRY) == before and "price_per_hour" not in before


def test_streamed_groups_carry_state_over_batches(spark):
    """A group of a third of all rows goes through in batches of ten; null keys are a group of their own."""
    from rankflow.operators.udf import stream_groups
    rows = [(i, ["hot", f"g{i % 7}", None][i % 3], i % 5) for i in range(300)]
    seen_most = 10
    df = spark.createDataFrame(rows, "Id int, g string, v int").repartition(4)

    def step(state, part):
        assert len(part) <= seen_most
        out = state + part["v"].cumsum()
        return int(out.iloc[-1]), part[["Id"]].assign(total=out)

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(seen_most))
    try:
        got = {r["Id"]: r["total"] for r in stream_groups(df, "g", "Id", step, "Id int, total long", int).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    sums, want = {}, {}
    for i, g, v in rows:
        want[i] = sums[g] = sums.get(g, 0) + v
    assert got == want
