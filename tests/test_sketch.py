"""Stored sketches: they grow by partitions and stay within their bounds."""

import numpy as np
from pyspark.sql import functions as F

from rankflow.operators import sketch as K


def table(spark, n=60_000):
    i = F.col("id")
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")
    # a hot value in a third of all rows, nulls, NaN
    x = F.when(i % 3 == 0, F.lit(5.0)).when(i % 50 == 1, F.lit(None)).when(i % 50 == 2, F.lit(float("nan"))).otherwise(h)
    return spark.range(n).select((i % 7).alias("day"), x.alias("x"), (i % 4).cast("string").alias("few"),
                                 i.cast("string").alias("many"), F.lit(None).cast("double").alias("void"))


COLS = ["x", "few", "many", "void"]


def test_grows_by_partitions(spark, tmp_path):
    df = table(spark)
    store = K.SketchStore(spark, str(tmp_path / "s"), COLS)
    store.add(df.filter("day < 5"), F.col("day"))
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    for day in (5, 6, 6):                       # a repeated partition replaces itself
        store.add(df.filter(F.col("day") == day), F.col("day"))
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    assert before.items() <= after.items()      # the earlier partitions were not touched
    got = {r["column"]: r for r in store.profile().collect()}
    vals = np.array([r["x"] for r in df.select("x").collect() if r["x"] is not None])
    vals = np.sort(vals[~np.isnan(vals)])
    assert got["x"]["missing_count"] == df.filter("x IS NULL").count()
    assert abs(got["x"]["mean"] - vals.mean()) < 1e-6 and got["x"]["max"] == vals[-1]
    assert got["few"]["unique_count"] == 4 and got["few"]["mean"] is None
    assert abs(got["many"]["unique_count"] - 60_000) <= 60_000 * K.DISTINCT_BOUND
    assert got["void"]["unique_count"] == 0 and got["void"]["missing_pct"] == 100.0
    for r in store.quantiles([0.1, 0.4, 0.5, 0.99]).collect():
        assert r["column"] == "x"
        low, high = np.searchsorted(vals, r["value"], "left") / len(vals), np.searchsorted(vals, r["value"], "right") / len(vals)
        assert low - K.RANK_BOUND <= r["p"] <= high + K.RANK_BOUND
    worst = K.rank_errors(df, store.quantiles([0.1, 0.5, 0.99]), ["x"]).agg(F.max("rank_error"), F.max("n")).first()
    assert worst[0] <= K.RANK_BOUND and worst[1] == len(vals)
    # the distinct sketches do not depend on how the table was cut
    whole = K.SketchStore(spark, str(tmp_path / "w"), COLS).add(df, F.lit("all"))
    a, b = ({r["column"]: r["unique_count"] for r in s.profile().collect()} for s in (store, whole))
    assert abs(a["many"] - b["many"]) <= 60_000 * K.DISTINCT_BOUND


def test_fitted_from_sketches(spark, tmp_path):
    df = table(spark).withColumn("totalPrice", F.col("x"))
    store = K.SketchStore(spark, str(tmp_path / "s"), ["totalPrice", "x"]).add(df, F.col("day"))
    filled = store.median_imputer(["x"]).transform(df)
    assert filled.filter("x IS NULL").count() == 0
    tiers = store.price_tiers()
    exact = df.filter("x IS NOT NULL AND NOT isnan(x)").selectExpr("percentile(x, array(0.25, 0.75, 0.9)) AS q").first()["q"]
    assert tiers.thresholds[0] == exact[0] == 5.0       # the hot value
    for t, e in zip(tiers.thresholds, exact):
        assert abs(t - e) <= 0.04 * 1_000_003
    flags = tiers.transform(df).agg(F.avg("is_premium_flight")).first()[0]
    assert 0.2 < flags < 0.3


def test_empty_table(spark, tmp_path):
    store = K.SketchStore(spark, str(tmp_path / "s"), COLS).add(table(spark).limit(0), F.col("day"))
    assert store.profile().count() == 0 and store.quantiles([0.5]).count() == 0
    assert store.median_imputer().medians == {}
