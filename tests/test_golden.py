"""Golden micro-tables: hand-computed expectations for the pandas-parity
rules (ties, nulls, singletons, negative lead time, divisions)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rankflow.functions import exprs as X
from rankflow.functions import ranking as R
from rankflow.operators import encode as J
from rankflow.operators import features as E
from rankflow.operators import metrics as M
from rankflow.operators import session as S


def _rows(df, order="Id"):
    return [r.asDict() for r in df.orderBy(order).collect()]


def test_ranks_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0), (3, 1, 2.0), (4, 1, None)],
                               "Id int, ranker_id int, v double")
    out = _rows(df.select("Id", R.avg_rank("v").alias("a"), R.pct_rank("v").alias("p"),
                          R.dense_rank_desc("v").alias("d")))
    assert [r["a"] for r in out] == [1.5, 1.5, 3.0, None]
    assert [r["p"] for r in out] == [0.5, 0.5, 1.0, None]
    assert [r["d"] for r in out] == [2, 2, 1, None]


def test_lead_time_floors(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 20), dt.datetime(2024, 1, 1, 10))],
                               "requestDate timestamp_ntz, legs0_departureAt timestamp_ntz")
    r = E.booking_lead_features(df).first()
    assert r["days_to_departure"] == -1
    assert r["hours_to_departure"] == -10.0
    assert r["is_last_minute"] == 1 and r["is_advance_booking"] == 0


def test_null_flags_and_codeshare(spark):
    df = spark.createDataFrame([(None, None, None, None, None)],
                               "legs0_segments0_cabinClass double, legs0_segments0_seatsAvailable int, "
                               "totalPrice double, legs0_segments0_marketingCarrier_code string, "
                               "legs0_segments0_operatingCarrier_code string")
    r = E.codeshare_features(E.seat_features(E.cabin_features(df))).first()
    assert r["has_economy"] == 0 and r["is_all_economy"] == 0 and r["cabin_class_consistency"] == 0
    assert r["very_limited_seats"] == 0 and r["good_availability"] == 0
    assert r["seg0_codeshare"] == 1          # pandas: NaN != NaN is True


def test_rowwise_all_null(spark):
    df = spark.createDataFrame([(None, None)], "a double, b double")
    r = df.select(X.row_sum(["a", "b"]).alias("s"), X.row_min(["a", "b"]).alias("mn"),
                  X.row_max(["a", "b"]).alias("mx"), X.row_mean(["a", "b"]).alias("m"),
                  X.row_count(["a", "b"]).alias("n")).first()
    assert r["s"] == 0 and r["mn"] is None and r["mx"] is None and r["m"] is None and r["n"] == 0


def test_safe_divide(spark):
    df = spark.createDataFrame([(1, 4.0, 0.0), (2, 4.0, None), (3, 4.0, 2.0)], "Id int, n double, d double")
    out = [r["q"] for r in _rows(df.select("Id", X.safe_div("n", "d").alias("q")))]
    assert out == [0.0, None, 2.0]


def test_singleton_session(spark):
    df = spark.createDataFrame([(1, 7, 100.0, 5.0)], "Id int, ranker_id int, totalPrice double, legs0_duration double")
    r = S.add_session_features(df).first()
    assert r["session_totalPrice_std"] == 0.0
    assert r["price_rank_in_session"] == 1.0
    assert r["is_cheapest_in_session"] == 1 and r["is_most_expensive_in_session"] == 1


def test_extreme_ties_give_zero(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (2, 1, 10.0), (3, 1, 20.0)],
                               "Id int, ranker_id int, totalPrice double")
    out = _rows(df.withColumns(S.relative_columns()))
    assert [r["is_cheapest_in_session"] for r in out] == [0, 0, 0]
    assert [r["is_most_expensive_in_session"] for r in out] == [0, 0, 1]


@pytest.fixture()
def hitrate_table(spark):
    rows = []
    # session 1: 11 options, positive at score rank 3 (ties at rank 3)
    for i in range(11):
        rows.append((i, 1, float(20 - i) if i not in (2, 3) else 18.0, 1 if i == 3 else 0))
    # session 2: 10 options (small), positive at rank 1
    for i in range(10):
        rows.append((100 + i, 2, float(10 - i), 1 if i == 0 else 0))
    # session 3: 12 options, no positive
    for i in range(12):
        rows.append((200 + i, 3, float(i), 0))
    # session 4: 12 options, two positives at ranks 5 and 6
    for i in range(12):
        rows.append((300 + i, 4, float(12 - i), 1 if i in (4, 5) else 0))
    return spark.createDataFrame(rows, "Id int, ranker_id int, score double, selected int")


def test_hitrate_row_vs_session_forms(spark, hitrate_table):
    ranked = hitrate_table.withColumn("rank", R.dense_rank_desc("score"))
    all_rows = M.hitrate_rows(ranked, "rank", min_group_size=0).first()
    assert all_rows["positives"] == 4 and all_rows["hits"] == 2      # session 1 (dense 3) and 2
    large = M.hitrate_rows(ranked, "rank", min_group_size=10).first()
    assert large["positives"] == 3 and large["hits"] == 1
    sess = M.hitrate_sessions(hitrate_table, "score", min_group_size=10).first()
    # sessions 1, 3, 4 are large; in session 1 the tie at 18 goes to the
    # smaller Id, pushing the positive to 4th: the forms differ under ties
    assert sess["sessions"] == 3 and sess["hits"] == 0


def test_label_encoder_missing_class(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    test = spark.createDataFrame([("b",), ("c",), (None,)], "c string")
    model = J.LabelEncoder(["c"]).fit(train)
    out = [r["c_encoded"] for r in model.transform(test).collect()]
    # classes sorted: a=0, b=1, missing=2
    assert sorted(out) == [1, 2, 2]


def test_target_encoding_smoothing(spark):
    rows = [("x", 1), ("x", 0)] + [(f"k{i}", 0) for i in range(10)] + [("k0", 1), ("k1", 1)]
    df = spark.createDataFrame(rows, "c string, selected int")
    gm = 3 / 14
    model = J.TargetEncoder(["c"], smoothing=10.0, min_distinct=10).fit(df)
    r = model.transform(spark.createDataFrame([("x",), ("zzz",)], "c string")).collect()
    got = {x["c"]: x["c_target_encoded"] for x in r}
    assert got["x"] == pytest.approx((1 + gm * 10) / 12)
    assert got["zzz"] == pytest.approx(gm)


def test_target_encoding_reference_example(spark):
    # n=2, mean 0.5, global 0.25, m=10 -> (0.5*2 + 0.25*10) / 12 = 3.5 / 12
    s, n, gm, m = 1.0, 2, 0.25, 10.0
    assert (s + gm * m) / (n + m) == pytest.approx(3.5 / 12)


def test_weekday_is_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp_ntz")   # a Monday
    assert df.select(X.weekday0("t").alias("d")).first()["d"] == 0


def test_sql_round_matches_scaled_rounding(spark):
    df = spark.createDataFrame([(1193.2940624999998,)], "x double")
    assert df.select(X.sql_round("x", 6).alias("r")).first()["r"] == 1193.294063


def test_mini_rules_last_wins(spark):
    rules = [(31, 1.0, 0.1, None), (33, 2.0, 0.2, None), (31, 3.0, 0.3, None)]
    df = spark.createDataFrame([(rules,)], "r array<struct<category:int, monetaryAmount:double, "
                                           "percentage:double, statusInfos:array<string>>>")
    from rankflow.sources.documents import mini_rule_columns
    r = df.select(*[v.alias(k) for k, v in mini_rule_columns(F.col("r")).items()]).first()
    assert r["miniRules0_monetaryAmount"] == 3.0 and r["miniRules1_monetaryAmount"] == 2.0


def test_skew_safe_rank_equals_window_rank(spark):
    from rankflow.functions.skew import add_avg_rank_skew_safe
    # one hot session (most rows, many ties, a null) next to small ones
    rows = [(i, 1, float(i % 37) if i % 50 else None) for i in range(3000)]
    rows += [(10000 + i, 2 + i % 5, float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "Id int, ranker_id int, v double")
    a = {r["Id"]: (r["a"], r["p"]) for r in
         df.select("Id", R.avg_rank("v").alias("a"), R.pct_rank("v").alias("p")).collect()}
    b = {r["Id"]: (r["a"], r["p"]) for r in
         add_avg_rank_skew_safe(df, "v", name="a", pct_name="p").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        assert (a[k][1] is None and b[k][1] is None) or abs(a[k][1] - b[k][1]) < 1e-12


def test_skew_safe_random_rank_of_a_hot_session(spark):
    from rankflow.functions.ranking import random_rank
    from rankflow.functions.skew import add_random_rank_skew_safe
    df = spark.range(900).select(F.col("id").alias("Id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("ranker_id"))
    a = {r["Id"]: r["r"] for r in df.select("Id", random_rank(seed=7).alias("r")).collect()}
    b = {r["Id"]: r["random_rank"] for r in add_random_rank_skew_safe(df, seed=7).collect()}
    assert a == b


def test_skew_safe_session_family_equals_window_form(spark):
    rows = [(i, 1, float(i % 53) if i % 40 else None, float(i % 7)) for i in range(2000)]
    rows += [(5000 + i, 2 + i % 4, float(i % 5), None) for i in range(30)] + [(9000, 99, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "Id int, ranker_id int, totalPrice double, legs0_duration double")
    a = {r["Id"]: r for r in S.add_session_features(df).collect()}
    b = {r["Id"]: r for r in S.add_session_features_skew_safe(df).collect()}
    assert a.keys() == b.keys()
    cols = [c for c in S.add_session_features(df).columns if c not in df.columns]
    for k in a:
        for c in cols:
            x, y = a[k][c], b[k][c]
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-12, abs=1e-9), (k, c, x, y)


def test_skew_safe_strict_and_dense_ranks(spark):
    from rankflow.functions.skew import add_dense_rank_desc_skew_safe, add_strict_rank_skew_safe
    rows = [(i, 1, float(i % 37) if i % 50 else None) for i in range(3000)]
    rows += [(10000 + i, 2 + i % 5, float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "Id int, ranker_id int, v double")
    a = {r["Id"]: (r["s"], r["d"]) for r in
         df.select("Id", R.strict_rank("v").alias("s"), R.dense_rank_desc("v").alias("d")).collect()}
    b1 = {r["Id"]: r["s"] for r in add_strict_rank_skew_safe(df, "v", name="s").collect()}
    b2 = {r["Id"]: r["d"] for r in add_dense_rank_desc_skew_safe(df, "v", name="d").collect()}
    assert {k: v[0] for k, v in a.items()} == b1
    assert {k: v[1] for k, v in a.items()} == b2


def test_rank_distribution_forms_agree(spark, hitrate_table):
    a = sorted(tuple(r) for r in M.rank_distribution(hitrate_table, "score").collect())
    b = sorted(tuple(r) for r in M.rank_distribution(hitrate_table, "score", skew_safe=True).collect())
    assert a == b and sum(n for _, n in a) == hitrate_table.count()


def test_epoch_seconds_ignore_session_time_zone(spark):
    from rankflow.operators.clean import datetimes_to_epoch
    df = spark.createDataFrame([(dt.datetime(1970, 1, 2, 1, 0, 0),)], "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert datetimes_to_epoch(df).first()["t"] == 86400 + 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_global_index_is_a_permutation_without_exchange_reuse(spark):
    from rankflow.functions.indexing import global_index
    n = 300_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("p"), 40).alias("payload"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        idx = global_index(df, [F.col("k")], partitions=17)
        r = idx.agg(F.count_distinct("_idx").alias("d"), F.min("_idx").alias("lo"), F.max("_idx").alias("hi")).first()
        assert (r["d"], r["lo"], r["hi"]) == (n, 0, n - 1)
        from rankflow.functions.skew import add_strict_rank_skew_safe
        ev = df.select((F.abs("k") % 3).alias("ranker_id"), F.col("k").alias("Id"), (F.col("k") % 1000).cast("double").alias("v"), "payload")
        per = add_strict_rank_skew_safe(ev, "v").groupBy("ranker_id").agg(
            F.count_distinct("strict_rank").alias("d"), F.max("strict_rank").alias("m"), F.count(F.lit(1)).alias("n")).collect()
        assert all(x["d"] == x["m"] == x["n"] for x in per)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_exact_quantiles_equal_percentile(spark):
    from rankflow.functions.indexing import exact_quantiles
    df = spark.range(1001).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.rand(1)).alias("b"),
                                  F.lit(None).cast("int").alias("c"), F.col("id").cast("int").alias("d"))
    ps = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = exact_quantiles(df, ["a", "b", "c", "d"], ps)
    want = df.agg(*[F.percentile(c, list(ps)).alias(c) for c in ("a", "b", "d")]).first()
    for c in ("a", "b", "d"):
        assert [got[c, p] for p in ps] == pytest.approx(want[c], rel=1e-12)
    assert ("c", 0.5) not in got


def test_median_fills_gaps_that_only_the_test_rows_have(spark):
    from rankflow.operators.clean import MedianImputer
    train = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    test = spark.createDataFrame([(None,)], "x double")
    assert MedianImputer(["x"]).fit(train).transform(test).first()["x"] == 2.0


def test_submission_check_reports_bad_ranks(spark):
    from rankflow.operators.validate import check_submission
    test = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "Id long, ranker_id long")
    half = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.5), (3, 1, 3.0)], "Id long, ranker_id long, selected double")
    assert check_submission(half, test).first()["valid"] is False
    r = check_submission(half.drop("selected"), test).first()
    assert r["columns_ok"] is False and r["valid"] is False
    assert check_submission(half.withColumn("selected", F.expr("Id")), test).first()["valid"] is True


def test_scratch_folder_must_be_shared_off_local():
    from types import SimpleNamespace
    from rankflow.session import ensure_checkpoint_dir
    conf = {"spark.master": "yarn"}
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)
