"""Property checks on the driver tables (sf0.001)."""

from pyspark.sql import functions as F

from rankflow.functions import ranking as R
from rankflow.operators import encode as J
from rankflow.operators import metrics as M
from rankflow.operators import model as O
from rankflow.operators import split as K
from rankflow.sources.views import events_view, options_view

from .conftest import SF_TINY


def test_strict_ranks_are_permutations(spark):
    ev = events_view(spark, SF_TINY)
    sub = O.submission(ev, "score")
    bad = (sub.groupBy("ranker_id").agg(F.min("selected").alias("mn"), F.max("selected").alias("mx"),
                                         F.count("*").alias("n"), F.count_distinct("selected").alias("d"))
              .filter((F.col("mn") != 1) | (F.col("mx") != F.col("n")) | (F.col("d") != F.col("n"))))
    assert bad.count() == 0


def test_split_and_folds_partition_sessions(spark):
    o = options_view(spark, SF_TINY)
    train, test = K.group_split(o)
    shared = train.select("ranker_id").distinct().join(test.select("ranker_id").distinct(), "ranker_id")
    assert shared.count() == 0
    assert train.count() + test.count() == o.count()
    assert "selected" not in test.columns
    f = K.hash_folds(o, 5)
    assert f.groupBy("ranker_id").agg(F.count_distinct("fold").alias("k")).filter("k > 1").count() == 0
    b = K.balanced_fold_keys(o, 5)
    sizes = [r["n"] for r in K.with_folds(o, b).groupBy("fold").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= max(25, 0.2 * max(sizes))


def test_exact_split_size(spark):
    o = options_view(spark, SF_TINY)
    keys = K.exact_split_keys(o, 0.3)
    n = keys.count()
    assert keys.filter(~F.col("is_test")).count() == int(n * 0.7)


def test_hitrate_forms_agree_with_unique_scores_and_one_positive(spark):
    o = options_view(spark, SF_TINY).withColumn("score", -F.col("totalPrice"))
    r = o.withColumn("rank", R.strict_rank("score"))
    l1 = M.hitrate_rows(r, "rank", min_group_size=10).first()["hitrate"]
    l2 = M.hitrate_sessions(o, "score", min_group_size=10).first()["hitrate"]
    assert l1 == l2


def test_hitrate_grows_with_k(spark):
    o = options_view(spark, SF_TINY).withColumn("rank", R.random_rank())
    vals = [M.hitrate_rows(o, "rank", k=k).first()["hitrate"] for k in (1, 3, 5, 10)]
    assert vals == sorted(vals)


def test_fit_then_transform_equals_itself_and_unseen_default(spark):
    o = options_view(spark, SF_TINY)
    train, test = K.group_split(o, label=None)
    model = J.LabelEncoder(["nationality"]).fit(train)
    a = {r["Id"]: r["nationality_encoded"] for r in model.transform(train).collect()}
    b = {r["Id"]: r["nationality_encoded"] for r in
         J.LabelEncoder(["nationality"]).fit(train).transform(train).collect()}
    assert a == b
    unseen = spark.createDataFrame([(1, "ATLANTIS")], "Id long, nationality string")
    got = model.transform(unseen).first()["nationality_encoded"]
    assert got == model.missing_codes["nationality"]


def test_freq_encoder_unseen_is_zero(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    m = J.FrequencyEncoder(["c"]).fit(df)
    out = {r["c_freq"] for r in m.transform(spark.createDataFrame([("a",), ("z",), (None,)], "c string")).collect()}
    assert out == {2, 0}


def test_submission_skew_safe_equals_window(spark):
    ev = events_view(spark, SF_TINY)
    a = {r["Id"]: r["selected"] for r in O.submission(ev, "score").collect()}
    b = {r["Id"]: r["selected"] for r in O.submission(ev, "score", skew_safe=True).collect()}
    assert a == b


def test_order_with_too_many_options_fails_loudly(spark):
    import pytest

    from rankflow.sources.views import PARTS, option_select_exprs
    ids = lambda part: spark.range(1).selectExpr("7L AS o_orderkey", f"{part}L + id AS part").selectExpr(option_select_exprs()[0])
    assert ids(PARTS - 1).first()["Id"] == 8 * PARTS - 1 and ids(0).schema["Id"].dataType.simpleString() == "bigint"
    with pytest.raises(Exception, match="more than"):
        ids(PARTS).collect()
