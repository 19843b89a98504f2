"""Model smoke tests and the streaming ingest path."""

import json

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from dataclasses import replace

from rankflow.operators import clean as C
from rankflow.operators import metrics as M
from rankflow.operators import model as O
from rankflow.operators.split import group_split, hash_folds
from rankflow.sources.views import options_view

from .conftest import SF_SMALL


def _cheapest_label(spark):
    """Options whose label is 'the cheapest option of the session'."""
    o = options_view(spark, SF_SMALL)
    r = F.row_number().over(Window.partitionBy("ranker_id").orderBy("totalPrice", "Id"))
    return o.withColumn("selected", (r == 1).cast("int"))


def test_models_beat_random_on_learnable_label(spark):
    o = _cheapest_label(spark)
    train, test = group_split(o, label=None)
    tr, te, _ = C.simple_feature_table(train, test)
    te = te.join(test.select("Id", "selected"), "Id")
    prep = O.MatrixPrep().fit(tr)
    xtr, xte = prep.transform(tr).cache(), prep.transform(te).cache()
    rnd = M.hitrate_sessions(xte.withColumn("score", F.rand(7)), "score", min_group_size=10).first()["hitrate"]
    gbt = O.fit_gbt(xtr, rounds=20, max_depth=4, learning_rate=0.2)
    g = O.evaluate(O.score(gbt, xte)).first()["hitrate_sessions"]
    pw = O.PairwiseRanker(regParam=0.01).fit(xtr)
    p = O.evaluate(pw.transform(xte)).first()["hitrate_sessions"]
    assert g > rnd + 0.2 and p > rnd + 0.2
    imp = O.feature_importance(gbt, prep.feature_cols).first()
    assert imp["feature"] in ("totalPrice", "price_log")


def test_early_stopping_and_cv(spark):
    o = _cheapest_label(spark)
    tr, _, _ = C.simple_feature_table(o)
    x = O.MatrixPrep().fit(tr).transform(tr)
    f = hash_folds(x, 5)
    m = O.fit_gbt(f.filter("fold != 0").drop("fold"), f.filter("fold = 0").drop("fold"), rounds=30, patience=5)
    assert 1 <= m.best_round <= 30
    cv = O.cross_validate(hash_folds(x, 3), k=3, params=replace(O.CV_RANKER, rounds=8, learning_rate=0.2))
    assert cv.count() == 3
    s = M.cv_summary(cv).first()
    assert s["folds"] == 3 and s["hitrate_all_mean"] > 0.3


def test_streaming_ingest(spark, tmp_path):
    from rankflow.streaming.ingest import start_ingest
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        d = {"ranker_id": f"R{i}", "routeData": {"requestDate": "2024-05-01T08:30:00", "searchRoute": "A/B"},
             "data": {"$values": [{"legs": [], "pricings": [{"totalPrice": 10.0 + i, "taxes": 1.0}]}]}}
        (src / f"R{i}.json").write_text(json.dumps(d))
    q = start_ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["Id"] for r in out.collect()) == ["R0_0_0", "R1_0_0", "R2_0_0"]
    assert "price_log" in out.columns


def test_listwise_boosting_learns_and_stops(spark):
    o = _cheapest_label(spark)
    train, test = group_split(o, label=None)
    tr, te, _ = C.simple_feature_table(train, test)
    te = te.join(test.select("Id", "selected"), "Id")
    prep = O.MatrixPrep().fit(tr)
    xtr, xte = prep.transform(tr), prep.transform(te)
    f = hash_folds(xtr, 5)
    m = O.fit_ranker(f.filter("fold != 0").drop("fold"), f.filter("fold = 0").drop("fold"), objective="softmax",
                     rounds=12, patience=2, learning_rate=0.3, num_leaves=15)
    assert 1 <= m.best_round <= 12
    rnd = M.hitrate_sessions(xte.withColumn("score", F.rand(7)), "score", min_group_size=10).first()["hitrate"]
    got = O.evaluate(m.transform(xte)).first()["hitrate_sessions"]
    assert got > rnd + 0.2


def test_streaming_restart_is_exactly_once(spark, tmp_path):
    from rankflow.streaming.ingest import start_ingest
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()

    def put(i):
        d = {"ranker_id": f"R{i}", "data": {"$values": [{"legs": [], "pricings": [{"totalPrice": 1.0 * i}]}]}}
        (src / f"R{i}.json").write_text(json.dumps(d))
    for i in range(2):
        put(i)
    start_ingest(spark, str(src), out, ck).awaitTermination(120)
    put(2)                                      # a new file arrives; the job restarts from its checkpoint
    start_ingest(spark, str(src), out, ck).awaitTermination(120)
    ids = sorted(r["Id"] for r in spark.read.parquet(out).collect())
    assert ids == ["R0_0_0", "R1_0_0", "R2_0_0"]


def test_run_solution_end_to_end(spark, tmp_path):
    from rankflow.plans.solution import run_solution
    from rankflow.sources.views import options_view
    from .conftest import SF_TINY
    o = options_view(spark, SF_TINY)
    train, test = group_split(o)
    res = run_solution(train, test, out_dir=str(tmp_path), folds=2,
                       changes={"rounds": 3, "max_depth": 3, "min_data_in_leaf": 5})
    chk = res.submission_check.first()
    assert chk["valid"] and chk["rows_submission"] == test.count()
    assert res.cv.count() == 2 and res.cv_summary.first()["folds"] == 2
    assert res.submission_path and spark.read.option("header", True).csv(res.submission_path).count() == test.count()
    assert res.importance.count() > 50


def test_registered_model_queries_use_the_production_defaults(spark, monkeypatch):
    """Trials, folds and round limits of the reference; every boosted fit is ended by validation."""
    from rankflow.operators import boost as B
    from rankflow.operators import model as M
    from rankflow.plans import q_model as Q
    rows = [(i, i // 4, int(i % 4 == 0), [float(i % 7)]) for i in range(400)]
    x = spark.createDataFrame(rows, "Id long, ranker_id long, selected int, v array<double>").withColumn("features", M.array_to_vector("v"))
    monkeypatch.setattr(Q, "_matrices", lambda *_: (None, x, x))

    class Stop(Exception):
        pass

    def stop(blocks, fits, rounds=None, feed=None):
        raise Stop(len(fits), {(f.params.objective, f.params.rounds, f.params.patience, f.holdout is not None) for f in fits.values()})

    monkeypatch.setattr(M, "boost", stop)
    monkeypatch.setattr(B, "boost", stop)
    ranker, squared = ("lambdarank", 3000, 200, True), ("squared", 2000, 200, True)
    cv = ("lambdarank", 1000, 100, True)
    for name, want in {"gbt": (1, {squared}), "lambda": (1, {ranker}), "softmax": (1, {("softmax", 3000, 200, True)}),
                       "ensemble": (2, {ranker, squared}), "cv": (5, {cv}), "search": (120, {cv})}.items():
        with pytest.raises(Stop) as e:
            getattr(Q, f"q_model_{name}")(spark, "")
        assert e.value.args == want, name
    assert M.SEARCH_TRIALS == 100 and M.SEARCH_FOLDS == 3
