"""The histogram booster against plain versions of its parts."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from rankflow.operators import boost as B
from rankflow.operators import model as M


def matrix(spark, sessions=120, seed=0, folds=3):
    """Sessions of 1 to 12 rows; the positive is mostly the row with the largest first feature."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(sessions):
        n = int(rng.integers(1, 13))
        v = np.round(rng.normal(size=(n, 4)), 2)
        v[:, 3] = rng.integers(0, 2, n)
        best = int(np.argmax(v[:, 0] + 0.3 * v[:, 1] + 0.2 * rng.normal(size=n)))
        for r in range(n):
            rows.append((i, g, int(r == best) if g % 9 else (None if g % 2 else 1), [float(x) for x in v[r]], g % folds))
            i += 1
    df = spark.createDataFrame(rows, "Id long, ranker_id long, selected int, v array<double>, fold int")
    return df.withColumn("features", array_to_vector("v"))


FAST = replace(B.RANKER, rounds=12, patience=4, learning_rate=0.2, num_leaves=7, min_data_in_leaf=5, bagging_freq=2)


def same(a: B.Fit, b: B.Fit):
    assert len(a.trees) == len(b.trees) and a.best_round == b.best_round and a.history == b.history
    for s, t in zip(a.trees, b.trees):
        assert all(np.array_equal(s[c], t[c]) for c in ("feature", "bin", "left", "right", "value", "count"))


def plain_lambdarank(score, y, starts, top):
    g, h = np.zeros(len(score)), np.zeros(len(score))
    for lo, hi in zip(starts[:-1], starts[1:]):
        order = sorted(range(lo, hi), key=lambda i: (-score[i], i))
        d = {i: 1 / math.log2(r + 2) if r < top else 0.0 for r, i in enumerate(order)}
        p = int((y[lo:hi] == 1).sum())
        ideal = sum(1 / math.log2(r + 2) for r in range(min(p, top)))
        for i in range(lo, hi):
            for j in range(lo, hi):
                if y[i] == 1 and y[j] != 1:
                    w, rho = abs(d[i] - d[j]) / ideal, 1 / (1 + math.exp(score[i] - score[j]))
                    g[i] -= w * rho
                    g[j] += w * rho
                    h[i] += w * rho * (1 - rho)
                    h[j] += w * rho * (1 - rho)
    return g, h


@pytest.mark.parametrize("share", [0.05, 0.5])
def test_lambdarank_equals_all_pairs(share):
    rng = np.random.default_rng(1)
    starts = np.append(0, np.cumsum(rng.integers(1, 90, 25))).astype(np.int32)
    y = (rng.random(starts[-1]) < share).astype(float)
    score = np.round(rng.normal(size=len(y)), 1)
    for top in (3, 30):
        got, want = B.lambdarank(score, y, starts, top), plain_lambdarank(score, y, starts, top)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_best_split_equals_trying_all():
    rng = np.random.default_rng(2)
    width, p = np.array([5, 2, 4]), replace(B.RANKER, min_data_in_leaf=3, lambda_l1=0.2, lambda_l2=0.7)
    x = np.stack([rng.integers(0, w, 60) for w in width], 1)
    g, h = rng.normal(size=60), rng.random(60)
    sums = np.zeros((3, 1, 11))
    for f, off in enumerate((0, 5, 7)):
        for i in range(60):
            sums[:, 0, off + x[i, f]] += (g[i] * B.GRAIN, h[i] * B.GRAIN, 1)

    def worth(m):
        return max(abs(g[m].sum()) - 0.2, 0) ** 2 / (h[m].sum() + 0.7)

    best = max(((worth(m) + worth(~m) - worth(m | True), -f, -b) for f in range(3) for b in range(width[f] - 1)
                for m in [x[:, f] <= b] if m.sum() >= 3 and (~m).sum() >= 3))
    gain, column, bin_, left, whole = B.best_splits(sums, width, p)[0]
    assert gain == pytest.approx(best[0]) and (column, bin_) == (-best[1], -best[2])
    assert left[0] == pytest.approx(g[x[:, column] <= bin_].sum()) and whole[2] == 60


def test_models_alone_together_in_blocks_and_continued_are_the_same(spark):
    x = matrix(spark)
    one = B.bin_blocks(x, "fold")
    many = B.bin_blocks(x, "fold", block_rows=100, bounds=one.bounds)
    assert one.count == 1 and many.count > 5
    squared = replace(B.SQUARED, rounds=9, max_depth=3, learning_rate=0.3)
    specs = {("r", 0): (FAST, 0), ("r", 1): (FAST, 1), "q": (squared, 2), "s": (replace(FAST, objective="softmax", leaves_per_pass=1), None)}
    together = B.boost(one, {k: B.Fit(*s) for k, s in specs.items()})
    for k, s in specs.items():
        same(together[k], B.boost(one, {k: B.Fit(*s)})[k])
        same(together[k], B.boost(many, {k: B.Fit(*s)})[k])
        stopped = B.boost(one, {k: B.Fit(*s)}, rounds=3)
        same(together[k], B.boost(one, stopped)[k])
    assert len(together["s"].trees) == 12 and all((t["left"] == np.arange(len(t["left"]))).sum() <= 7 for t in together["s"].trees)
    # symmetric trees: one feature and bin per level
    for t in together["q"].trees:
        assert len({(f, b) for f, b, left in zip(t["feature"], t["bin"], t["left"]) if left == 1}) == 1


def test_stored_forest_scores_and_metrics_agree(spark):
    x = matrix(spark)
    blocks = B.bin_blocks(x, "fold")
    fit = B.boost(blocks, {0: B.Fit(FAST, 0)})[0]
    model = B.ForestModel(fit, blocks.bounds)
    held = x.filter("fold = 0")
    got = {r["Id"]: r["score"] for r in model.transform(held).collect()}
    for r in held.collect():
        s = 0.0
        for t in model.trees:
            n = 0
            while t["left"][n] != n:
                n = t["left"][n] if r["v"][t["feature"][n]] <= blocks.bounds[t["feature"][n]][t["bin"][n]] else t["right"][n]
            s += t["value"][n]
        assert got[r["Id"]] == pytest.approx(s, abs=1e-9)
    ev = M.evaluate(model.transform(held)).first()
    assert tuple(ev) == pytest.approx(M._rates(fit))
    assert fit.best > 0.6 and model.importances(list("abcd"))[0][0] == "a"


def test_two_thousand_trees_plan_in_no_time(spark):
    import time
    x = matrix(spark, 20)
    blocks = B.bin_blocks(x, "fold")
    fit = B.boost(blocks, {0: B.Fit(replace(FAST, rounds=2), None)})[0]
    fit.trees *= 1000
    model = B.ForestModel(fit, blocks.bounds)
    model.transform(x)                              # stores the forest and loads it
    t = time.perf_counter()
    plan = model.transform(x)._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - t < 2 and len(plan) < 5000


def test_cross_validation_and_search(spark):
    x = matrix(spark)
    cv = M.cross_validate(x, 3, params=FAST)
    assert cv.count() == 3 and min(r["hitrate_all"] for r in cv.collect()) > 0.5
    rows = M.search(x, 6, 3, at_once=2, params=replace(FAST, rounds=5)).collect()
    assert [r["trial"] for r in rows] == list(range(6))
    # a trial's score is that of the same trial alone
    p = {n: rows[4][n] for n in M.SEARCH_SPACE}
    alone = M.cross_validate(x, 3, params=replace(FAST, rounds=5, **p)).agg({"hitrate_all": "avg"}).first()[0]
    assert rows[4]["hitrate_all"] == pytest.approx(alone)


def test_no_rows_and_no_positives(spark):
    x = matrix(spark, 5)
    empty = B.fit_boosted(x.limit(0), params=replace(FAST, rounds=2))
    assert empty.trees == []
    none = B.fit_boosted(x.withColumn("selected", x["selected"] * 0), params=replace(FAST, rounds=2))
    assert none.trees == [] and none.transform(x).count() == x.count()


def test_greedy_deal_equals_going_session_by_session():
    from rankflow.operators.split import greedy_deal
    rng = np.random.default_rng(5)
    for k in (1, 2, 5, 7):
        for _ in range(60):
            sizes = sorted({int(s) for s in rng.integers(1, 40, rng.integers(1, 9))}, reverse=True)
            runs = [(s, int(rng.integers(1, 30))) for s in sizes]
            loads, want = [0] * k, []
            for s, n in runs:
                for _ in range(n):
                    j = loads.index(min(loads))
                    loads[j] += s
                    want.append(j)
            phases = greedy_deal(runs, k)
            bounds = [p[1] for p in phases[1:]] + [len(want)]
            got = [folds[(i - begin) % len(folds)] for (_, begin, folds), end in zip(phases, bounds) for i in range(begin, end)]
            assert got == want


def test_hot_category_in_slices(spark):
    """One category holds most rows and lies in many slices; codes equal the plain running sums."""
    import hashlib

    from rankflow.operators.encode import OrderedTargetEncoder
    rows = [(i, "hot" if i % 5 else f"c{i % 3}", [0, 1, None][i % 3] if i % 7 else 1) for i in range(400)] + [(400, None, 1)]
    df = spark.createDataFrame(rows, "Id long, c string, selected int")
    model, out = OrderedTargetEncoder(["c"]).fit_transform(df, slices=16)
    gm = np.mean([y for _, _, y in rows if y is not None])
    want, sums = {400: gm}, {}
    for i, c, y in sorted(rows[:400], key=lambda r: hashlib.md5(f"42_{r[0]}".encode()).hexdigest()):
        s, n = sums.get(c, (0, 0))
        want[i] = (s + gm * 10) / (n + 10)
        sums[c] = (s + (y or 0), n + (y is not None))
    assert {r["Id"]: r["c_target_ordered"] for r in out.collect()} == pytest.approx(want)
    assert model.global_mean == pytest.approx(gm)


def test_histogram_is_the_plain_sums():
    """The column-wise sums, also where Hessians are too large to carry the counts."""
    rng = np.random.default_rng(3)
    n, widths = 500, np.array([5, 9, 4])
    x = np.stack([rng.integers(0, w, n) for w in widths], 1).astype(np.uint8)
    row = {"x": x.tobytes(), "n": n, "y": np.zeros(n, np.int32).tobytes(), "starts": np.array([0, n], np.int32).tobytes(),
           "fold": np.zeros(1, np.int32).tobytes(), "noise": rng.integers(0, 1 << 60, n).tobytes()}
    cell = B._Cell(row, 3, 0)
    assert cell.x.flags.f_contiguous
    tree = B._Tree()
    tree.split(0, 1, 3, 1.0, (0.0, 1.0, 1.0), (0.0, 2.0, 2.0))
    fit, cols = B.Fit(B.SQUARED), np.array([0, 2])
    job = B._request(fit, tree, [2], cols)
    for size in (10, 1 << 50):
        g, h = rng.integers(-size, size, n).astype(float), rng.integers(0, size, n).astype(float)
        if size > 10:
            g, h = np.rint(g / n), np.rint(h / n)
        cell.gradients[0] = g, h
        got = B._histogram(cell, 0, job, widths)
        at = x[:, 1] > 3
        for k, v in enumerate((g, h, np.ones(n))):
            want = [v[at & (x[:, c] == b)].sum() for c in cols for b in range(widths[c])]
            assert got[k, 0].tolist() == want


@pytest.mark.parametrize("objective", ["lambdarank", "softmax"])
def test_sessions_longer_than_a_block_are_whole(spark, objective):
    """trees and validation sums do not depend on the rows that a block aims at."""
    x = matrix(spark, 40)
    x = x.selectExpr("Id", "ranker_id % 6 AS ranker_id", "selected", "features", "CAST(ranker_id % 3 AS INT) AS fold")      # long sessions, several positives in each
    one = B.bin_blocks(x, "fold")
    small = B.bin_blocks(x, "fold", block_rows=16, bounds=one.bounds)
    assert small.count > 10
    cells = [B._Cell(r, 4, 0) for r in small.table.collect()]
    assert sorted(n for c in cells for n in np.diff(c.starts)) == sorted(r["count"] for r in x.groupBy("ranker_id").count().collect())
    fits = [B.boost(b, {f: B.Fit(replace(FAST, objective=objective, rounds=5), f) for f in range(3)}) for b in (one, small)]
    for f in range(3):
        assert len(fits[0][f].trees) > 1
        same(fits[0][f], fits[1][f])


def test_passes_read_trained_rows_and_add_up_the_smaller_leaves(spark, monkeypatch):
    """F1-F8: a round's passes read drawn features and trained rows only, in few tasks, and one of two new leaves."""
    blocks = B.bin_blocks(matrix(spark), "fold", block_rows=100)
    cell = B._Cell(blocks.table.first(), 4, 0)
    plans = {k: (replace(FAST, seed=k, feature_fraction=0.5), f, None, 0, 0) for k, f in ((0, 0), (1, 1), (2, None))}
    work = B._Work(B._advance(cell, {}, plans), plans)
    assert len(work.x) == sum(map(bool, sum(B._bag(cell, p, f, 0).astype(int) for p, f, *_ in plans.values()))) < len(cell.x)
    for k, (p, f, *_) in plans.items():
        g, h = work.gradients[k]
        assert g.dtype == h.dtype == np.int32
        job = B._request(B.Fit(p, f), B._Tree(), [0], B._columns(p, 0, 4))
        widths = np.array([len(b) + 1 for b in blocks.bounds])
        got, rows = B._histogram(work, k, job, widths), B._bag(cell, p, f, 0)
        want = [v[rows & (cell.x[:, c] == b)].sum() for v in (*B._gradients(cell, k, p, f), np.ones(len(rows))) for c in job["cols"] for b in range(widths[c])]
        assert got.ravel().tolist() == want
    passes, run = [], B._pass

    def noted(work, jobs, *args):
        passes.append((work.getNumPartitions(), jobs[0]["leaves"] if jobs else []))
        return run(work, jobs, *args)

    monkeypatch.setattr(B, "_pass", noted)
    fit = B.boost(blocks, {0: B.Fit(replace(FAST, rounds=3), 0)})[0]
    assert blocks.count > 6 and max(n for n, _ in passes) <= spark.sparkContext.defaultParallelism
    assert sum(len(leaves) for _, leaves in passes) <= sum(1 + len(t["feature"]) // 2 for t in fit.trees)
    monkeypatch.setattr(B, "DRIVER_BYTES", 0)           # the sums meet on the executors
    same(fit, B.boost(blocks, {0: B.Fit(replace(FAST, rounds=3), 0)})[0])
