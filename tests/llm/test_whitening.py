import math

import numpy as np
import pytest

from rankflow.llm import whitening as W
from rankflow.llm.q_vectors import op13_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "clash", 5) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors, wanted=4):
    """Per length: rows, n, deviations, eigenvalues and trace by numpy and integers of any size."""
    out = {}
    kept = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in enumerate(vectors)
            if v and all(c is not None and math.isfinite(c) for c in v)}
    for d in {len(x) for x in kept.values()}:
        rows = {i: x for i, x in kept.items() if len(x) == d}
        fit = sorted(set(rows.values()))
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[c - t / n for c, t in zip(x, s)] for x in fit])
        cov = z.T @ z / n
        values, axes = np.linalg.eigh(cov)
        out[d] = {"rows": rows, "n": n, "dev": {i: sum((n * c - t) ** 2 for c, t in zip(x, s)) for i, x in rows.items()},
                  "values": values[::-1][:wanted], "axes": axes.T[::-1][:wanted], "trace": np.trace(cov), "mean": np.array([t / n for t in s])}
    return out


def check(found, vectors):
    want = plain(vectors)
    rows = {(r["vec_id"], r["component"]): r for r in found}
    assert len(rows) == len(found) == sum(len(m["rows"]) * min(4, d) for d, m in want.items())
    for d, m in want.items():
        for c in range(min(4, d)):
            sign = None
            for i, x in m["rows"].items():
                r = rows[i, c + 1]
                assert (r["n"], r["deviation"]) == (m["n"], m["dev"][i] if m["dev"][i] < 2 ** 63 else None)
                if m["trace"] == 0:
                    assert (r["whitened"], r["explained"], r["identity_error"]) == (None, None, None)
                    continue
                if r["whitened"] is None:
                    assert m["values"][c] < 1e-10 * m["trace"]
                    continue
                assert r["explained"] == pytest.approx(m["values"][c] / m["trace"], rel=1e-9) and r["identity_error"] < 1e-9
                y = (np.array(x) - m["mean"]) @ m["axes"][c] / math.sqrt(m["values"][c])
                if sign is None and abs(y) > 1e-3:
                    sign = math.copysign(1, y * r["whitened"])
                assert r["whitened"] * (sign or 1) == pytest.approx(y, abs=1e-6)


def random_vectors(seed=0):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((120, 10)) * [3, 2.5, 2, 1.4, 1, .8, .5, .3, .2, .1] @ np.linalg.qr(rng.standard_normal((10, 10)))[0]
    out = [[float(c) for c in v] for v in m.astype(np.float32)]
    out += out[:7] + [None, [], [1.0] * 9 + [None], [math.nan] * 10, [math.inf] + [0.0] * 9, [-0.0] * 10, [0.001] * 10]
    return out


def test_against_numpy(spark):
    vectors = random_vectors()
    check(W.whiten(table(spark, vectors).repartition(6)).collect(), vectors)


def test_lengths_are_populations_of_their_own_and_flat_ones_have_no_variance(spark):
    vectors = random_vectors(1) + [[0.5, 0.25, 7.0]] * 3 + [[1.0], [2.0], [4.0]] + [[1.0, 1.0], [2.0, 2.0], [3.5, 3.5]]
    check(W.whiten(table(spark, vectors)).collect(), vectors)


def test_large_entries(spark):
    vectors = [[1e9, -3e9, 5.0], [2e9, 1e9, 1.0], [-7e8, 4e9, 9.0], [1e12, 0.0, 2.0], [3.0, 4.0, 5.0], [1e30, 0.0, 0.0]]
    want = plain(vectors[:5])[3]
    found = W.whiten(table(spark, vectors)).collect()
    assert {r["vec_id"] for r in found} == set(range(5))       # 256e30 fits no long
    assert {r["vec_id"]: r["deviation"] for r in found} == {i: v if v < 2 ** 63 else None for i, v in want["dev"].items()}


def test_empty_table(spark):
    out = W.whiten(table(spark, [None, []]))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, .5], [9, 9, 9, 1, 1, 1], [7, 3, 3, 3, 2, 0], [1e6, 1, 1e-6, 0, 0, 0], [4] * 6,
                                    [2, 1 + 1e-9, 1, 1 - 1e-9, .5, 0], [1, 1, 1, 1, 1, -5], list(2.0 ** -np.arange(40)),
                                    list(np.linspace(1, 2, 64)), [3.5, 3.5]])
def test_components_equal_numpys(values):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    v = q * np.array(values, float) @ q.T
    v = (v + v.T) / 2
    wanted = min(4, len(values))
    got, axes = W.components(v, wanted)
    assert got == pytest.approx(sorted(values, reverse=True)[:wanted], rel=1e-12, abs=1e-13 * max(map(abs, values)))
    assert np.abs(axes @ axes.T - np.eye(wanted)).max() < 1e-12
    assert np.abs(v @ axes.T - axes.T * got).max() < 1e-12 * max(map(abs, values))


def test_polar_factor():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    w, q = np.linalg.eigh(a)
    assert np.abs(W.polar(a) - q * np.sign(w) @ q.T).max() < 1e-12


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    found = op13_embedding_whitening(spark, "/root/testdata/sf0.01").collect()
    want = plain([list(r["embedding"]) for r in rows])[64]
    assert len(found) == 4 * len(rows) and {r["n"] for r in found} == {want["n"]} and max(r["identity_error"] for r in found) < 1e-9
    assert {r["vec_id"]: r["deviation"] for r in found} == want["dev"]
    for r in found:
        assert r["explained"] == pytest.approx(want["values"][r["component"] - 1] / want["trace"], rel=1e-9)
