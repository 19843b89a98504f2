import math
import random

from pyspark.sql import functions as F

from rankflow.llm.metric_join import near_duplicates
from rankflow.llm.topk import search

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label string, rank int, score int")


def awkward(seed, n=120, dim=12):
    rng = random.Random(seed)
    rows, i = [], 0
    def f32(v):
        import numpy as np
        return [float(np.float32(x)) for x in v]
    while len(rows) < n:
        v = [rng.gauss(0, 1) for _ in range(dim)]
        for _ in range(rng.choice([1, 1, 1, 6])):      # clusters
            rows.append((i, f32([x + rng.gauss(0, 0.12) for x in v])))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, rows[0][1]), (i + 2, None), (i + 3, []), (i + 4, [0.0] * dim), (i + 5, [1.0] + [None] * (dim - 1)),
             (i + 6, [NAN] * dim), (i + 7, [INF] * dim), (i + 8, [1.0, 2.0]), (i + 9, [2.0, 4.0]), (i + 10, [x * 4 for x in rows[1][1]])]
    return rows


def takes_part(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_topk_equals_brute_force(spark):
    rows = awkward(1)
    for k, block, query_block in ((20, 16, 8), (3, 4096, 512), (500, 50, 50)):
        want = {}
        q = {i: [math.floor(64 * x) for x in v] for i, v in rows if takes_part(v)}
        for i, v in q.items():
            if i % 5 == 0:
                scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q.items() if j != i and len(w) == len(v))
                want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(scored[:k])}
        got = search(vectors(spark, rows), F.col("vec_id") % 5 == 0, k, block=block, query_block=query_block).collect()
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want


def test_topk_of_large_components_is_exact(spark):
    """Scores between 2^53 and 2^63, terms beyond that cancel, and products with the query itself that fit no long."""
    rng = random.Random(8)
    rows = [[float(rng.randrange(-30_000_000, 30_000_000)) for _ in range(4)] for _ in range(40)]
    rows += [[1e7, 1e7, 2.0, 3.0], [3e15, -3e15, 1.0, 0.0], [5e15, 5e15, 0.5, 0.25], [1e30, 0.0, 0.0, 0.0], [0.0, 1.0, 2.0, 3.0]]
    chosen = {20, 40, 44}
    small = [i for i in range(len(rows)) if i not in (41, 42, 43)]
    for ids in (small, [20, 41, 42], [43, 44]):
        table = spark.createDataFrame([(i, rows[i]) for i in ids], "vec_id long, embedding array<double>")
        whole = {i: [math.floor(64 * x) for x in rows[i]] for i in ids}
        asks = F.col("vec_id").isin(*chosen) if len(ids) > 2 else F.col("vec_id") == 44
        want = []
        for i in ids:
            if (i in chosen) if len(ids) > 2 else i == 44:
                scores = sorted((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in ids if j != i)
                scores = [s for s in scores][:5]
                want += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
        if all(abs(s) < 1 << 63 for _, _, _, s in want):
            got = search(table, asks, 5, block=7, query_block=2).collect()
            assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
        else:
            assert len(ids) == 3


def test_topk_ties_repeats_and_empty(spark):
    same = [(i, [1.0, -0.5]) for i in range(8)] + [(3, [1.0, -0.5]), (None, [1.0, 1.0])]
    got = search(vectors(spark, same), F.col("vec_id") == 3, 4).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 0), (2, 1), (3, 2), (4, 4)]
    assert search(vectors(spark, same[:0]), F.col("vec_id") == 3).count() == 0


def test_topk_of_rows_that_repeat_an_id(spark, tmp_path):
    """op7: each row whose id is divisible by 20 is a query, and every other row a candidate, whatever its id."""
    rows = [(i, v) for i, v in awkward(3, 90) if v != []]
    rows += [rows[20], rows[20], rows[21], (40, rows[3][1]), (41, rows[40][1]), (60, None)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if takes_part(v)]
    want = []
    for n, (i, v) in enumerate(whole):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(whole) if m != n and len(w) == len(v))
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:20], 1)]
    from rankflow.llm.q_vectors import op7_exact_topk
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op7_exact_topk(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_topk_prunes_without_seeds_and_by_norm(spark):
    """No first thresholds: a block raises its own, and later ones are skipped by their norms."""
    import numpy as np
    from rankflow.llm import topk
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16) * (10.0 if i < 60 else 0.2)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.floor(64 * np.array([v for _, v in rows]))
    want = set()
    for i in range(0, 400, 20):
        scores = [(-int(whole[i] @ whole[j]), j) for j in range(400) if j != i]
        want |= {(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:5], 1)}
    share, topk.SEED_SHARE = topk.SEED_SHARE, 1 << 40
    try:
        got = search(table, F.col("vec_id") % 20 == 0, 5, block=16, query_block=4)
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == want
    finally:
        topk.SEED_SHARE = share
    # scored by one group of dimensions after the other, a block loses candidates without any threshold given
    data, ids = whole[:60].T, np.arange(60)
    for q, found, score in topk.scan(whole[:3], np.arange(3), np.ascontiguousarray(data), ids, 5, np.full(3, -np.inf), group=4):
        exact = sorted((-int(whole[q] @ whole[j]), j) for j in range(60) if j != q)[:5]
        assert [(-int(s), int(j)) for s, j in zip(score, found)] == exact
    lows = np.array([float(whole[q] @ whole[q]) / 2 for q in range(3)])
    least = topk._least_norm(whole[:3], lows)
    assert 0 < least and least > np.linalg.norm(whole[60:], axis=1).max()
    assert topk._least_norm(whole[:3] * 0, lows) == -np.inf


def brute_join(rows, limit):
    v = {i: x for i, x in rows if takes_part(x) and any(x)}
    norm = {i: math.sqrt(math.fsum(a * a for a in x)) for i, x in v.items()}
    links = {i: set() for i, _ in rows}
    for i in v:
        for j in v:
            if i < j and len(v[i]) == len(v[j]) and math.fsum(a * b for a, b in zip(v[i], v[j])) / (norm[i] * norm[j]) >= limit:
                links[i].add(j)
                links[j].add(i)
    low = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            m = min([low[i], *(low[j] for j in js)])
            for k in (i, *js):
                if low[k] > m:
                    low[k], changed = m, True
    return {i: (len(links[i]), low[i], i == low[i]) for i in links}


def test_join_equals_brute_force(spark):
    for seed, block, pivots in ((2, 2048, None), (3, 7, 12), (5, 7, None), (6, 7, 1)):
        rows = awkward(seed)
        got = near_duplicates(vectors(spark, rows), block=block, pivots=pivots).collect()
        assert len(got) == len(rows)
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == brute_join(rows, 0.9)


def test_join_crowd_nulls_and_empty(spark):
    rows = [(i, [1.0, 0.0, 0.001 * (i % 2)]) for i in range(50)] + [(None, [0.0, 1.0, 0.0]), (60, [0.0, 1.0, 0.0])]
    got = near_duplicates(vectors(spark, rows), block=8).collect()
    assert {(r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None and r["vec_id"] < 50} == {(49, 0)}
    assert sum(r["kept"] for r in got) == 2 and len(got) == 52
    assert near_duplicates(vectors(spark, rows[:0])).count() == 0
    assert [tuple(r) for r in near_duplicates(vectors(spark, [(5, None)])).collect()] == [(5, 0, 5, True)]


def test_join_classes_without_id_stay_apart(spark):
    rows = [(5, [1.0, 0.0, 0.0, 0.0]), (None, [1.0, 0.3, 0.0, 0.0]), (9, [0.0, 0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.3])]
    got = near_duplicates(vectors(spark, rows)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(5, 1, 5, True), (9, 1, 9, True), (None, 1, None, False)}


def test_cells_are_cut_along_the_distance():
    import numpy as np
    from rankflow.llm.metric_join import cut_cells
    sizes = np.zeros((1, 2, 8), np.int64)
    sizes[0, 0] = [0, 3, 4, 25, 0, 2, 8, 1]
    first, last = cut_cells(sizes, 10)
    assert first[0, 0].tolist()[1:] == [0, 0, 1, 4, 4, 4, 5] and last[0, 0].tolist() == [-1, 0, 0, 3, 3, 4, 4, 5]
    assert (last[0, 1] == -1).all()
    # every bin with vectors has blocks of its own range, and their order is that of the bins
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 40, (3, 2, 64)) * rng.integers(0, 2, (3, 2, 64))
    first, last = cut_cells(sizes, 16)
    assert (first[sizes > 0] <= last[sizes > 0]).all()
    assert (np.diff(first, axis=2) >= 0).all() and (np.diff(last, axis=2) >= 0).all()


def test_rows_out_of_reach_lose_no_link():
    import numpy as np
    from rankflow.llm import metric_join as M
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 8))
    u = M._unit(np.concatenate([c + 0.15 * rng.normal(size=(20, 8)) for c in centers]))
    r = float(np.sqrt(0.2))
    pivots = M.choose_pivots(u, 6)
    got = set(zip(*(x.tolist() for x in M.block_links(u, u, pivots, r, 0.9, True))))
    assert got == set(zip(*(x.tolist() for x in M.links(u, u, 0.9, True)))) and len(got) > 1000
    assert all(u[i] @ u[j] >= 0.9 - 1e-15 for i, j in got)


def test_join_query_equals_its_sql_on_linked_vectors(spark, tmp_path):
    """The registered query and its SQL on a table with clusters, chains, copies and a hot cluster."""
    import duckdb
    import numpy as np
    import pandas as pd
    from rankflow.llm.q_vectors import JOIN_SQL, op8_embedding_near_dedup
    rng = np.random.default_rng(9)
    rows = []
    for c in range(60):
        center = rng.normal(size=16)
        rows += [center + rng.choice([0.05, 0.25]) * rng.normal(size=16) for _ in range(int(rng.choice([1, 2, 5])))]
    hot = rng.normal(size=16)
    rows += [hot + 0.02 * rng.normal(size=16) for _ in range(100)]
    angle = np.linspace(0, 2.5, 15)                # a chain: only neighbours are linked
    rows += [np.cos(a) * np.eye(16)[0] + np.sin(a) * np.eye(16)[1] for a in angle] + [rows[0]] * 5
    order = rng.permutation(len(rows))
    pd.DataFrame({"vec_id": order, "embedding": [rows[i].astype(np.float32) for i in range(len(rows))]}).to_parquet(tmp_path / "embeddings.parquet")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in op8_embedding_near_dedup(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert got == sorted((int(a), int(b), int(c), bool(d)) for a, b, c, d in con.execute(JOIN_SQL).fetchall())
    assert sum(n > 0 for _, n, _, _ in got) > 150 and max(n for _, n, _, _ in got) >= 99
