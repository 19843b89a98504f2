import random

import xxhash

from rankflow.llm import simhash
from rankflow.llm.components import components

from .helpers import awkward_texts, documents


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(values, limit=2):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= limit:
                parent[find(b)] = find(a)
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def planted(seed, n=60):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        v = rng.getrandbits(64)
        out.add(v)
        for _ in range(rng.randrange(6)):      # chains of small steps
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            out.add(v)
    return sorted(out)


def groups(pairs):
    out = {}
    for node, root in pairs:
        out.setdefault(root, set()).add(node)
    return sorted(map(sorted, out.values()))


def test_links_equal_brute_force_on_both_ways(spark):
    values = planted(1)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = [g for g in groups((signed(a), r) for a, r in reach(values).items()) if len(g) > 1]
    for crowd in (simhash.CROWD, 0):
        got = groups((r["node"], r["component"]) for r in components(simhash.link(fps, 2, crowd)).collect())
        assert got == want


def test_documents_equal_brute_force(spark):
    texts = awkward_texts(2)
    docs = documents(spark, texts)
    fps = {i: plain(t) for i, t in enumerate(texts)}
    root = reach(set(fps.values()))
    low = {}
    for i, v in fps.items():
        low[root[v]] = min(low.get(root[v], i), i)
    got = {r["id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (signed(v), low[root[v]]) for i, v in fps.items()}
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept == sorted(low.values())


def test_null_ids_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "p q r s"), (3, "p q r s"), (None, "p q r s")],
                                 "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 5
    assert sorted((r["doc_id"] is None, r["text"]) for r in simhash.keep_one(docs).collect()) == [(False, "p q r s"), (True, "a b c d")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_allocation_is_unequal_where_it_pays():
    import numpy as np
    cost = np.array([[0, 1, 2, 3], [0, 50, 60, 70], [0, 50, 60, 70.0]])
    t = simhash.allocate(cost, 2)
    assert sum(x + 1 for x in t) == 3 and t == [2, -1, -1]
