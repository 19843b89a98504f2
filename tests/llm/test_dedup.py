import random

import pytest

from rankflow.llm.parsing import repeated_strings
from rankflow.llm.recompression import recompress, repeated_substrings

from .helpers import awkward_texts, documents, repeats


@pytest.mark.parametrize("window", [5, 35])
def test_repeated_words_match_brute_force(spark, window):
    texts = awkward_texts()
    seqs = [tuple((t or "").encode().split()) for t in texts]
    want = {}
    for i, (s, gone) in enumerate(zip(seqs, repeats(seqs, window))):
        want[i] = (len(s), sum(gone), b" ".join(w for w, g in zip(s, gone) if not g).decode())
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in
           repeated_substrings(documents(spark, texts), window=window).collect()}
    assert got == want
    assert any(n for _, n, _ in want.values())


def test_repeated_words_carry_and_empty(spark):
    docs = documents(spark, awkward_texts())
    rows = repeated_substrings(docs, carry=docs.columns).select("id", "row.*").collect()
    assert sorted((r["doc_id"], r["kept"], r["size"]) for r in rows) == [(i, "clash", 1) for i in range(docs.count())]
    assert repeated_substrings(docs.limit(0)).count() == 0


def test_recompression_contexts_decide_names():
    """A name whose context lies in a stretch comes back wherever the stretch does."""
    import numpy as np
    rng = random.Random(3)
    for trial in range(60):
        alphabet = rng.choice([2, 4, 50])
        stretch = [rng.randrange(1, alphabet + 1) for _ in range(60)]
        def around():
            return [rng.randrange(1, alphabet + 1) for _ in range(rng.randrange(40))]
        found = []
        for _ in range(2):
            left = around()
            whole = left + stretch + around()
            s = recompress(np.array(whole, np.uint64), np.zeros(len(whole), np.int64))
            inside = (s.left >= len(left)) & (s.right <= len(left) + 60)
            found.append({(int(n), int(a) - len(left), int(b) - len(left)) for n, a, b in
                          zip(s.name[inside], s.left[inside], s.right[inside])})
        assert {n for n, _, _ in found[0]} == {n for n, _, _ in found[1]}, trial


@pytest.mark.parametrize("window", [40, 200])
def test_repeated_bytes_match_brute_force(spark, window):
    texts = awkward_texts(1)
    data = [(t or "").encode() for t in texts]
    want = {}
    for i, (s, gone) in enumerate(zip(data, repeats(data, window))):
        kept = bytes(b for b, g in zip(s, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want[i] = (len(s), sum(gone), spans, kept)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], len(r["starts"]), bytes(r["kept"])) for r in
           repeated_strings(documents(spark, texts), window=window).collect()}
    assert got == want
    assert any(n for _, n, _, _ in want.values())


def test_repeated_bytes_of_copies_with_edits(spark):
    """Copies that differ here and there leave many ends of repeats to settle."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = [base]
    for _ in range(12):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    data = [t.encode() for t in texts]
    want = {i: bytes(b for b, g in zip(s, gone) if not g) for i, (s, gone) in enumerate(zip(data, repeats(data, 200)))}
    got = {r["id"]: bytes(r["kept"]) for r in repeated_strings(documents(spark, texts)).collect()}
    assert got == want


def test_common_passage_is_spread_over_buckets(spark, monkeypatch):
    """One passage in every document, between texts that differ: no bucket of a
    pass has much more to settle than the others, and the result stays exact."""
    from pyspark.sql import functions as F

    from rankflow.llm import blocks, parsing
    rng = random.Random(9)
    def noise(n):
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(400)
    texts = [noise(250) + passage + noise(250) for _ in range(900)]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 50_000)
    stages, store = [], parsing.parquet_stage
    def spy(df, name):
        stages.append((name, store(df, name)))
        return stages[-1][1]
    monkeypatch.setattr(parsing, "parquet_stage", spy)
    monkeypatch.setattr(blocks, "parquet_stage", spy)
    got = {r["id"]: bytes(r["kept"]) for r in repeated_strings(documents(spark, texts)).collect()}
    data = [t.encode() for t in texts]
    assert got == {i: bytes(b for b, g in zip(s, gone) if not g) for i, (s, gone) in enumerate(zip(data, repeats(data, 200)))}
    seen = 0
    for name, df in stages:
        if "bits" in df.columns:
            sizes = [r["n"] for r in df.groupBy("bucket").agg(F.sum(F.octet_length("bits")).alias("n")).collect()]
            seen += 1
            assert max(sizes) <= 3 * sum(sizes) / len(sizes) + 200, (name, sorted(sizes)[-3:])
    assert seen >= 3


def test_repeated_rows_and_empty(spark):
    docs = documents(spark, ["word " * 3 + "abc " * 100, None, ""])
    twice = docs.unionByName(docs)
    rows = repeated_strings(twice).collect()
    assert len(rows) == 6
    assert {r["n_removed"] for r in rows if r["id"] == 0} == {415}
    assert repeated_strings(docs.limit(0)).count() == 0
