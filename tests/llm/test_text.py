import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rankflow.llm import language, mixing, resampling, warc

from .helpers import awkward_texts, documents, words


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 300_000 + "</p>"
    rows = [(7, "u", "same" * 40), (3, "u", "same" * 40), (9, None, "same" * 40), (1, "a\r\nb", "short"), (2, "u", "short"),
            (4, "u", None), (5, "u", ""), (6, "u", long), (8, "u", "é" * 50), (10, "u", "é" * 50), (None, "u", "same" * 40),
            (3, "u", "same" * 40), (11, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "b" * 99)]
    pages = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, record_type string, payload_bytes int")
    got = warc.round_trip(pages, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in by["3"]] == ["response", "response"]
    for k in ("7", "9", None):
        assert (by[k][0]["record_type"], by[k][0]["refers_to"], by[k][0]["payload"]) == ("revisit", "3", None)
    assert (by["10"][0]["record_type"], by["10"][0]["refers_to"]) == ("revisit", "8")
    for i, _, html in rows:
        r = by[None if i is None else str(i)][0]
        assert r["payload_bytes"] == len((html or "").encode())
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == (html or "")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_members_and_damage():
    row = {"id": 1, "url": "u", "payload": b"p" * 700_000, "payload_bytes": 700_000, "record_type": "response",
           "payload_digest": __import__("hashlib").sha256(b"p" * 700_000).hexdigest(), "refers_to": None}
    member = warc.encode_record(row)
    assert gzip.decompress(member + member).count(b"WARC/1.1") == 2
    found = list(warc.read_records(io.BytesIO(member * 3)))
    assert len(found) == 3 and warc.parse_record(*found[2])["payload_bytes"] == 700_000
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(member + member[:-20])))
    headers, block = found[0]
    with pytest.raises(warc.DamagedArchive):
        warc.parse_record(headers, block[:-1] + b"q")
    z = zlib.compressobj(wbits=31)
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(z.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") + z.flush())))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language.identify(docs.filter(held), language.fit(docs.filter(~held))).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) > 0.93 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_many_copies_is_learned(spark):
    """100,000 rows of 50 distinct texts: each of the 50 enters the dictionary."""
    row = F.concat(F.lit("kopie "), F.translate((F.col("id") % 50).cast("string"), "0123456789", "abcdefghij"))
    docs = (spark.range(100_000).select(F.col("id").alias("doc_id"), row.alias("text"), F.lit("de").alias("lang"))
            .unionByName(spark.createDataFrame([(-1, "the only English text", "en")], "doc_id long, text string, lang string")))
    found = language.fit(docs)
    assert found["en"] == b"the only english text"
    assert sorted(found["de"].split(b"\n")) == sorted({b"kopie " + bytes(ord("a") + int(c) for c in str(i)) for i in range(50)})


def test_language_sample_is_the_smallest_hashes(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.translate(
        F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("xx").alias("lang"))
    want = [r["text"] for r in docs.orderBy(F.xxhash64("text")).limit(40).collect()]
    assert language.fit(docs, sample_docs=40)["xx"].decode().split("\n") == want


def test_language_awkward_cases(spark):
    docs = documents(spark, [*awkward_texts(), "123 456 !", None]).withColumn("score", F.lit("clash"))
    found = language.identify(docs, language.fit(docs)).collect()
    assert len(found) == docs.count()
    for r in found:
        unknown = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == unknown and (not unknown or r["rejected"])
        assert r["lang_pred"] in ("und", "en", "de")
    assert language.fit(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    one = language.classifier({"en": b"the of and"})
    assert one("words") == ("en", 1.0, 1.0)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = []
    for source, n in (("a", 300), ("b", 20), ("é", 5), ("z", 1), (None, 40), ("empty", 3)):
        rows += [(len(rows) + k, "" if source == "empty" else words(rng, rng.randrange(0, 40)), source, 9) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    decided, taken = mixing.plan_mix(docs)
    got = decided.collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    source = {r[0]: r[2] for r in rows}
    mixed = {}
    for r in got:
        s = source[r["id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-12)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        mixed[s] = mixed.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(mixed[s] - want[s]) <= 40
    assert sum(mixed.values()) <= sum(sizes.values())
    again = {r["id"]: r["taken"] for r in mixing.plan_mix(docs.repartition(7))[0].collect()}
    assert again == {r["id"]: r["taken"] for r in got}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_mix_awkward_cases(spark):
    docs = documents(spark, awkward_texts())
    twice = docs.unionByName(docs).withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    decided, _ = mixing.plan_mix(twice)
    assert decided.count() == twice.count()
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix_documents(blank).count() == 0 and mixing.plan_mix(blank)[0].count() == docs.count()


def test_resampling_model_and_selection(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["sun", "moon", "star", "sky"]) for _ in range(30)) for _ in range(60)]
    junk = [" ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "WIN!!"]) for _ in range(30)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, i < 20, "x", 0) for i, t in enumerate(good + junk)], "doc_id long, text string, good boolean, key string, selected int")
    got = resampling.select(docs, F.col("good")).collect()
    assert {r["id"] for r in got if r["selected"]} == set(range(60))
    assert len(got) == 120
    # the counts and weights by hand
    import numpy as np
    h = resampling.Hasher(resampling.BUCKETS)
    raw, target = np.ones(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for i, t in enumerate(good + junk):
        c = np.bincount(h(t), minlength=resampling.BUCKETS)
        raw += c
        target += c * (i < 20)
    raw /= raw.sum()
    ratio = np.log((target + 1000 * raw) / (target.sum() + 1000) / raw)
    for r in got:
        assert r["log_weight"] == pytest.approx(resampling.LENGTH * ratio[h((good + junk)[r["id"]])].mean())


def test_target_marks_are_bounded(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("_target"))
    good = spark.createDataFrame([(i,) for i in [*range(30), 3, None]], "doc_id long")
    assert resampling.mark_target(docs, good).filter("_target").count() == 30
    few = {r["doc_id"] for r in resampling.mark_target(docs, good, most=7).filter("_target").collect()}
    assert len(few) == 7 and few <= set(range(30))
    assert resampling.mark_target(docs, good.limit(0)).filter("_target").count() == 0


@pytest.mark.parametrize("k", [0, 1, 3, 7, 8, 50])
def test_top_k_is_exact(spark, k):
    keys = [5.0, 5.0, -1.5, float("-inf"), float("inf"), 5.0, 0.25, None]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key double")
    got = {r["id"] for r in resampling.top_k(rows, "key", ["id"], k).collect() if r["selected"]}
    rank = sorted(range(len(keys)), key=lambda i: (-(keys[i] if keys[i] is not None else float("-inf")), i))
    assert got == set(rank[:k])


def test_top_k_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 2.0), (2, 2.0), (None, 2.0)], "id long, key double")
    got = [(r["id"], r["selected"]) for r in resampling.top_k(rows, "key", ["id"], 2).collect()]
    assert sorted(got, key=str) == sorted([(1, True), (1, True), (1, False), (2, False), (None, False)], key=str)


def test_resampling_awkward_cases(spark):
    docs = documents(spark, awkward_texts()).withColumn("good", F.col("doc_id") < 3)
    docs = docs.unionByName(docs.limit(2)).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    assert resampling.select(docs, F.col("good")).count() == docs.count()
    assert resampling.select(docs.limit(0), F.col("good")).count() == 0
    assert resampling.select(docs, F.lit(None).cast("boolean")).count() == docs.count()
