"""Quality selection by importance resampling of hashed n-grams.

Two bag-of-n-grams models over hashed buckets are counted: the target (texts
labelled good) and the raw corpus (all documents). A document's log weight is
the mean over its n-grams of log(target / raw), scaled to a common length so
that long texts are not decided by length alone. Adding Gumbel noise to the
log weights and keeping the k largest keys draws k documents without
replacement in proportion to their weights. The k-th largest key is found by
radix selection over counts, so nothing is sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parquet_stage

BUCKETS = 16_384        # hashed n-grams share this many counters
PRIOR = 1_000.0         # n-grams of the raw model that the target's counts start from
LENGTH = 64.0           # n-grams that a document's mean log ratio stands for
BINS = 4_096            # counters of one selection pass
TARGET_DOCS = 20_000    # at most this many labelled documents make the target model
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


class Hasher:
    """Buckets of a text's words, punctuation marks and pairs of neighbours."""

    def __init__(self, buckets: int):
        import regex
        self.split = regex.compile(TOKENS).findall
        self.buckets = buckets
        self.codes: dict[str, int] = _Codes()

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = self.split(text) if text else []
        if len(self.codes) > 500_000:
            self.codes.clear()
        one = np.fromiter(map(self.codes.__getitem__, tokens), np.uint64, len(tokens))
        # the pair (a, b) mixes both codes; the multiplier keeps it ordered
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        two ^= two >> np.uint64(29)
        two *= np.uint64(0xBF58476D1CE4E5B9)
        two ^= two >> np.uint64(32)
        return (np.concatenate([one, two]) % np.uint64(self.buckets)).astype(np.int64)


class _Codes(dict):
    def __missing__(self, token):
        self[token] = code = xxhash.xxh64_intdigest(token, 7)
        return code


def count_ngrams(docs: DataFrame, text_col: str, target: Column, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, raw, target``: n-gram counts over all rows, and over those for
    which ``target`` holds. Every task adds up its own rows first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, is_target in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(hasher(text.as_py()), minlength=buckets)
                raw += found
                if is_target:
                    good += found
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(good)],
                                         names=["bucket", "raw", "target"])

    src = docs.select(F.col(text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    return (src.mapInArrow(run, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """The model: log(target share / raw share) per bucket (``buckets`` numbers).
    The target's counts start from ``prior`` n-grams dealt as in the raw model,
    so what the target has not shown is judged mildly, the less it has shown in all."""
    raw, good = np.ones(buckets), np.zeros(buckets)
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["target"]
    raw /= raw.sum()
    return np.log((good + prior * raw) / (good.sum() + prior)) - np.log(raw)


def weigh(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          seed: str = "resample", length: float = LENGTH) -> DataFrame:
    """``id, log_weight, key``: ``key`` = log weight + Gumbel noise drawn from a
    hash of seed and id (of the text where the id is null), so reruns agree.
    A text without n-grams weighs minus infinity: it is chosen last."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        hasher = Hasher(len(ratios))
        for batch in batches:
            weights, noise = [], []
            for text, unit in zip(batch.column(1), batch.column(2).to_pylist()):
                grams = hasher(text.as_py())
                weights.append(length * ratios[grams].mean() if len(grams) else -np.inf)
                u = (xxhash.xxh64_intdigest(f"{seed}:{unit}") + 0.5) / 2.0 ** 64
                noise.append(-np.log(-np.log(u)))
            w = np.array(weights, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(w + np.array(noise))],
                                             names=["id", "log_weight", "key"])

    unit = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), unit.alias("unit"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, log_weight double, key double")


def top_k(rows: DataFrame, key: str, tie: list[str], k: int) -> DataFrame:
    """``rows`` with ``selected``: true for the ``k`` largest ``key`` (all, if
    there are fewer; null and NaN come last), equal keys by the smaller numeric
    ``tie``. The k-th key is found by radix selection (``_border``); among rows
    of just that key the same search goes on over ``tie``. Only rows equal in
    all of these are cut by a plain limit."""
    number = F.expr(f"CASE WHEN {key} IS NULL OR isnan({key}) THEN double('-infinity') ELSE {key} + 0.0D END")
    rows = rows.withColumn("_key", number)
    border, left = _border(rows, k)
    sure = rows.filter(F.col("_key") != border).withColumn("selected", F.col("_key") > border)
    at = rows.filter(F.col("_key") == border)
    if left <= 0 or at.count() <= left:
        return rows.withColumn("selected", F.col("_key") >= border if left > 0 else F.col("_key") > border).drop("_key")
    if tie:
        names = at.columns
        settled = top_k(at.withColumn("_tie", -F.col(tie[0]).cast("double")), "_tie", tie[1:], left).select(
            *[c for c in names if c != "_key"], "selected")
    else:
        first = at.limit(left)
        settled = first.withColumn("selected", F.lit(True)).unionByName(
            at.exceptAll(first).withColumn("selected", F.lit(False))).drop("_key")
    return sure.drop("_key").unionByName(settled)


def _border(rows: DataFrame, k: int) -> tuple[float, int]:
    """The k-th largest ``_key`` and how many of the rows that have it belong
    to the first k. Each pass counts the keys inside the interval of the k-th
    one by ``BINS`` sub-intervals; that many counters reach the driver."""
    inf = float("inf")
    x = F.col("_key")
    finite = ~x.isin(-inf, inf)
    most, n, low, high = rows.agg(F.count_if(x == inf), F.count_if(finite), F.min(F.when(finite, x)), F.max(F.when(finite, x))).first()
    if k <= most:
        return inf, k
    if k > most + n:
        return -inf, k - most - n
    left = k - most
    while low < high:
        place = F.least(F.floor((F.lit(high) - x) / ((high - low) / BINS)), F.lit(BINS - 1))
        found = (rows.filter(x.between(low, high)).groupBy(place.alias("bin"))
                 .agg(F.count("*").alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).orderBy("bin").collect())
        for r in found:
            if left <= r["n"]:
                break
            left -= r["n"]
        low, high = r["lo"], r["hi"]
        if left == r["n"]:      # the whole interval belongs: its smallest key is the k-th
            return low, rows.filter(x == low).count()
    return low, left


def mark_target(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", most: int = TARGET_DOCS,
                mark: str = "_target") -> DataFrame:
    """``docs`` with ``mark``: is the row one of the target's documents? These
    are the ``most`` ids of ``good`` with the smallest hashes (null ids are
    none); so bounded, they are broadcast, and no text moves."""
    some = good.select(F.col(id_col).alias("_id")).filter("_id IS NOT NULL").distinct()
    some = some.orderBy(F.xxhash64("_id"), "_id").limit(most).withColumn(mark, F.lit(True))
    cols = [F.col(c) for c in docs.columns if c != mark]
    return docs.select(*cols).join(F.broadcast(some), F.col(id_col) == F.col("_id"), "left").select(
        *cols, F.coalesce(mark, F.lit(False)).alias(mark))


def select(docs: DataFrame, target: Column, k: int | None = None, id_col: str = "doc_id", text_col: str = "text",
           seed: str = "resample") -> DataFrame:
    """``id, log_weight, key, selected``. ``target`` marks the rows whose texts
    are the target; a null mark means no. Without ``k`` as many documents are
    drawn as the corpus is expected to have of the target's kind: the number of
    rows whose log weight is not negative. Repeated rows are drawn independently but
    with the same noise; an empty table gives no rows; without target rows all
    weights are 0."""
    model = log_ratios(count_ngrams(docs, text_col, target))
    weighed = parquet_stage(weigh(docs, model, id_col, text_col, seed), "resample-keys")
    if k is None:
        k = weighed.filter("log_weight >= 0").count()
    return top_k(weighed, "key", ["id"], k)
