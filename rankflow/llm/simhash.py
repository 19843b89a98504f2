"""SimHash near-dedup with the generalised pigeonhole principle.

A document's fingerprint has a bit set if more than half of its shingles'
hashes have it set. Fingerprints at ``max_bits`` or fewer differing bits are
linked. The search works on distinct fingerprints: the 64 bits are cut into
partitions, bits that vary together in one partition, and each partition i gets
a threshold t_i of its own with sum(t_i + 1) = max_bits + 1. Two fingerprints
within ``max_bits`` are then within t_i of each other in some partition i; a
partition with t_i = -1 is not searched. Dynamic programming picks the
thresholds that give the fewest candidates and probes, estimated from counts
over all fingerprints. Every fingerprint is stored under its value in each
searched partition and probes all values within t_i; candidates are verified.

A value that very many fingerprints share is not searched that way. Its
fingerprints are linked through their neighbours: two fingerprints within two
bits of each other are within one bit of a third one (for other even limits:
within half the limit), so grouping by all one-bit changes gives the same components
with a number of rows in proportion to the fingerprints, whatever the crowd.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, parquet_stage, small_batches
from .components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
CROWD = 64              # a partition value with more fingerprints is linked through neighbours
PIECE = 1 << 16         # shingles hashed at a time


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """SimHash of a text: ASCII upper case lowered, words between ASCII white
    space, shingles of ``words`` words joined by blanks, repeats included; a
    shorter text is one shingle; without words 0."""
    split = text.encode("utf-8", "replace").lower().split() if text else []
    if not split:
        return 0
    n = max(1, len(split) - words + 1)
    joined = b" ".join(split)
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(words, len(split)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i:i + PIECE], ends[i:i + PIECE])], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(set_bits * 2 > n).tolist())


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE, carry: list[str] = ()) -> DataFrame:
    """``rid`` (row number), ``id, fp`` (signed 64-bit) and ``row`` (struct of ``carry``)."""
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"),
                      F.col(text_col).alias("text"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps), batch.column(3)], names=["rid", "id", "fp", "row"])
        give_back()

    kind = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(run, f"rid long, id long, fp long, row {kind}")


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set, over all of ``fp``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False))
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4096)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(64, 64)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def partition_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal size (to one), each grown from the
    freest bit by the bits that correlate most with the group."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = set(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [min(left, key=lambda b: (sum(corr[b, c] for c in left), b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (sum(corr[b, c] for c in group), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def candidate_estimates(groups: list[list[int]], p: np.ndarray, same: list[float], n: int, max_bits: int) -> np.ndarray:
    """cost[i, t + 1]: probes and expected candidates of one fingerprint in
    partition i at threshold t. Exact matches are counted (``same``: the mean
    number of fingerprints per fingerprint with its value); each further
    differing bit adds the odds that a bit of the partition differs."""
    cost = np.zeros((len(groups), max_bits + 2))
    for i, group in enumerate(groups):
        agree = p[group] ** 2 + (1 - p[group]) ** 2
        odds = (1 - agree) / agree
        terms = [1.0]          # elementary symmetric sums: patterns of 0, 1, ... differing bits
        for t in range(1, max_bits + 1):
            terms.append(sum(float(np.prod(odds[list(c)])) for c in combinations(range(len(group)), t)))
        for t in range(max_bits + 1):
            probes = sum(comb(len(group), d) for d in range(t + 1))
            cost[i, t + 1] = probes + min(n, same[i] * sum(terms[:t + 1]))
    return cost


def allocate(cost: np.ndarray, max_bits: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = max_bits + 1 of the least total
    cost, by dynamic programming over the partitions."""
    parts, budget = cost.shape[0], max_bits + 1
    best = np.full((parts + 1, budget + 1), np.inf)
    pick = np.zeros((parts + 1, budget + 1), int)
    best[0, 0] = 0
    for i in range(parts):
        for used in range(budget + 1):
            for t in range(used + 1):
                total = best[i, used - t] + cost[i, t]
                if total < best[i + 1, used]:
                    best[i + 1, used], pick[i + 1, used] = total, t
    out, used = [], budget
    for i in range(parts, 0, -1):
        out.append(int(pick[i, used]) - 1)
        used -= pick[i, used]
    return out[::-1]


def _value(fp: Column, group: list[int]) -> Column:
    """The group's bits of ``fp``, left where they are."""
    mask = sum(1 << b for b in group)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _changes(bits: list[int], most: int) -> Column:
    """Array of masks: all ways to change at most ``most`` of ``bits``."""
    masks = [_signed(sum(1 << b for b in c)) for d in range(most + 1) for c in combinations(bits, d)]
    return F.array(*[F.lit(m).cast("long") for m in masks]) if len(masks) < 200 else F.from_json(
        F.lit("[" + ",".join(map(str, masks)) + "]"), "array<bigint>")


def _probe(part: int, value: Column):
    return lambda mask: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(mask).alias("value"))


def link(fps: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (``fps.fp``) whose
    components are those of all links at ``max_bits`` or fewer bits."""
    fps = parquet_stage(fps.select("fp").distinct(), "simhash-fps")
    joint, n = bit_statistics(fps), fps.count()
    p = np.diag(joint) / max(n, 1)
    parts = max_bits + 1
    groups = partition_bits(joint, n, parts)
    values = [_value(F.col("fp"), g) for g in groups]
    same = []
    for v in values:
        r = fps.groupBy(v.alias("v")).agg(F.count("*").alias("c")).agg(
            F.sum(F.col("c").cast("double") * F.least("c", F.lit(crowd))), F.sum("c")).first()
        same.append((r[0] or 0.0) / max(r[1] or 0, 1))
    limits = allocate(candidate_estimates(groups, p, same, n, max_bits), max_bits)
    searched = [(i, g, t) for i, (g, t) in enumerate(zip(groups, limits)) if t >= 0]
    stored = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), values[i].alias("value")) for i, _, _ in searched])).alias("at")).select("fp", "at.part", "at.value")
    crowds = stored.groupBy("part", "value").count().filter(F.col("count") > crowd).drop("count")
    crowds = parquet_stage(crowds, "simhash-crowds")
    probes = fps.select("fp", F.explode(F.concat(*[
        F.transform(_changes(g, t), _probe(i, values[i])) for i, g, t in searched])).alias("at")).select("fp", "at.part", "at.value")
    thin = stored.join(crowds, ["part", "value"], "left_anti").withColumnRenamed("fp", "b")
    met = probes.withColumnRenamed("fp", "a").join(thin, ["part", "value"])
    pairs = met.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    # whoever probes or fills a crowded value: links through common neighbours
    crowded = probes.join(crowds, ["part", "value"], "left_semi").select("fp").distinct()
    return pairs.distinct().unionByName(_through_neighbours(crowded, max_bits, max_bits // 2))


def _through_neighbours(fps: DataFrame, max_bits: int, radius: int) -> DataFrame:
    """Two fingerprints within ``max_bits`` share a neighbour within ``radius``
    of both (radius >= max_bits / 2). For even limits all fingerprints around a
    neighbour are within the limit of each other, so they are linked to the
    smallest of them. Odd limits have no such neighbours."""
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    near = fps.select("fp", F.explode(F.transform(_changes(list(range(64)), radius),
                                                  lambda m: F.col("fp").bitwiseXOR(m))).alias("near"))
    low = near.groupBy("near").agg(F.min("fp").alias("low"), F.count("*").alias("n")).filter("n > 1").select("near", "low")
    return near.join(low, "near").filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``id, fp, component_id``, a row per input row. Null and empty texts have
    fingerprint 0 and are linked like any other; rows without an id are linked
    but never name a component that has another id (it is null only if no row
    of it has an id). Repeated rows share their component. An empty table gives
    no rows. Other columns play no part."""
    marked = parquet_stage(fingerprints(docs, id_col, text_col, words), "simhash-docs")
    return marked.join(_groups(marked, max_bits), "fp").select("id", "fp", "component_id")


def _groups(marked: DataFrame, max_bits: int) -> DataFrame:
    """``fp, group`` (a fingerprint of the component) and ``component_id``."""
    first = parquet_stage(marked.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    found = components(link(first, max_bits))
    named = first.join(found, first["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("group"))
    lows = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    return named.join(lows, "group").select("fp", "group", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, a row
    without an id only where none has one, the first of repeated rows."""
    cols = list(docs.columns)
    marked = parquet_stage(fingerprints(docs, id_col, text_col, words, cols), "simhash-docs")
    groups = _groups(marked.select("id", "fp"), max_bits)
    stays = (marked.select("rid", "id", "fp").join(groups, "fp").groupBy("group")
             .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first")).select("first.rid"))
    return marked.select("rid", "row").join(stays, "rid", "left_semi").select(*[F.col("row")[c].alias(c) for c in cols])
