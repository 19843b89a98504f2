"""Exact top-k inner products: columnar branch-and-bound.

Vectors are cut into blocks that hold their components dimension by dimension.
A query's scores against a block accumulate over groups of dimensions; after
each group, a candidate whose score so far plus the largest product that the
remaining mass of both vectors allows (Cauchy-Schwarz) stays below the query's
threshold is dropped, and the rest is compacted for the next group. The
threshold is the best that is known of the query's k-th score: from a first
pass over a share of the vectors, from the blocks that the task has scanned
before, and from the block itself, whose k most promising candidates are scored
first. Vectors are dealt to blocks by their length (norm), and a block whose
longest vector can't reach the threshold of any query of a query block is not
scanned for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parquet_stage
from .vectors import by_length, matrix, usable

SCALE = 64
BLOCK = 4096          # candidates of a block
QUERY_BLOCK = 512     # queries of a block
GROUP = 8             # dimensions accumulated between two prunings
SEED_SHARE = 16       # one vector in this many, by the hash of its id, gives the first thresholds
TASKS_PER_CORE = 4    # of the candidates' side: a task scans several blocks and learns from each
KEPT_BLOCKS = 1024    # query blocks whose raised thresholds a task remembers
SLACK = 1 + 1e-9      # rounding allowed for in norms

_BLOCK = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("own", pa.binary()), ("data", pa.binary()), ("top", pa.float64())])
_BLOCK_SQL = "dim int, n int, ids binary, own binary, data binary, top double"


def blocks(vectors: DataFrame, rows: int, scale: int = SCALE) -> DataFrame:
    """``vectors(id, own, vec)`` as blocks of at most ``rows`` vectors of one length,
    ``data`` being their floor(scale * x) as doubles, one dimension after the other,
    ``own`` the query that a row is not compared with, and ``top`` the greatest norm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim):
            ids, own, m = (np.concatenate(x) for x in zip(*held[dim]))
            held[dim] = [(ids[rows:], own[rows:], m[rows:])]
            ids, own, m = ids[:rows], own[:rows], np.floor(scale * m[:rows])
            return pa.RecordBatch.from_pylist([{"dim": dim, "n": len(ids), "ids": ids.tobytes(), "own": own.tobytes(),
                                                "data": np.ascontiguousarray(m.T).tobytes(), "top": float(_norms(m).max())}], schema=_BLOCK)

        for batch in batches:
            for part in by_length(batch, "vec"):
                m = matrix(part.column("vec"))
                longs = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "own")]
                held.setdefault(m.shape[1], []).append((*longs, m))
                while sum(len(x[0]) for x in held[m.shape[1]]) >= rows:
                    yield block(m.shape[1])
        for dim in held:
            while sum(len(x[0]) for x in held[dim]):
                yield block(dim)

    return (vectors.mapInArrow(run, _BLOCK_SQL)
            .withColumn("no", F.monotonically_increasing_id()))


def _norms(m: np.ndarray) -> np.ndarray:
    """Of the rows; scaled first, so that large components do not overflow."""
    most = np.maximum(np.abs(m).max(1, initial=0.0), 1.0)
    return most * np.sqrt(((m / most[:, None]) ** 2).sum(1))


def _least_norm(queries: np.ndarray, lows: np.ndarray) -> float:
    """The norm below which a candidate reaches the threshold of none of the
    queries: a score is at most the product of both norms."""
    norms = _norms(queries)
    some = norms > 0
    if not some.all():      # all scores of a zero query are 0
        return -np.inf
    return float(((lows - 0.5) / norms).min() / SLACK) if (lows > 0.5).all() else -np.inf


def scan(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int,
         thresholds: np.ndarray, group: int = GROUP, own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (by position) the ids and scores that may belong to its
    ``k`` best: never fewer than its k best of this block at or above its
    threshold. ``queries``: one row each; ``data``: one row per dimension;
    ``own``: the query that a candidate is left out for (by default its id)."""
    dim = data.shape[0]
    own = ids if own is None else own
    cuts = [*range(0, dim, group), dim]
    # mass that is left from each cut on; integers, so half a unit covers rounding
    rest_q = [np.sqrt((queries[:, c:] ** 2).sum(1)) for c in cuts[:-1]]
    rest_c = [np.sqrt((data[c:] ** 2).sum(0)) for c in cuts[:-1]]
    first = queries[:, :cuts[1]] @ data[:cuts[1]]
    for q in range(len(queries)):
        at = np.flatnonzero(own != query_ids[q])
        score = first[q, at]
        threshold = thresholds[q]
        for g in range(1, len(cuts) - 1):
            bound = score + rest_q[g][q] * rest_c[g][at] * (1 + 1e-12) + 0.5
            if g == 1 and len(at) > k:
                # the block's own k-th best is at least the least of any k scores
                first_k = np.argpartition(bound, -k)[-k:]
                known = score[first_k] + queries[q, cuts[1]:] @ data[cuts[1]:, at[first_k]]
                threshold = max(threshold, known.min())
            alive = bound >= threshold
            if not alive.all():
                at, score = at[alive], score[alive]
            if not len(at):
                break
            score = score + queries[q, cuts[g]:cuts[g + 1]] @ data[cuts[g]:cuts[g + 1], at]
        keep = score >= threshold
        at, score = at[keep], score[keep]
        if len(at) > k:
            # the k best, ties to the smaller id
            best = np.lexsort((ids[at], -score))[:k]
            at, score = at[best], score[best]
        yield q, ids[at], score


def _wrapped(m: np.ndarray) -> np.ndarray:
    """Whole numbers as longs, modulo 2^64."""
    if np.abs(m).max() < 2.0 ** 63:
        return m.astype(np.int64)
    return np.array([int(x) & (1 << 64) - 1 for x in m.ravel()], np.uint64).view(np.int64).reshape(m.shape)


def scan_integers(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int,
                  thresholds: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``scan`` for blocks with large components. Products of longs are right
    modulo 2^64, so right where the sum of the terms' sizes says that they fit;
    the other pairs are worked out with integers of any size."""
    own = ids if own is None else own
    with np.errstate(over="ignore", invalid="ignore"):
        fits = np.abs(queries) @ np.abs(data) < 2.0 ** 62
        scores = _wrapped(queries) @ _wrapped(data)
    for q in range(len(queries)):
        at = np.flatnonzero(own != query_ids[q])
        score, sure = scores[q, at], fits[q, at]
        if sure.all():
            if np.isfinite(thresholds[q]):      # a threshold above 2^53 may have been rounded up
                keep = score >= int(np.floor(np.nextafter(thresholds[q], -np.inf)))
                at, score = at[keep], score[keep]
            best = np.lexsort((ids[at], -score))[:k]
            yield q, ids[at[best]], score[best]
        else:
            mine = [int(x) for x in queries[q]]
            exact = [int(v) if ok else sum(a * int(b) for a, b in zip(mine, data[:, i]))
                     for i, v, ok in zip(at.tolist(), score.tolist(), sure.tolist())]
            best = sorted(range(len(at)), key=lambda i: (-exact[i], ids[at[i]]))[:k]
            kept = [exact[i] for i in best]
            if any(abs(v) >= 1 << 63 for v in kept):
                raise ValueError("a score among the best does not fit a long")
            yield q, ids[at[best]], np.array(kept, np.int64)


def _pairs(query_blocks: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The stated queries against the candidates, block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raised: dict[tuple[int, int], np.ndarray] = {}      # by length and first id of the query block
        for batch in batches:
            for r in batch.to_pylist():
                qids = np.frombuffer(r["q_ids"], np.int64)
                queries = np.ascontiguousarray(np.frombuffer(r["q_data"]).reshape(r["dim"], -1).T)
                ids, own, data = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["own"], np.int64), np.frombuffer(r["data"]).reshape(r["dim"], -1)
                block = (r["dim"], int(qids[0]))
                lows = raised.get(block)
                if lows is None:
                    lows = np.frombuffer(r["lows"]).copy() if r["lows"] else np.full(len(qids), -np.inf)
                    if len(raised) >= KEPT_BLOCKS:
                        raised.clear()
                    raised[block] = lows
                elif r["top"] < _least_norm(queries, lows):
                    continue
                # doubles hold all sums exactly below 2^53
                look = scan if np.abs(queries).max() * np.abs(data).max() * r["dim"] < 2.0 ** 53 else scan_integers
                out = [(np.full(len(got), qids[q]), got, score) for q, got, score in look(queries, qids, data, ids, k, lows, own=own)]
                for q, (_, got, score) in enumerate(out):
                    if len(got) >= k:
                        # not above the exact score, which a double may not hold
                        lows[q] = max(lows[q], np.nextafter(float(score[k - 1]), -np.inf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out]).astype(np.int64)), pa.array(np.concatenate([x[1] for x in out]).astype(np.int64)),
                     pa.array(np.concatenate([x[2] for x in out]).astype(np.int64))], names=["query_id", "vec_id", "score"])

    q = query_blocks.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "lows", "need")
    # blocks, not rows, are paired; an equality of lengths as the join key would
    # send all blocks to one task
    pairs = (candidates.select("dim", "ids", "own", "data", "top").crossJoin(q)
             .filter((F.col("dim") - F.col("q_dim") == 0) & (F.col("top") >= F.col("need"))).drop("q_dim", "need"))
    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK, each_row: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each usable row that ``is_query``
    marks, the ``k`` highest inner products of floor(scale * x) with the other
    usable rows of the same length, ties to the smaller id; fewer if there are
    fewer. Null vectors, empty ones and those with null or non-finite
    components take no part, nor do rows without an id. Rows that repeat an id
    are candidates of their own, but never of a query with that id, and such a
    query is answered once; with ``each_row`` every marked row is a query of its
    own, answered on its own, and only that row is left out of its candidates.
    Scores are exact; only one among a query's best of a
    block that does not fit a long is an error."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    v = vectors.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    if each_row:
        # equal rows have equal answers: they are searched for once, and one of them is left out
        asking = parquet_stage(v.filter("asks").groupBy("id", "vec").agg(F.count(F.lit(1)).alias("n"))
                               .withColumn("query", F.monotonically_increasing_id()), "topk-asking")
        copies = asking.select("id", "vec", "query", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
        v = v.filter(~F.col("asks")).select("id", F.lit(-1).cast("long").alias("own"), "vec").unionByName(
            copies.select("id", F.when(F.col("copy") == 1, F.col("query")).otherwise(F.lit(-1)).alias("own"), "vec"))
        queries = asking.select(F.col("query").alias("id"), F.col("query").alias("own"), "vec")
    else:
        # the vectors of a query id: one of them asks (its rows are equal or the first by value)
        queries = v.filter("asks").groupBy("id").agg(F.min("vec").alias("vec")).select("id", F.col("id").alias("own"), "vec")
        v = v.select("id", F.col("id").alias("own"), "vec")
    # vectors of like norms share blocks; ties are dealt by hash
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda n, x: n + x * x))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (v.select("id", "own", "vec", norm.alias("norm")).repartitionByRange(parts, F.col("norm").desc(), F.xxhash64("id"))
             .sortWithinPartitions(F.col("norm").desc()).select("id", "own", "vec"))
    stored = parquet_stage(blocks(dealt, block, scale), "topk-blocks")
    asked = parquet_stage(blocks(queries, query_block, scale), "topk-queries").withColumnRenamed("no", "q_no")
    # blocks are even in size, so dealing them out one by one spreads the work
    tasks = TASKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    candidates = stored.repartition(max(1, min(stored.count(), tasks)), "no")
    plain = asked.withColumns({"lows": F.lit(None).cast("binary"), "need": F.lit(float("-inf"))})
    seeds = parquet_stage(blocks(v.filter(F.pmod(F.xxhash64("id"), F.lit(SEED_SHARE)) == 0).select("id", "own", "vec"), block, scale), "topk-seeds")
    lows = _best(_pairs(plain, seeds, k), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("low"))
    lows = parquet_stage(lows, "topk-lows")

    def attach(key, left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("query_id").to_pylist(), right.column("low").to_pylist()))
        rows = left.to_pylist()
        for r in rows:
            # a score above 2^53 may have been rounded up
            low = np.array([np.nextafter(float(known[i]), -np.inf) if i in known else -np.inf for i in np.frombuffer(r["ids"], np.int64).tolist()])
            r["lows"] = low.tobytes()
            r["need"] = _least_norm(np.frombuffer(r["data"]).reshape(r["dim"], -1).T, low)
        return pa.Table.from_pylist(rows, schema=pa.schema([*_BLOCK, ("lows", pa.binary()), ("need", pa.float64())]))

    numbers = asked.select("q_no", "ids").mapInArrow(_members, "query_id long, q_no long")
    with_lows = (asked.groupBy("q_no").cogroup(lows.join(numbers, "query_id").groupBy("q_no"))
                 .applyInArrow(attach, f"{_BLOCK_SQL}, lows binary, need double"))
    best = _best(_pairs(parquet_stage(with_lows, "topk-asked"), candidates, k), k)
    if each_row:
        times = asking.select(F.col("query").alias("query_id"), F.col("id").alias("asked_by"), F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
        best = best.join(times, "query_id").drop("query_id").withColumnRenamed("asked_by", "query_id")
    return best.select("query_id", "rank", "vec_id", "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for no, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.full(len(got), no))], names=["query_id", "q_no"])
