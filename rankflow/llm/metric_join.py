"""Embedding near-duplicates: an exact metric range join.

Vectors are scaled to unit length, so that a cosine of at least c means a
Euclidean distance of at most r = sqrt(2 - 2c). Pivots taken from the data cut
the space into cells, a vector belonging to its nearest pivot. A vector also
visits another cell q if it can have a partner there: by the triangle
inequality its distance to q's pivot is at most the cell's radius + r, and its
distance to the border between both cells, (d(x,q)^2 - d(x,p)^2) / 2 d(p,q),
is at most r. Of two cells only one hosts the visits. Cells are joined
independently. A cell is cut into blocks of bounded size along the distance to
its pivot, and its block pairs are separate tasks, so a crowded cell costs many
tasks and no long one. Two blocks whose distances to the pivot are more than r
apart do not meet; when blocks meet, the rows of one are compared with those of
the other whose distances to the first pivots differ by at most r.

Equal vectors are one class from the start, and a block pair yields link counts
and a star per cluster, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parquet_stage
from .components import components
from .vectors import by_length, matrix, usable

MIN_COSINE = 0.9
BLOCK = 8192            # vectors of a block; ROWS of them are compared at once
PAIR_COST, VISIT_COST = 3e-9, 2e-5   # seconds for a pair's distance and a visit's shuffle, for choosing the number of pivots
MIN_PIVOTS = 4          # fewer only if there are fewer different vectors
MAX_PIVOTS = 512        # pivots are broadcast: at most this many vectors
ROW_PIVOTS = 16         # pivots, the most distant ones, by which rows of two blocks are compared
ROWS = 256              # rows of a block that are compared at once
BINS = 64               # of a cell's distances, which are 2 at most
SAMPLE = 8192           # rows from which the pivots are chosen
SLACK = 1e-9            # rounding allowed for in cosines
FAR_SLACK = 1e-7        # and in distances: the root of a cosine's rounding


def _unit(m: np.ndarray) -> np.ndarray:
    # scaled first, so that huge or tiny components neither overflow nor vanish
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, key, unit`` of the vectors that take part: unit vector as bytes,
    and a digest that equal vectors share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "vec"):
                m = matrix(part.column("vec"))
                some = np.abs(m).max(1) > 0
                units = [u.tobytes() for u in _unit(m[some] + 0.0)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").filter(pa.array(some)), pa.array([hashlib.blake2b(u, digest_size=16).digest() for u in units], pa.binary()),
                     pa.array(units, pa.binary())], names=["id", "key", "unit"])

    v = vectors.filter(usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec"))
    return v.mapInArrow(run, "id long, key binary, unit binary")


def choose_pivots(units: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of a sample: pivots far from one another."""
    chosen = [0]
    far = ((units - units[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(units)):
        nxt = int(far.argmax())
        if far[nxt] <= SLACK:
            break
        chosen.append(nxt)
        far = np.minimum(far, ((units - units[nxt]) ** 2).sum(1))
    return units[chosen]


def count_pivots(units: np.ndarray, pivots: np.ndarray, n: int, r: float) -> int:
    """How many of the ``pivots`` (in their order) to use for ``n`` vectors like
    ``units``: the power of two of the least expected cost. Pivots save pairs
    where the data are clustered; where distances are all alike (isotropic data
    of many dimensions) nearly every vector would visit half of the cells, and
    few pivots are cheaper."""
    scale, costs = n / len(units), {}
    k = min(MIN_PIVOTS, len(pivots))
    while k <= len(pivots):
        d = _distances(units, pivots[:k])
        own = d.argmin(1)
        radii = np.zeros(k)
        np.maximum.at(radii, own, d.min(1))
        _, _, cell = visits(units, pivots[:k], radii, r)
        size, guests = np.bincount(own, minlength=k), np.bincount(cell, minlength=k)
        pairs = float((size * (size / 2 + guests)).sum()) * scale * scale
        costs[k] = pairs * PAIR_COST + len(cell) * scale * VISIT_COST
        k *= 2
    return min(costs, key=lambda c: (costs[c], c))


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def _hosts(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of cells p and q, does q host p's visitors? One of both does, evenly."""
    return ((p + q) % 2 == 0) == (q < p)


def visits(units: np.ndarray, pivots: np.ndarray, radii: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each vector, and (row, cell) of its visits."""
    d = _distances(units, pivots)
    own = d.argmin(1)
    between = _distances(pivots, pivots)
    near = d[np.arange(len(d)), own]
    border = (d ** 2 - near[:, None] ** 2) / np.maximum(2 * between[own], SLACK)
    go = (border <= r + FAR_SLACK) & (d <= radii[None, :] + r + FAR_SLACK) & _hosts(own[:, None], np.arange(len(pivots))[None, :])
    go[np.arange(len(d)), own] = False
    row, cell = np.nonzero(go)
    return own, row, cell


def links(a: np.ndarray, b: np.ndarray, min_cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) with cosine >= min_cosine; within one block each
    pair once. Products within rounding of the limit are summed again exactly."""
    import math
    g = a @ b.T
    i, j = np.nonzero(g >= min_cosine - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    close = np.flatnonzero(np.abs(g[i, j] - min_cosine) <= SLACK)
    if len(close):
        sure = np.ones(len(i), bool)
        for k in close.tolist():
            x, y = a[i[k]], b[j[k]]
            sure[k] = math.fsum(x * y) >= min_cosine * math.sqrt(math.fsum(x * x) * math.fsum(y * y))
        i, j = i[sure], j[sure]
    return i, j


def block_links(a: np.ndarray, b: np.ndarray, pivots: np.ndarray, r: float, min_cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """``links`` of two blocks, rows of ``a`` by rows of ``b`` that can be within
    r of them by their distances to the ``pivots``."""
    da, db = _distances(a, pivots), _distances(b, pivots)
    rows, cols = [], []
    for s in range(0, len(a), ROWS):
        part = da[s:s + ROWS]
        near = np.flatnonzero(((db >= part.min(0) - r - FAR_SLACK) & (db <= part.max(0) + r + FAR_SLACK)).all(1))
        if same:
            near = near[near > s]
        if not len(near):
            continue
        i, j = links(a[s:s + ROWS], b[near], min_cosine, False)
        i, j = i + s, near[j]
        if same:
            i, j = i[i < j], j[i < j]
        rows.append(i)
        cols.append(j)
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *cols])


def cut_cells(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """``sizes``: vectors per (cell, visitor, bin of the distance). First and last
    block of each bin: neighbouring small bins share a block, a large one gets
    several, numbered from 0 in the order of the bins. A bin without vectors may
    have its first block after its last."""
    first, last = np.zeros(sizes.shape, np.int32), np.zeros(sizes.shape, np.int32)
    for c, v in np.ndindex(sizes.shape[:2]):
        at, room = -1, 0            # the block being filled, and how many it still takes
        for x, n in enumerate(sizes[c, v].tolist()):
            if n > room:
                first[c, v, x] = at + 1
                at += -(-n // block)
                room = block - n if n < block else 0
            else:
                first[c, v, x] = at if room else at + 1
                room -= n
            last[c, v, x] = at
    return first, last


def _bin(d: np.ndarray) -> np.ndarray:
    return np.clip(d * (BINS / 2), 0, BINS - 1).astype(np.int64)


def _stars(i: np.ndarray, j: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) for the clusters that the links make: at most one
    edge per node of the two blocks."""
    nodes, at = np.unique(np.concatenate([ids_a[i], ids_b[j]]), return_inverse=True)
    u, v = at[:len(i)], at[len(i):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    min_cosine: float = MIN_COSINE, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row per input row. Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with one another. Rows
    without an id count as copies of what they equal and are their own
    component (null, kept false). Rows that repeat an id and vector link with
    each other. ``pivots`` sets their number, else a sample does."""
    r = float(np.sqrt(2 - 2 * min_cosine))
    members = parquet_stage(classes(vectors, id_col, vec_col), "vectors")
    # a class is a node by its stored number, whether it has an id or not
    reps = parquet_stage(members.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
                         .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.octet_length("unit")), "vector-classes")
    edges, counts = [], []
    dims = [x[0] for x in reps.select("dim").distinct().collect()]
    for dim in sorted(dims):
        e, c = _join_dim(reps.filter(F.col("dim") == dim), r, min_cosine, block, pivots)
        edges.append(e)
        counts.append(c)
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("_vec"))
    if not dims:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.col("vec_id").isNotNull().alias("kept"))
    for e, c in zip(edges[1:], counts[1:]):
        edges[0], counts[0] = edges[0].unionByName(e), counts[0].unionByName(c)
    found = components(edges[0])
    linked = counts[0].groupBy("key").agg(F.sum("links").alias("links"))
    named = reps.join(found, "node", "left").select("key", "id", "weight", F.coalesce("component", "node").alias("group"))
    lows = named.groupBy("group").agg(F.min("id").alias("component_id"))
    by_class = (named.join(lows, "group").join(linked, "key", "left")
                .select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    joined = members.select("id", "key").join(by_class, "key").select("id", "n_links", "component_id")
    idle = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
            .filter(~_takes_part(F.col("vec"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return joined.unionByName(idle).select(F.col("id").alias("vec_id"), "n_links",
                                           F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
                                           F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _takes_part(vec):
    d = F.transform(vec, lambda x: x.cast("double"))
    return usable(vec) & F.coalesce(F.exists(d, lambda x: x != 0), F.lit(False))


def _join_dim(reps: DataFrame, r: float, min_cosine: float, block: int, count: int | None):
    """Edges between class representatives and link counts, for one length."""
    spark = reps.sparkSession
    n = reps.count()
    sample = reps.orderBy(F.xxhash64("key")).limit(SAMPLE).select("unit").collect()
    units = np.stack([np.frombuffer(x["unit"]) for x in sample])
    pivots = choose_pivots(units, count or min(MAX_PIVOTS, max(MIN_PIVOTS, n // block)))
    if not count:
        pivots = pivots[:count_pivots(units, pivots, n, r)]
    shared = spark.sparkContext.broadcast(pivots)

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, size = np.zeros(len(shared.value)), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            d = _distances(_units(batch.column("unit")), shared.value)
            own = d.argmin(1)
            np.maximum.at(most, own, d.min(1))
            np.add.at(size, own, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most))), pa.array(most), pa.array(size)], names=["cell", "radius", "size"])

    stats = {x["cell"]: x for x in reps.select("unit").mapInArrow(radii, "cell long, radius double, size long")
             .groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("size").alias("size")).collect()}
    radius = np.array([stats[i]["radius"] for i in range(len(pivots))])

    def places(batch: pa.RecordBatch):
        """Rows, cells, visitor or not and bins of a batch."""
        u = _units(batch.column("unit"))
        own, row, cell = visits(u, shared.value, radius, r)
        take, cells = np.concatenate([np.arange(len(u)), row]), np.concatenate([own, cell])
        guest = np.concatenate([np.zeros(len(u), np.int64), np.ones(len(row), np.int64)])
        return take, cells, guest, _bin(_distances(u, shared.value)[take, cells])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(shared.value), 2, BINS), np.int64)
        for batch in batches:
            _, cells, guest, bins = places(batch)
            np.add.at(seen, (cells, guest, bins), 1)
        at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at, seen[at])], names=["cell", "visitor", "bin", "n"])

    # at most MAX_PIVOTS x 2 x BINS rows
    sizes = np.zeros((len(pivots), 2, BINS), np.int64)
    for x in (reps.select("unit").mapInArrow(weigh, "cell long, visitor long, bin long, n long")
              .groupBy("cell", "visitor", "bin").agg(F.sum("n").alias("n")).collect()):
        sizes[x["cell"], x["visitor"], x["bin"]] = x["n"]
    cuts = spark.sparkContext.broadcast(cut_cells(sizes, block))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = cuts.value
        for batch in batches:
            take, cells, guest, bins = places(batch)
            low, high = first[cells, guest, bins], last[cells, guest, bins]
            # a key is a digest: its first bytes deal a large bin out
            digest = np.array([int.from_bytes(k[:4], "little") for k in batch.column("key").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(take)).columns, pa.array(cells.astype(np.int32)), pa.array(guest.astype(np.int32)),
                 pa.array((low + digest[take] % (high - low + 1)).astype(np.int32))],
                names=["key", "node", "weight", "unit", "cell", "visitor", "part"])

    dealt = reps.select("key", "node", "weight", "unit").mapInArrow(
        deal, "key binary, node long, weight long, unit binary, cell int, visitor int, part int")

    def pack(table: pa.Table) -> pa.Table:
        first, last = cuts.value
        cell = table.column("cell")[0].as_py()
        d = _distances(_units(table.column("unit")), shared.value[cell:cell + 1])[:, 0]
        table = table.take(pa.array(np.argsort(d, kind="stable")))      # rows of like distance together
        one = table.slice(0, 1)
        # the blocks that hold vectors within r of this one's, by the distance to the pivot
        low, high = _bin(np.array([d.min() - r - FAR_SLACK, d.max() + r + FAR_SLACK]))
        reach = {f"{end}{v}": pa.array([int(x[cell, v, at])], pa.int32()) for v in (0, 1) for end, x, at in (("low", first, low), ("high", last, high))}
        return pa.table({"cell": one.column("cell"), "visitor": one.column("visitor"), "part": one.column("part"),
                         "keys": [b"".join(table.column("key").to_pylist())], "nodes": [table.column("node").to_numpy().tobytes()],
                         "weights": [table.column("weight").to_numpy().tobytes()], "units": [b"".join(table.column("unit").to_pylist())], **reach})

    kind = ("cell int, visitor int, part int, keys binary, nodes binary, weights binary, units binary, "
            "low0 int, high0 int, low1 int, high1 int")
    packed = parquet_stage(dealt.groupBy("cell", "visitor", "part").applyInArrow(pack, kind), "vector-blocks")

    def others(visitor, low, high):
        return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda x: F.struct(F.lit(visitor).alias("visitor"), x.alias("part")))) \
                .otherwise(F.array().cast("array<struct<visitor:int,part:int>>"))

    # an owned block meets itself, the owned blocks after it, and the visitors' blocks, as far as they are in reach
    left = (packed.filter("visitor = 0")
            .withColumn("other", F.explode(F.concat(others(0, F.greatest("part", "low0"), F.col("high0")), others(1, F.col("low1"), F.col("high1"))))))
    a = left.select("cell", F.col("other.visitor").alias("visitor"), F.col("other.part").alias("part"), F.col("part").alias("a_part"),
                    *[F.col(c).alias(f"a_{c}") for c in ("keys", "nodes", "weights", "units")])
    pairs = a.join(packed.select("cell", "visitor", "part", "keys", "nodes", "weights", "units"), ["cell", "visitor", "part"])
    dim = pivots.shape[1]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                ua, ub = (np.frombuffer(x[c]).reshape(-1, dim) for c in ("a_units", "units"))
                na, nb, wa, wb = (np.frombuffer(x[c], np.int64) for c in ("a_nodes", "nodes", "a_weights", "weights"))
                i, j = block_links(ua, ub, shared.value[:ROW_PIVOTS], r, min_cosine, x["visitor"] == 0 and x["a_part"] == x["part"])
                if not len(i):
                    continue
                la = np.bincount(i, wb[j], len(na)).astype(np.int64)
                lb = np.bincount(j, wa[i], len(nb)).astype(np.int64)
                node, root = _stars(i, j, na, nb)
                keys = [x["a_keys"][16 * t:16 * t + 16] for t in np.flatnonzero(la)] + [x["keys"][16 * t:16 * t + 16] for t in np.flatnonzero(lb)]
                got = np.concatenate([la[la > 0], lb[lb > 0]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys + [None] * len(node), pa.binary()), pa.array([*got.tolist(), *[None] * len(node)], pa.int64()),
                     pa.array([*[None] * len(keys), *node.tolist()], pa.int64()), pa.array([*[None] * len(keys), *root.tolist()], pa.int64())],
                    names=["key", "links", "a", "b"])

    found = parquet_stage(pairs.select("visitor", "part", "a_part", "a_nodes", "a_weights", "a_units", "a_keys", "nodes", "weights", "units", "keys")
                          .mapInArrow(join, "key binary, links long, a long, b long"), "vector-links")
    return found.filter("a IS NOT NULL").select("a", "b"), found.filter("key IS NOT NULL").select("key", "links")


def _units(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values)).reshape(len(values), -1)
