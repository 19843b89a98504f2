"""Whitening of embeddings: covariance on Spark, components by QDWH spectral
divide and conquer, whitened rows by a broadcast of the components.

Only sums over the vectors move: integer sums per dimension (exact), then the
products of the centred vectors, added up per row of the matrix. The matrix,
as many numbers as the square of a vector's length, is split on the driver. The
unitary polar factor of V - s*I, found by dynamically weighted Halley steps, is 1
on the eigenvectors above the shift s and -1 on those below; with I added and
halved it is the spectral projector of the upper ones. An orthonormal basis of its
range and of the rest turns V into two smaller matrices, and so on, down to single
components; parts that hold none of the wanted components are not split further.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parquet_stage
from .vectors import by_length, matrix

SCALE = 256
COMPONENTS = 4
SALTS = 64              # partial matrices of this many tasks' numbers meet first
EPS = float(np.finfo(float).eps)
_LONG = 1 << 63

RESULT = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


# ------------------------------------------------------------------ spectral divide and conquer

def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by QDWH: Halley steps
    weighted by a lower bound of the singular values, which reach 1 in about six
    steps whatever the condition; by QR while the weights are large, then by
    Cholesky's form."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 0.9 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n))
    except np.linalg.LinAlgError:
        low = 0.0
    low = float(min(1.0, max(low, EPS)))
    eye = np.eye(n)
    for _ in range(40):
        l2 = low * low
        d = (4 * (1 - l2) / l2 ** 2) ** (1 / 3)
        root = np.sqrt(1 + d)
        w = root + np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * root)) / 2
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
            new = b / c * x + (w - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            new = b / c * x + (w - b / c) * np.linalg.solve(eye + c * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        low = min(1.0, low * (w + b * l2) / (1 + c * l2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= (5 * EPS) ** (1 / 3) * np.sqrt(n) and abs(1 - low) < 1e-12:
            break
    return x


def _split(a: np.ndarray, shift: float, rng) -> tuple[np.ndarray, int, float]:
    """An orthonormal basis whose first ``k`` columns span the eigenvectors of
    ``a`` above ``shift``, ``k``, and how far the rest is from invariant."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if k in (0, n):
        return np.eye(n), k, np.inf
    upper = projector @ rng.standard_normal((n, k))
    lower = rng.standard_normal((n, n - k))
    lower -= projector @ lower
    q = np.linalg.qr(np.hstack([np.linalg.qr(upper)[0], np.linalg.qr(lower)[0]]))[0]
    # once more through the projector: what a random start left over goes
    q = np.linalg.qr(np.hstack([projector @ q[:, :k], q[:, k:] - projector @ q[:, k:]]))[0]
    return q, k, float(np.linalg.norm(q[:, k:].T @ a @ q[:, :k]))


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and
    their unit eigenvectors as rows. Equal eigenvalues get some orthonormal basis
    of theirs. The split at the mean eigenvalue always parts a matrix whose
    eigenvalues differ; if it lies on an eigenvalue, shifts nearby are tried and
    the one whose parts are nearest to invariant is taken."""
    rng = np.random.default_rng(0)
    scale = np.linalg.norm(v)
    found: list[tuple[float, np.ndarray]] = []

    def divide(a: np.ndarray, basis: np.ndarray) -> None:
        n = len(a)
        mean = np.trace(a) / n
        spread = np.linalg.norm(a - mean * np.eye(n))
        if n == 1 or spread <= 4 * n * EPS * scale:
            found.extend((float(a[i, i]), basis[:, i]) for i in range(n))
            return
        best = None
        for part in (0.0, 0.07, -0.07, 0.19, -0.19, 0.31):
            q, k, error = _split(a, mean + part * spread / np.sqrt(n), rng)
            if 0 < k < n and (best is None or error < best[2]):
                best = q, k, error
                if error <= 8 * n * EPS * scale:
                    break
        if best is None:                    # no shift parts it: equal up to rounding
            found.extend((float(a[i, i]), basis[:, i]) for i in range(n))
            return
        q, k, _ = best
        for cols in (q[:, :k], q[:, k:]):   # the upper part first
            if len(found) < wanted:
                sub = cols.T @ a @ cols
                divide((sub + sub.T) / 2, basis @ cols)

    if scale > 0:
        divide((v + v.T) / 2, np.eye(len(v)))
    else:
        found.extend((0.0, e) for e in np.eye(len(v)))
    found.sort(key=lambda f: -f[0])
    vectors = np.array([f[1] / np.linalg.norm(f[1]) for f in found[:wanted]])
    # the eigenvalue that belongs to a unit vector, to the square of its error
    return np.array([e @ v @ e for e in vectors]), vectors


# ------------------------------------------------------------------ sums over the vectors

def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id, x`` with ``x = floor(scale * c)`` as longs. Rows whose vector is
    null, empty or holds a null, non-finite or, scaled, too large entry go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_length(batch, "vec"):
                if not part.num_rows or not len(part.column("vec").flatten()):
                    continue
                m = np.floor(scale * matrix(part.column("vec")))
                good = (np.abs(m) < 2.0 ** 62).all(1)
                x = m[good].astype(np.int64)
                ids = part.column("id").filter(pa.array(good))
                starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * m.shape[1])
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(starts, pa.array(x.ravel()))], names=["id", "x"])

    named = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return named.mapInArrow(run, f"id {named.schema['id'].dataType.simpleString()}, x array<long>")


def _longs(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _longs(batch.column("x"))
            # up to 2^20 rows of a batch stay below 2^63 if no entry reaches 2^42
            part = x.sum(0) if np.abs(x).max() < 1 << 42 else x.astype(object).sum(0)
            total = part.astype(object) if total is None else total + part.astype(object)
            count += len(x)
        if count:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(len(total), dtype=np.int32)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)),
                pa.array(np.full(len(total), count, np.int64))], names=["i", "s", "c"])

    rows = (fit.select("x").mapInArrow(run, "i int, s decimal(38,0), c long").groupBy("i")
            .agg(F.sum("s").alias("s"), F.sum("c").alias("c")).orderBy("i").collect())    # a row per dimension
    return rows[0]["c"], [int(r["s"]) for r in rows]


def _products(fit: DataFrame, dim: int, rows_of) -> np.ndarray:
    """Sum over all vectors of y y^T, where ``rows_of`` turns a batch's longs into
    rows ``y`` of length ``dim``. Tasks add up their own matrices; those are added
    on Spark row by row, in two steps, so that no task holds many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                y = rows_of(_longs(batch.column("x")))
                total += y.T @ y
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(dim, salt, np.int32)), pa.array(np.arange(dim, dtype=np.int32)),
            pa.ListArray.from_arrays(pa.array(np.arange(dim + 1, dtype=np.int32) * dim), pa.array(total.ravel()))],
            names=["salt", "i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.column("row").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        out = table.slice(0, 1)
        return out.set_column(out.schema.get_field_index("row"), "row", pa.array([rows.sum(0)], pa.list_(pa.float64())))

    parts = fit.select("x").mapInArrow(run, "salt int, i int, row array<double>")
    parts = parts.groupBy("salt", "i").applyInArrow(add, "salt int, i int, row array<double>")
    rows = parts.groupBy("i").applyInArrow(add, "salt int, i int, row array<double>").orderBy("i").collect()  # the matrix
    return np.array([r["row"] for r in rows])


def _fit(rows: DataFrame, dim: int, wanted: int) -> dict:
    """Everything that whitening vectors of length ``dim`` needs: a few numbers
    per dimension and component."""
    fit = parquet_stage(rows.select("x").distinct(), "whiten-fit")
    n, sums = _sums(fit)
    mean = np.array([s / n for s in sums])
    cov = _products(fit, dim, lambda x: x - mean) / n
    values, axes = components(cov, wanted)
    trace = float(np.trace(cov))
    real = values > dim * EPS * max(trace, 0.0)         # the others are zero but for rounding
    map_ = np.where(real[:, None], axes / np.sqrt(np.where(real, values, 1.0))[:, None], np.nan)
    error = None
    if real.any():
        used = map_[real]
        k = len(used)
        # the mean of the whitened vectors as it came out, then their covariance around it
        ones = lambda x: np.hstack([(x - mean) @ used.T, np.ones((len(x), 1))])     # noqa: E731
        centre = _products(fit, k + 1, ones)[k, :k] / n
        error = float(np.abs(_products(fit, k, lambda x: (x - mean) @ used.T - centre) / n - np.eye(k)).max())
    explained = [float(v) / trace if trace > 0 else None for v in values]
    return {"n": n, "sums": sums, "mean": mean, "map": map_, "explained": explained, "error": error}


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 of each row, exact; null if it does not fit a long."""
    if n * int(np.abs(x).max()) + max(map(abs, sums)) < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(d).max()) ** 2 < _LONG:
            return (d * d).sum(1).tolist()
        d = d.astype(object)
    else:
        d = n * x.astype(object) - np.array(sums, object)
    return [int(s) if s < _LONG else None for s in (d * d).sum(1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           wanted: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """For each row with a usable vector and each of the first ``wanted``
    components (all, if the vectors are shorter): ``id_col, component`` (from 1),
    ``n`` (distinct vectors), ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``.

    Vectors that are null, empty, or hold null or non-finite entries (or such
    that do not fit a long when scaled) are left out. Repeated rows are whitened
    each, but count once in the fit. Vectors of each length are a population of
    their own, fitted one after the other. A component without variance has
    ``whitened`` null, and ``identity_error`` is taken over the others (null if
    there are none); ``deviation`` is null if it does not fit a long. An empty
    table gives an empty one; other columns are ignored."""
    rows = parquet_stage(quantised(vectors, id_col, vec_col, scale), "whiten-rows")
    id_type = rows.schema["id"].dataType.simpleString()
    out = None
    for (dim,) in rows.select(F.size("x")).distinct().collect():
        some = rows.filter(F.size("x") == dim)
        one = some.mapInArrow(_whitener(_fit(some, dim, min(wanted, dim))), f"id {id_type}, {RESULT}")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], f"id {id_type}, {RESULT}")
    return out.withColumnRenamed("id", id_col)


def _whitener(model: dict):
    """The job that whitens batches; ``model`` goes to the tasks with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model["map"])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _longs(batch.column("x"))
            deviation = pa.array(_deviations(x, model["n"], model["sums"]), pa.int64())
            y = (x - model["mean"]) @ model["map"].T
            for c in range(k):
                yield pa.RecordBatch.from_arrays([
                    batch.column("id"), pa.array(np.full(len(x), c + 1, np.int32)), pa.array(np.full(len(x), model["n"], np.int64)),
                    deviation, pa.array(y[:, c], mask=np.isnan(y[:, c])), pa.array([model["explained"][c]] * len(x), pa.float64()),
                    pa.array([model["error"]] * len(x), pa.float64())],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run
