"""Blocks of documents, and which of their keys also occur elsewhere.

Documents are dealt once into blocks of a few megabytes, stored as a table that
is bucketed by block, so that later passes read each block where it lies. In a
pass a block sends its distinct keys, sorted and cut by hash bucket, to the
buckets; a bucket finds the keys that occur more than once and returns to each
block one bit per key. A key of any frequency is sent once per block, so hot
passages need no special case.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.session import note_scratch

from .common import parquet_stage, scratch_path, small_batches

BLOCK_BYTES = 4 << 20       # text of a block aimed at
BUCKET_BYTES = 24 << 20     # text per hash bucket: bounds what one bucket sorts
REQUEST = "blk int, bucket int, keys binary, many binary"
REPLY = "blk int, bucket int, bits binary, note binary"


@dataclass
class Blocks:
    rows: DataFrame         # blk, id, text, row
    buckets: int


def block_table(docs: DataFrame, id_col: str, text_col: str, carry: list[str] = ()) -> Blocks:
    """``docs`` as a stored table of blocks. ``row`` is a struct of ``carry``."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("blk"),
                       F.col(id_col).alias("id"), F.col(text_col).alias("text"), row.alias("row"))
    # as many files as a bucketed table may have, a whole number of blocks in each
    files = min(n, 50_000)
    name = f"blocks_{uuid.uuid4().hex}"
    spark = docs.sparkSession
    path = scratch_path(spark, name)
    (rows.repartition(files, "blk").write.format("parquet").option("compression", "zstd").bucketBy(files, "blk")
     .option("path", path).saveAsTable(name))
    note_scratch(path, name)
    return Blocks(spark.table(name), max(1, total // BUCKET_BYTES))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows of an (n, lanes) array, the row of each input row
    among them, and which occur more than once."""
    order = np.lexsort(keys.T[::-1])
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return s[first], inverse, np.diff(np.append(first, len(s))) > 1


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys[:, 0] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def requests(blk: int, keys: np.ndarray, many: np.ndarray, buckets: int) -> pa.Table:
    """A block's distinct keys as one row per bucket."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < len(keys) else None
    if cuts is None:
        used, start = np.unique(bucket[order], return_index=True)
        spans = list(zip(used.tolist(), start.tolist(), [*start[1:].tolist(), len(order)]))
    else:
        spans = [(b, cuts[b], cuts[b + 1]) for b in range(buckets) if cuts[b + 1] > cuts[b]]
    rows = [(b, keys[order[x:y]].tobytes(), np.packbits(many[order[x:y]]).tobytes()) for b, x, y in spans]
    return pa.table({"blk": pa.array([blk] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
                     "keys": pa.array([r[1] for r in rows], pa.binary()), "many": pa.array([r[2] for r in rows], pa.binary())})


def note(blk: int, index: np.ndarray, mask: np.ndarray) -> pa.Table:
    """What a block tells its own next pass, sent along with its requests."""
    return pa.table({"blk": pa.array([blk], pa.int32()), "bucket": pa.array([-1 - blk], pa.int32()),
                     "keys": pa.array([index.astype(np.int32).tobytes()], pa.binary()),
                     "many": pa.array([np.packbits(mask).tobytes()], pa.binary())})


def answer_index(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each distinct key's bit is in the block's replies, taken in the
    order of their buckets, each filled up to whole bytes."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    used, start, size = np.unique(bucket[order], return_index=True, return_counts=True)
    padded = np.cumsum(-(-size // 8) * 8) - (-(-size // 8) * 8)
    index = np.empty(len(keys), np.int64)
    index[order] = np.arange(len(keys)) + np.repeat(padded - start, size)
    return index


def answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's reply bits in that order, and its note (index, packed mask)."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), table.column("note").to_pylist()))
    bits = b"".join(b for k, b, _ in rows if k >= 0)
    index, mask = next(((i, m) for k, i, m in rows if k < 0), (b"", b""))
    return (np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool), np.frombuffer(index, np.int32), np.frombuffer(mask, np.uint8))


def replies(requested: DataFrame, lanes: int) -> DataFrame:
    """For each request a bit per key: does it occur more than once in all?
    Notes come back as they are."""
    def resolve(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"),
                             "bits": table.column("keys"), "note": table.column("many")})
        parts = [np.frombuffer(k, np.uint64).reshape(-1, lanes) for k in table.column("keys").to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)).astype(bool)
                               for m, p in zip(table.column("many").to_pylist(), parts)])
        found, inverse, again = distinct(np.concatenate(parts))
        again |= np.bincount(inverse, many, len(found)) > 0
        bits = np.split(again[inverse], np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"),
                         "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()),
                         "note": pa.nulls(len(parts), pa.binary())})

    return parquet_stage(requested.groupBy("bucket").applyInArrow(resolve, REPLY), "block-replies")


def unpack(table: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The replies of a block as a mask over its distinct keys."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    got = dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))
    size = np.bincount(bucket, minlength=1)
    used = np.flatnonzero(size)
    out = np.empty(len(keys), bool)
    if len(used):
        out[order] = np.concatenate([np.unpackbits(np.frombuffer(got[b], np.uint8), count=n).astype(bool)
                                     for b, n in zip(used.tolist(), size[used].tolist())])
    return out


def texts(table: pa.Table) -> list[bytes]:
    """UTF-8 texts of a block; null is empty."""
    return [b"" if t is None else t for t in table.column("text").cast(pa.binary()).to_pylist()]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Rolling:
    """Hashes of any stretch of a sequence of random 64-bit values, from prefix
    sums of value * base^position (mod 2^64) and the inverse powers."""

    BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

    def __init__(self, values: np.ndarray, lane: int):
        base = self.BASES[lane]
        n = len(values)
        power, inverse = _POWERS.get(base, (np.zeros(0, np.uint64),) * 2)
        if len(power) < n + 1:
            size = max(n + 1, 1 << 20)
            power, inverse = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            power[0] = inverse[0] = 1
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            _POWERS[base] = power, inverse
        self.inverse = inverse
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Positions below ``n`` that windows of ``width`` from ``starts`` cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0
