"""Suffix-array dedup by prefix-free parsing.

A position is a trigger if the hash of the WORD bytes that begin there is 0
modulo RATE. Triggers cut a text into phrases, each from one trigger to the end
of the next one's bytes, and since a trigger depends on its own bytes only,
equal strings are cut alike. The distinct phrases are the dictionary, a text's
sequence of them is its parse.

A string of ``window`` bytes that holds a whole phrase occurring once cannot
start anywhere else; that rules out nearly all of the text that is not repeated.
The other window starts are taken together by the first trigger in their
window. If all the text around a trigger that its windows span occurs again
(by 128 bits of hash), all of them do. What is left, where repeats end, and one
text of each that occurs again and shares its route (the bytes after the
trigger) with such a rest, is settled window by window, by the hash of the
window itself. So are windows without a trigger in their first REACH bytes
(long runs of one pattern, mostly).

Every pass deals its keys by a hash of what they are compared by, and a block
sends a key once: no passage, however common, gathers its documents in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import REPLY, REQUEST, Rolling, answer_index, block_table, covered, distinct, mix, replies, requests, texts, unpack
from .common import give_back, parquet_stage

WINDOW = 200
WORD = 8            # bytes of a trigger
RATE = 32           # one position in RATE is a trigger
ROUTE = 32          # bytes after a trigger that equal windows around it share
FINER = 4           # hash buckets of windows per bucket of other keys: text has more windows than triggers
_LUT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LUT2 = mix(_LUT + np.uint64(0xD1B54A32D192ED03))

ANSWER_AROUND = "blk int, bucket int, bits binary"


class _Block:
    """What each pass derives anew from a block's texts."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.reach = window, window - ROUTE
        self.texts = texts(table)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        # padding keeps the last trigger's bytes and routes inside the array
        self.data = np.frombuffer(b"".join(self.texts) + bytes(window + WORD), np.uint8)
        self.n = int(self.sizes.sum())
        self.end_of = np.repeat(self.ends, self.sizes)
        self.hash = Rolling(_LUT[self.data], 0)
        words = np.lib.stride_tricks.as_strided(self.data, (self.n, WORD), (1, 1)) if self.n else np.zeros((0, WORD), np.uint8)
        value = np.zeros(self.n, np.uint64)
        for k in range(WORD):
            value |= words[:, k].astype(np.uint64) << np.uint64(8 * k)
        hit = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        hit = (hit * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(RATE) == 0
        t = np.flatnonzero(hit)
        self.triggers = t[t + WORD <= self.end_of[t]]

    def phrases(self):
        """Whole phrases that fit into a window: distinct names, and their multiplicity."""
        t = self.triggers
        start, end = t[:-1], t[1:] + WORD
        fits = (self.end_of[start] == self.end_of[t[1:]]) & (end - start <= self.window) if len(t) > 1 else np.zeros(0, bool)
        self.first, self.last = start[fits], end[fits]
        return distinct(self.hash(self.first, self.last)[:, None])

    def candidates(self, bits: np.ndarray, inverse: np.ndarray):
        """Window starts that no phrase of a single occurrence rules out, with
        the number of the first trigger at or after each (-1: none in reach)."""
        single = ~bits[inverse]
        dead = np.zeros(self.n + 1, np.int32)
        np.add.at(dead, np.maximum(self.last[single] - self.window, 0), 1)
        np.add.at(dead, self.first[single] + 1, -1)
        at = np.flatnonzero((self.end_of - np.arange(self.n) >= self.window) & (np.cumsum(dead[:-1]) == 0))
        k = np.searchsorted(self.triggers, at)
        trigger = np.append(self.triggers, self.n + 2 * self.window)[k]
        return at, np.where(trigger - at <= self.reach, k, -1)

    def groups(self, bits, inverse):
        """The candidates by trigger: (trigger number, first and last start),
        and those without one."""
        at, k = self.candidates(bits, inverse)
        self.at, self.k = at[k >= 0], k[k >= 0]
        self.loose = at[k < 0]
        new = np.flatnonzero(np.diff(self.k, prepend=-1) != 0)
        self.cut = np.append(new, len(self.k))
        self.group_k = self.k[new]
        self.low, self.high = self.at[new], self.at[self.cut[1:] - 1]

    def keys(self, start, end):
        other = Rolling(_LUT2[self.data], 1)
        return np.stack([self.hash(start, end), other(start, end)], axis=1)

    def around(self):
        """Key of all text that a trigger's candidate windows span, and its route."""
        t = self.triggers[self.group_k]
        return distinct(np.concatenate([self.keys(self.low, self.high + self.window), self.hash(t, t + ROUTE)[:, None]], axis=1))

    def windows(self, send):
        """Starts and distinct keys of the windows of the groups ``send`` and of those without a trigger."""
        start = np.concatenate([self.at[np.repeat(send, np.diff(self.cut))], self.loose])
        return start, *distinct(self.keys(start, start + self.window))


def _tally(table: pa.Table):
    """The keys (128 bits of text, route) of a bucket's requests, their sizes by
    request, the number of each among the distinct, and which of these occur
    more than once."""
    parts = [np.frombuffer(k, np.uint64).reshape(-1, 3) for k in table.column("keys").to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)).astype(bool)
                           for m, p in zip(table.column("many").to_pylist(), parts)])
    found, inverse, again = distinct(np.concatenate(parts))
    again |= np.bincount(inverse, many, len(found)) > 0
    return [len(p) for p in parts], found, inverse, again


def _routes(found: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct routes of a bucket's keys, the route of each key, and whether a text of it occurs once."""
    routes, inverse, _ = distinct(found[:, 2:])
    return routes, inverse, np.bincount(inverse, ~again, len(routes)) > 0


def _resolve_routes(table: pa.Table) -> pa.Table:
    """A bit per route, for each bucket of texts that asks: is it open, that is, does a text of it occur once?"""
    parts = [np.frombuffer(k, np.uint64)[:, None] for k in table.column("keys").to_pylist()]
    once = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)).astype(bool)
                           for m, p in zip(table.column("many").to_pylist(), parts)])
    found, inverse, _ = distinct(np.concatenate(parts))
    is_open = np.bincount(inverse, once, len(found)) > 0
    bits = np.split(is_open[inverse], np.cumsum([len(p) for p in parts])[:-1])
    return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"),
                     "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()), "note": pa.nulls(len(parts), pa.binary())})


def _unpack_around(table: pa.Table, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((keys[:, 0] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    got = dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))
    size = np.bincount(bucket, minlength=1)
    again, sends = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    used = np.flatnonzero(size)
    if len(used):
        two = [np.unpackbits(np.frombuffer(got[b], np.uint8), count=2 * n).astype(bool).reshape(2, n)
               for b, n in zip(used.tolist(), size[used].tolist())]
        again[order], sends[order] = np.concatenate(two, axis=1)
    return again, sends


def _note(blk: int, index: np.ndarray, masks: np.ndarray) -> pa.Table:
    """What a block tells its own last pass: where each window's answer is, and two masks of its bytes."""
    packed = np.packbits(masks).tobytes()
    return pa.table({"blk": pa.array([blk], pa.int32()), "bucket": pa.array([-1 - blk], pa.int32()), "keys": pa.array([b""], pa.binary()),
                     "many": pa.array([packed + index.tobytes()], pa.binary())})


def _noted(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The answers to a block of ``n`` bytes in the order of their buckets, and its note."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), table.column("note").to_pylist()))
    bits = np.unpackbits(np.frombuffer(b"".join(b for k, b, _ in rows if k >= 0), np.uint8)).astype(bool)
    told, size = next((x for k, _, x in rows if k < 0), b""), (2 * n + 7) // 8
    masks = np.unpackbits(np.frombuffer(told[:size], np.uint8), count=2 * n).reshape(2, n).astype(bool)
    return bits, np.frombuffer(told[size:], np.int32), masks


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     carry: list[str] = ()) -> DataFrame:
    """``id, n_bytes, n_removed, starts, kept, row``: each document's UTF-8
    bytes without those in a string of ``window`` bytes that starts anywhere
    else too, this document included; ``starts`` and ``lengths`` give the
    maximal removed runs, ``kept`` the other bytes. Strings are judged on the
    input and never cross documents. Null texts are empty; texts shorter than
    ``window`` keep all; repeated rows repeat all their strings; ids play no
    part; an empty table gives no rows. ``row`` is a struct of the columns
    ``carry``, so no name clashes."""
    blocks = block_table(docs, id_col, text_col, carry)
    buckets, rows = blocks.buckets, blocks.rows
    by_block = rows.select("blk", "text").groupBy("blk")

    def ask_phrases(table: pa.Table) -> pa.Table:
        found, _, many = _Block(table, window).phrases()
        return requests(table.column("blk")[0].as_py(), found, many, buckets)

    first = replies(by_block.applyInArrow(ask_phrases, REQUEST), 1).drop("note")

    def after_first(table: pa.Table, reply: pa.Table) -> _Block:
        block = _Block(table, window)
        found, inverse, _ = block.phrases()
        block.groups(unpack(reply, found, buckets), inverse)
        return block

    def ask_around(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return requests(0, np.zeros((0, 3), np.uint64), np.zeros(0, bool), buckets)
        found, _, many = after_first(table, reply).around()
        return requests(table.column("blk")[0].as_py(), found, many, buckets)

    def ask_routes(table: pa.Table) -> pa.Table:
        _, found, _, again = _tally(table)
        routes, _, once = _routes(found, again)
        return requests(table.column("bucket")[0].as_py(), routes, once, buckets)

    def answer_around(table: pa.Table, reply: pa.Table) -> pa.Table:
        """Two bits per key: does the text occur more than once, and does the
        block send its windows? A text that occurs once is sent, and by one
        block each that occurs again on an open route."""
        sizes, found, inverse, again = _tally(table)
        routes, of, _ = _routes(found, again)
        is_open = unpack(reply, routes, buckets)[of]
        first = np.full(len(found), len(inverse))
        np.minimum.at(first, inverse, np.arange(len(inverse)))
        sends = is_open[inverse] & (~again[inverse] | (first[inverse] == np.arange(len(inverse))))
        cut = np.cumsum(sizes)[:-1]
        bits = [np.packbits(np.stack([a, s]), axis=None).tobytes() for a, s in zip(np.split(again[inverse], cut), np.split(sends, cut))]
        return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    asked = parquet_stage(by_block.cogroup(first.groupBy("blk")).applyInArrow(ask_around, REQUEST), "pfp-around")
    # here a bucket of texts asks, so it stands in the column blk
    routes = parquet_stage(asked.groupBy("bucket").applyInArrow(ask_routes, REQUEST)
                           .groupBy("bucket").applyInArrow(_resolve_routes, REPLY), "pfp-routes")
    around = parquet_stage(asked.groupBy("bucket").cogroup(routes.groupBy("blk")).applyInArrow(answer_around, ANSWER_AROUND),
                           "pfp-around-replies")
    answers = first.withColumn("step", F.lit(1)).unionByName(around.withColumn("step", F.lit(2)))

    def after_around(table: pa.Table, reply: pa.Table):
        """The block, which groups occur again as a whole, and which it sends the windows of."""
        import pyarrow.compute as pc
        one, two = (reply.filter(pc.equal(reply.column("step"), k)) for k in (1, 2))
        block = after_first(table, one)
        found, inverse, _ = block.around()
        again, sends = _unpack_around(two, found, buckets)
        # of equal groups in a block one is sent
        first_of = np.full(len(found), len(inverse))
        np.minimum.at(first_of, inverse, np.arange(len(inverse)))
        return block, again[inverse], sends[inverse] & (first_of[inverse] == np.arange(len(inverse)))

    def ask_windows(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return requests(0, np.zeros((0, 2), np.uint64), np.zeros(0, bool), buckets * FINER)
        block, again, send = after_around(table, reply)
        start, found, inverse, many = block.windows(send)
        # the last pass finds each answer by this note alone: which windows are asked for, which are known to repeat
        masks = np.zeros((2, block.n), bool)
        masks[0, start] = True
        masks[1, block.at[np.repeat(again, np.diff(block.cut))]] = True
        index = answer_index(found, buckets * FINER)[inverse][np.argsort(start)].astype(np.int32)
        del block, again, send, start, inverse
        blk = table.column("blk")[0].as_py()
        out = pa.concat_tables([requests(blk, found, many, buckets * FINER), _note(blk, index, masks)])
        give_back()
        return out

    by_text = rows.select("blk", "text").groupBy("blk")
    settled = replies(by_text.cogroup(answers.groupBy("blk")).applyInArrow(ask_windows, REQUEST), 2)
    kind = rows.schema["row"].dataType
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())),
                        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType()),
                        T.StructField("row", kind)])

    def remove(table: pa.Table, reply: pa.Table) -> pa.Table:
        block = texts(table)
        sizes = np.array([len(t) for t in block], np.int64)
        n = int(sizes.sum())
        data = np.frombuffer(b"".join(block), np.uint8)
        bits, index, masks = _noted(reply, n)
        starts = np.concatenate([np.flatnonzero(masks[0])[bits[index]], np.flatnonzero(masks[1])])
        gone = covered(starts, window, n) if n else np.zeros(0, bool)
        cols: dict[str, list] = {c: [] for c in ("n_removed", "starts", "lengths", "kept")}
        for text, end, size in zip(block, np.cumsum(sizes).tolist(), sizes.tolist()):
            own = gone[end - size:end]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            cols["starts"].append(edge[::2])
            cols["lengths"].append(edge[1::2] - edge[::2])
            cols["n_removed"].append(int(own.sum()))
            cols["kept"].append(data[end - size:end][~own].tobytes() if len(edge) else text)
        return pa.table({"id": table.column("id"), "n_bytes": pa.array(sizes), "n_removed": pa.array(cols["n_removed"], pa.int64()),
                         "starts": pa.array(cols["starts"], pa.list_(pa.int64())), "lengths": pa.array(cols["lengths"], pa.list_(pa.int64())),
                         "kept": pa.array(cols["kept"], pa.binary()), "row": table.column("row")})

    return rows.groupBy("blk").cogroup(settled.groupBy("blk")).applyInArrow(remove, out)
