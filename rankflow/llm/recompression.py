"""Substring dedup by recompression.

The words of a text are names. A round gives new names to runs of one name and
to pairs: each name falls on the left or the right side by a bit of its hash,
and a left one followed by a right one becomes one name. Names are hashes of
what they stand for, the same in every document without any exchange, and since
a pairing depends on next to nothing around it, equal stretches of text get
equal names in their interior, wherever they occur. With each name goes its
*context*, the stretch of words that it depends on.

After the last round Spark finds the names that occur more than once in the
corpus. A window of words that holds the context of a name that occurs once
cannot occur twice; this rules out nearly all windows of text that is not
repeated. The remaining windows are verified: Spark finds those whose sequence
of words (128 bits of hash) occurs more than once, and their words go.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import (REQUEST, Rolling, answer_index, answers, block_table, covered, distinct, mix, note, replies, requests,
                     texts, unpack)

WINDOW = 35
ROUNDS = 6
RUN_ROUNDS = (0,)        # rounds that begin with naming runs
LONGEST = 12             # a name for more words than this is not paired again
MAX_WORDS = 150_000      # remembered words of one worker


class _Vocabulary(dict):
    """Word -> number; its two 64-bit hashes are kept beside."""

    def __init__(self):
        self.forget()

    def forget(self):
        self.clear()
        self.hashes = np.zeros((1 << 16, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        digest = xxhash.xxh3_128_intdigest(word)
        self.hashes[number, 0] = np.uint64(digest >> 64)
        self.hashes[number, 1] = np.uint64(digest & 0xFFFFFFFFFFFFFFFF)
        return number


_VOCABULARY = _Vocabulary()


@dataclass
class Symbols:
    """Names of a block after the rounds, in order."""
    name: np.ndarray
    left: np.ndarray       # context: the words [left, right) that the name depends on
    right: np.ndarray


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> Symbols:
    """Names for stretches of ``names`` (64-bit, one per word; ``doc`` numbers
    the documents in order), none across documents. At a document's end the
    context reaches beyond it: what is outside takes part in the decision."""
    n = len(names)
    name, doc, length = mix(names), doc.astype(np.int32), np.ones(n, np.int32)
    left, right = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    for k in range(rounds):
        if len(name) < 2:
            break
        if k in RUN_ROUNDS:
            near = doc[1:] == doc[:-1]
            # whether a run goes on is known from the neighbours
            new_left, new_right = left.copy(), right.copy()
            new_left[1:] = np.where(near, np.minimum(left[1:], left[:-1]), left[1:] - 1)
            new_right[:-1] = np.where(near, np.maximum(right[:-1], right[1:]), right[:-1] + 1)
            new_left[0] -= 1
            new_right[-1] += 1
            starts = np.flatnonzero(np.concatenate([[True], ~(near & (name[1:] == name[:-1]))]))
            size = np.diff(np.append(starts, len(name)))
            run = size > 1
            name = np.where(run, mix(name[starts] + mix(size.astype(np.uint64) + np.uint64(k << 32))), name[starts])
            length = length[starts] * size
            left, right, doc = new_left[starts], new_right[starts + size - 1], doc[starts]
            if len(name) < 2:
                break
        # side: 1 left, 0 right, 2 too long to pair
        side = ((name >> np.uint64(8 + k)) & np.uint64(1)).astype(np.int8)
        side[length > longest] = 2
        near = doc[1:] == doc[:-1]
        pair = near & (side[:-1] == 1) & (side[1:] == 0)
        head = np.concatenate([pair, [False]])
        tail = np.concatenate([[False], pair])
        alone = ~(head | tail)
        new_left, new_right = left.copy(), right.copy()
        # a left name that stays alone depends on the next one, a right one on the one before
        waits = np.flatnonzero(alone[:-1] & (side[:-1] == 1))
        new_right[waits] = np.where(near[waits], np.maximum(right[waits], right[waits + 1]), right[waits] + 1)
        new_left[waits] = np.where(near[waits], np.minimum(left[waits], left[waits + 1]), left[waits])
        waits = np.flatnonzero(alone[1:] & (side[1:] == 0)) + 1
        new_left[waits] = np.where(near[waits - 1], np.minimum(left[waits], left[waits - 1]), left[waits] - 1)
        new_right[waits] = np.where(near[waits - 1], np.maximum(right[waits], right[waits - 1]), right[waits])
        if alone[0] and side[0] == 0:
            new_left[0] = left[0] - 1
        if alone[-1] and side[-1] == 1:
            new_right[-1] = right[-1] + 1
        at = np.flatnonzero(pair)
        name[at] = mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + mix(name[at + 1]) + np.uint64(k))
        length[at] += length[at + 1]
        new_left[at] = np.minimum(left[at], left[at + 1])
        new_right[at] = np.maximum(right[at], right[at + 1])
        keep = ~tail
        name, length, doc, left, right = name[keep], length[keep], doc[keep], new_left[keep], new_right[keep]
    return Symbols(name, left, right)


class _Block:
    """What each pass derives anew from a block's texts."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.texts = texts(table)
        if len(_VOCABULARY) > MAX_WORDS:
            _VOCABULARY.forget()
        codes, sizes = [], []
        for t in self.texts:
            words = t.split()
            sizes.append(len(words))
            codes.append(np.fromiter(map(_VOCABULARY.__getitem__, words), np.int64, len(words)))
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.hashes = _VOCABULARY.hashes[np.concatenate(codes) if codes else np.zeros(0, np.int64)]
        self.n = len(self.hashes)

    def symbols(self):
        """Distinct names that lie in some window, their symbols, their multiplicity."""
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        s = recompress(self.hashes[:, 0], doc)
        ends = np.repeat(self.ends, self.sizes)
        inside = (s.right - s.left <= self.window) & (s.left >= 0)
        at = np.flatnonzero(inside)
        # contexts that reach beyond their document are in no window
        first = doc[s.left[at]]
        at = at[s.right[at] <= self.ends[first]]
        del ends
        self.left, self.right = s.left[at], s.right[at]
        return distinct(s.name[at][:, None])

    def candidates(self, reply: pa.Table, buckets: int) -> np.ndarray:
        """Window starts that no name of a single occurrence rules out."""
        found, inverse, _ = self.symbols()
        single = ~unpack(reply, found, buckets)[inverse]
        starts = self.ends.repeat(self.sizes) - np.arange(self.n) >= self.window
        low, high = self.right[single] - self.window, self.left[single]
        dead = np.zeros(self.n + 1, np.int32)
        np.add.at(dead, np.maximum(low, 0), 1)
        np.add.at(dead, high + 1, -1)
        return np.flatnonzero(starts & (np.cumsum(dead[:-1]) == 0))

    def windows(self, reply: pa.Table, buckets: int):
        """The candidates, and their distinct keys."""
        at = self.candidates(reply, buckets)
        keys = np.stack([Rolling(self.hashes[:, lane].copy(), lane)(at, at + self.window) for lane in (0, 1)], axis=1)
        return at, distinct(keys)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                        carry: list[str] = ()) -> DataFrame:
    """``id, n_words, n_removed, kept, row``: each document without the words
    that lie in a window of ``window`` words that starts anywhere else too, this
    document included; ``kept`` joins the remaining words by single blanks.
    Windows are judged on the input. A null or empty text has no words;
    texts shorter than a window keep all; repeated rows repeat all their
    windows; ids play no part; an empty table gives no rows. ``row`` is a
    struct of the input columns ``carry``, so no name clashes."""
    blocks = block_table(docs, id_col, text_col, carry)
    buckets = blocks.buckets
    rows = blocks.rows
    by_block = rows.select("blk", "text").groupBy("blk")

    def ask_names(table: pa.Table) -> pa.Table:
        found, _, many = _Block(table, window).symbols()
        return requests(table.column("blk")[0].as_py(), found, many, buckets)

    names = replies(by_block.applyInArrow(ask_names, REQUEST), 1)

    def ask_windows(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return requests(0, np.zeros((0, 2), np.uint64), np.zeros(0, bool), buckets)
        block, blk = _Block(table, window), table.column("blk")[0].as_py()
        at, (found, inverse, many) = block.windows(reply, buckets)
        mask = np.zeros(block.n, bool)
        mask[at] = True
        # the last pass finds each candidate's answer by this note alone
        return pa.concat_tables([requests(blk, found, many, buckets), note(blk, answer_index(found, buckets)[inverse], mask)])

    again = replies(by_block.cogroup(names.groupBy("blk")).applyInArrow(ask_windows, REQUEST), 2)
    kind = rows.schema["row"].dataType
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("row", kind)])

    def remove(table: pa.Table, reply: pa.Table) -> pa.Table:
        _VOCABULARY.forget()        # this pass has no use for what the last ones left in the worker
        split = [t.split() for t in texts(table)]
        sizes = np.array([len(words) for words in split], np.int64)
        bits, index, packed = answers(reply)
        n = int(sizes.sum())
        at = np.flatnonzero(np.unpackbits(packed, count=n))
        gone = covered(at[bits[index]], window, n) if n else np.zeros(0, bool)
        kept, removed, end = [], [], 0
        for words in split:
            own = gone[end:end + len(words)]
            end += len(words)
            count = int(own.sum())
            kept.append(b" ".join(compress(words, (~own).tolist()) if count else words))
            removed.append(count)
        return pa.table({"id": table.column("id"), "n_words": pa.array(sizes), "n_removed": pa.array(removed, pa.int64()),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string()), "row": table.column("row")})

    return rows.groupBy("blk").cogroup(again.groupBy("blk")).applyInArrow(remove, out)
