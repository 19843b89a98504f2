"""Best-fit packing of documents into sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` token ids; only longer documents
are cut. Pieces are dealt at random into groups of some thousands, and each group
is packed by itself: longest piece first, each into the fullest sequence that has
room. Sequences that are full or nearly so are done. From the rest of each group
its residue goes up a tree as items of the next round: the one sequence that may
be at most half full (best fit never leaves two) and, as hosts, as many of the
emptiest others as a merged group can have such guests. ``FAN_IN`` groups merge in
each round, until one is left; a merged group holds at most FAN_IN * (FAN_IN + 1)
items, whatever the corpus. Pieces do not move in the later rounds: only the
table of residues says where a sequence lies in the one that took it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, parquet_stage

CAPACITY = 4096
END = 1                     # id that ends a document
GROUP_ITEMS = 1 << 14       # pieces that one group aims at
FAN_IN = 8                  # groups that merge in a round
SLACK = 16                  # a sequence with fewer free places is nearly full
WORDS = 300_000             # words per generation that a worker remembers
WORD_CHARS = 64             # longer words are not remembered
SLICE_CHARS = 1 << 20       # of a long text, as much is taken at a time

_PIECE = "piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters are their own, the other bytes follow from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (c for c in range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class _Words(dict):
    """Ids of words by word, in two generations: when the young one (this
    dictionary) is full it becomes the old one, and the old one goes. A new word of
    Latin letters is cut into letters, digits and marks as the vocabulary's pattern
    does; unknown parts go to the merges, words with other characters through the
    whole tokenizer."""

    # fixed values: the vocabulary's pattern, for lower-cased words of the letters below; none
    # of them is put together with others or changed in kind by normalising
    PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|"
                       r"[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+").findall
    LETTERS = _byte_letters()

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        self.old, self.parts = {}, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if self.PLAIN(word) and "<|" not in word:       # special tokens stand in marks like these
                known = self.parts
                ids = b"".join([known.get(p) or self._part(p) for p in self.PARTS(word.lower())])
            else:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.LETTERS)
        ids = np.array([t.id for t in self.merge(letters)], "<u4").tobytes()
        if len(part) <= WORD_CHARS:
            if len(self.parts) >= WORDS:
                self.parts.clear()
            self.parts[part] = ids
        return ids


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes. The vocabulary
    drops white space and never joins what it parts, so a text's ids are those of
    its words; words repeat, and a bounded number of them is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.words = _Words(Tokenizer.from_file(path))

    @staticmethod
    def _slices(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE_CHARS:
            cut = text.find(" ", at + SLICE_CHARS)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut + 1
        yield text[at:]

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.words.__getitem__
        for text in texts:
            # ASCII white space only: part of what the vocabulary's pattern drops
            plain = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
            if len(plain) <= SLICE_CHARS:
                yield b"".join(map(known, plain.split(" ")))
            else:
                out = bytearray()
                for part in self._slices(plain):
                    out += b"".join(map(known, part.split(" ")))
                yield bytes(out)


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``id, piece, start, length, ids_crc32`` and, if asked
    for, ``ids`` (bytes, little-endian). A null text is empty: its one piece is
    the ending id."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, Encoder(vocabulary))
        ending, width = np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                row, number, length, crc, kept = [], [], [], [], []
                for i, ids in enumerate(encoder(part.column("text").to_pylist())):
                    ids += ending
                    for k in range(0, len(ids), width):
                        cut = ids[k:k + width]
                        row.append(i)
                        number.append(k // width)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            kept.append(cut)
                number = np.array(number, np.int32)
                out = {"id": part.column("id").take(pa.array(row, pa.int64())), "piece": pa.array(number, pa.int32()),
                       "start": pa.array(number.astype(np.int64) * capacity), "length": pa.array(length, pa.int64()),
                       "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(out)
        give_back()

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    return named.mapInArrow(run, f"id {kind}, {_PIECE}" + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each item and the fill of each bin. Longest first,
    equal lengths in their order; each goes into the fullest bin with room."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]      # bins by free places
    mask, fill = 0, []                                                  # bit r: a bin with r free places
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        with_room[left].append(b)
        mask |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _rising(fill: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins of a group go up: its guests (at most half full; best fit
    leaves one at most) and the ``FAN_IN`` emptiest hosts that are not nearly full."""
    guest = 2 * fill <= capacity
    hosts = np.flatnonzero(~guest & (fill <= capacity - SLACK))
    up = guest.copy()
    up[hosts[np.argsort(fill[hosts], kind="stable")[:FAN_IN]]] = True
    return up


def _packed(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """``items(grp, item, length, ...)`` with ``bin, offset, rising, fill``.
    ``rising`` is set on the first item of a bin that goes up."""
    carried = [c for c in items.columns]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("item").to_numpy(), kind="stable")))
        bins, offsets, fill = best_fit(table.column("length").to_numpy(), capacity)
        up = _rising(fill, capacity)
        base = (level << 56) | (table.column("grp")[0].as_py() << 24)
        for name, values in (("bin", base + bins), ("offset", offsets), ("rising", up[bins] & (offsets == 0)), ("fill", fill[bins])):
            table = table.append_column(name, pa.array(values))
        return table

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*carried).schema.fields)
    return items.groupBy("grp").applyInArrow(run, schema + ", bin long, offset long, rising boolean, fill long")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with a column ``length``, 1 to ``capacity``) with ``sequence_id``
    and ``offset``: no sequence holds more than ``capacity`` and none has a gap.

    Every row is an item of its own, repeated ones and those with null in any
    other column included; an empty table gives an empty one. Given the same
    stored rows the packing is the same. Other columns are carried (a column
    named like one added here is an error of the caller's)."""
    stored = parquet_stage(parts.withColumn("item", F.monotonically_increasing_id()), "pack-pieces")
    whole = stored.filter(F.col("length") == capacity)
    rest = stored.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP_ITEMS))
    first = parquet_stage(_packed(rest.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups))), 0, capacity), "pack-0")
    residues, at, level = [], first, 0
    while True:
        up = at.filter("rising").select(F.floor(F.col("grp") / FAN_IN).cast("long").alias("grp"),
                                        F.col("bin").alias("item"), F.col("fill").alias("length"))
        if groups == 1 and level:
            break
        groups, level = -(-groups // FAN_IN), level + 1
        at = parquet_stage(_packed(up, level, capacity), f"pack-{level}")
        residues.append(at)
    # where a residue ends up: the last round first, a few rows per group
    final = None
    for table in reversed(residues):
        one = table.select(F.col("item").alias("was"), F.col("bin").alias("host"), F.col("offset").alias("shift"))
        if final is not None:
            then = final.select(F.col("was").alias("host"), F.col("host").alias("host2"), F.col("shift").alias("shift2"))
            one = one.join(then, "host", "left").select(
                "was", F.coalesce("host2", "host").alias("host"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
        final = one
    placed = first.join(final, first["bin"] == final["was"], "left").select(
        *[first[c] for c in parts.columns], F.coalesce("host", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return placed.unionByName(whole.select(*parts.columns, (-1 - F.col("item")).alias("sequence_id"),
                                           F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """All documents packed: ``id, piece, start, length, ids_crc32, sequence_id,
    offset``, a row per piece. A null or empty text is one ending id; repeated
    rows are separate documents, a null id stays null, and other columns of the
    input are ignored."""
    return pack(pieces(docs, vocabulary, id_col, text_col, capacity, end), capacity)


def sequences(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
              capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed training rows: ``sequence_id, ids`` (array of int), the
    documents of each in order of their offset. Groups are bounded: at most
    ``capacity`` ids each."""
    placed = pack(pieces(docs, vocabulary, id_col, text_col, capacity, end, with_ids=True), capacity)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("offset").to_numpy(), kind="stable")
        parts = table.column("ids").to_pylist()
        ids = np.frombuffer(b"".join(parts[i] for i in order.tolist()), "<u4").astype(np.int32)
        return pa.table({"sequence_id": table.column("sequence_id").slice(0, 1),
                         "ids": pa.array([ids], pa.list_(pa.int32()))})

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(run, "sequence_id long, ids array<int>")
