"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

Encoding. In byte-level BPE a sequence of tokens is the encoding of its bytes
exactly if every two neighbours are *compatible*: no merge across their border
comes up while the fragments on both sides of it are still there. So the last
token of every prefix of a piece is unique, and it depends on what is left of
it through one token only. That makes encoding a finite-state transduction.

A state holds the bytes since the earliest cut at which a token may still be
under way and, for each such cut, the merges that the token before it would
do with the bytes to come; merges that the bytes read have ruled out are
forgotten, which keeps the states few. Reading a byte gives the token that
ends there. States and transitions are made when first met, and kept up to a
bound. A token is emitted once all live cuts descend from its end: nothing
waits longer than the longest token lets a cut live.

Decoding. Tokens are looked up and joined; a UTF-8 state machine that carries
its state from token to token tells complete characters from damaged ones.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches

MAX_TRANSITIONS = 300_000     # remembered by one worker; beyond, states are made again
MAX_CHUNKS = 150_000          # remembered stretches of text between blanks of one generation; there are two
MAX_PIECES = 150_000          # the same of pieces
PIECE_CHARS = 64              # longer pieces are not remembered
FLUSH = 1024                  # bytes between two looks for decided tokens in a long piece
NEVER = 1 << 60
MARKS = frozenset(".,;:!?")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def merge(ranks: dict[bytes, int], data: bytes, stop: int = 1) -> list[bytes]:
    """Merging by the definition, until ``stop`` parts are left."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > stop:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class _Threats:
    """Merges that a token would do with the bytes to come: fragments, and the
    rank at which each comes up. Equal ones are one object, so states compare fast;
    what the next bytes leave of them is worked out once."""

    __slots__ = ("when", "after", "owner")

    def __init__(self, when: dict[bytes, int], owner: Transducer):
        self.when, self.after, self.owner = when, {}, owner

    def narrow(self, part: bytes) -> _Threats:
        """Those that the bytes ``part`` have not ruled out."""
        left = self.after.get(part)
        if left is None:
            left = self.after[part] = self.owner._one({b: w for b, w in self.when.items() if b.startswith(part) or part.startswith(b)})
        return left


class _State(dict):
    """A state by its next bytes; a byte not met before makes its transition."""

    __slots__ = ("seen", "cuts", "token", "length", "owner")

    def __init__(self, owner: Transducer, seen: bytes, cuts: tuple, token: int | None):
        self.owner, self.seen, self.cuts, self.token = owner, seen, cuts, token
        self.length = owner.length.get(token, 0)

    def __missing__(self, byte: int) -> _State:
        move = self[byte] = self.owner.step(self, byte)
        return move


class Transducer:
    """The lazily determinised transducer of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.born = {t: r if len(t) > 1 else -1 for t, r in ranks.items()}
        self.tokens = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.follow: dict[bytes, list[bytes]] = {}     # a -> the b for which a + b is a token
        for t in ranks:
            for k in range(1, len(t)):
                if t[:k] in ranks and t[k:] in ranks:
                    self.follow.setdefault(t[:k], []).append(t[k:])
        self.spine = functools.lru_cache(None)(self._spine)
        self.threats = functools.lru_cache(None)(self._threats)
        self.known: dict[frozenset, _Threats] = {}
        self.none = self._one({})
        self.states: dict[tuple, _State] = {}
        self.restart()

    def restart(self):
        """Without states; spines and threats, the costly part of them, stay."""
        for state in self.states.values():
            state.clear()
        self.root = _State(self, b"", (), None)
        self.states = {(b"", (), None): self.root}
        self.made = 0

    def _one(self, when: dict[bytes, int]) -> _Threats:
        key = frozenset(when.items())
        return self.known.get(key) or self.known.setdefault(key, _Threats(when, self))

    def _spine(self, token: bytes, right: bool) -> tuple[tuple[bytes, int], ...]:
        """The fragments at the token's right (left) border over time, each
        with the rank at which it is merged away."""
        out, death = [], NEVER
        while True:
            out.append((token, death))
            halves = merge(self.ranks, token, 2)
            if len(halves) != 2:
                return tuple(out)
            death, token = self.ranks[token], halves[1 if right else 0]

    def _threats(self, token: int) -> dict[int, _Threats]:
        """By the next byte: what would merge with the end of ``token``."""
        found: dict[int, dict[bytes, int]] = {}
        for a, death in self.spine(self.tokens[token], True):
            for b in self.follow.get(a, ()):
                when = max(self.ranks[a + b], self.born[a], self.born[b])
                if when < death:
                    first = found.setdefault(b[0], {})
                    first[b] = min(when, first.get(b, NEVER))
        return {k: self._one(v) for k, v in found.items()}

    def compatible(self, threats: _Threats, token: bytes) -> bool:
        if threats.when:
            for b, death in self.spine(token, False):
                when = threats.when.get(b)
                if when is not None and when <= death:
                    return False
        return True

    def step(self, state: _State, byte: int) -> _State:
        """The state after ``byte``; its token is the one that ends there."""
        if state.token is None:
            end = self.none
        else:
            end = self.threats(state.token).get(byte, self.none)
        seen = state.seen + bytes((byte,))
        new, alive = None, []
        for start, threats in (*state.cuts, (len(state.seen), end)):
            part = seen[start:]
            if new is None and part in self.ranks and self.compatible(threats, part):
                new = self.ranks[part]
            if part in self.prefixes:
                alive.append((start, threats.narrow(part)))
        base = alive[0][0] if alive else len(seen)
        key = (seen[base:], tuple((start - base, threats) for start, threats in alive), new)
        self.made += 1
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = _State(self, *key)
        return found

    def stream(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Lists of tokens as they become certain, for one piece that arrives
        in chunks; the rest at its end."""
        if self.made > MAX_TRANSITIONS:
            self.restart()
        state, ends = self.root, []

        def back(position: int) -> list[int]:
            path = []
            while position:
                path.append(ends[position - 1].token)
                position -= ends[position - 1].length
            return path[::-1]

        for chunk in chunks:
            for byte in chunk:
                state = state[byte]
                ends.append(state)
            live = [back(len(ends) - len(state.seen) + start) for start, _ in state.cuts] + [back(len(ends))]
            certain = []
            for tokens in zip(*live):
                if len(set(tokens)) > 1:
                    break
                certain.append(tokens[0])
            if certain:
                del ends[:sum(self.length[t] for t in certain)]
                yield certain
        yield back(len(ends))

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(piece)
        if n > FLUSH:
            return [t for part in self.stream(piece[i:i + FLUSH] for i in range(0, n, FLUSH)) for t in part]
        if self.made > MAX_TRANSITIONS:
            self.restart()
        state, ends = self.root, []
        for byte in piece:
            state = state[byte]
            ends.append(state)
        path = []
        while n:
            state = ends[n - 1]
            path.append(state.token)
            n -= state.length
        return path[::-1]


class _Remembered(dict):
    """Ids (as bytes) by text, in two generations: when the young one (this
    dictionary) is full it becomes the old one, and the old one goes."""

    def __init__(self, find, most: int, chars: int):
        super().__init__()
        self.find, self.most, self.chars, self.old = find, most, chars, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.find(text)
        if len(text) <= self.chars:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Texts to ids: chunks, cut into pieces by the pattern, each through the
    transducer; chunks met before are looked up, and so are pieces, which come
    again more often."""

    def __init__(self, path: str, pattern: str):
        import re

        import regex
        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        # The public pattern never crosses a single blank between two visible
        # characters or next to one other white space character, so such a
        # text may be cut before these blanks; other patterns get whole texts.
        self.at_blanks = pattern == default_pattern()
        self.wide_space = re.compile(r"  |\s \s").search
        self.pieces = _Remembered(self._piece, MAX_PIECES, PIECE_CHARS)
        self.after = _Remembered(self._after_blank, MAX_CHUNKS, PIECE_CHARS)

    def _piece(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def _after_blank(self, chunk: str) -> bytes:
        # letters, or letters and a mark, need no pattern
        if chunk.isalpha():
            return self.pieces[" " + chunk]
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return self.pieces[" " + chunk[:-1]] + self.pieces[chunk[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(" " + chunk)))

    def _bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.at_blanks or self.wide_space(text):
            return b"".join(map(self.pieces.__getitem__, self.split(text)))
        first, *chunks = text.split(" ")
        return b"".join(map(self.pieces.__getitem__, self.split(first))) + b"".join(map(self.after.__getitem__, chunks))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self._bytes(text), np.int32)

    def encode_all(self, texts: Iterable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow column's texts, one after the other, and their offsets."""
        ids = [self._bytes(t.as_py()) for t in texts]
        ends = np.cumsum([0] + [len(x) // 4 for x in ids])
        return np.frombuffer(b"".join(ids), np.int32), ends


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get the characters that are complete.
    The state is what may follow; damaged sequences become U+FFFD."""

    def __init__(self):
        self.state = 0              # continuation bytes still due
        self.low, self.high = 0x80, 0xBF
        self.held = bytearray()
        self.damaged = 0

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for byte in data:
            if self.state:
                if self.low <= byte <= self.high:
                    self.held.append(byte)
                    self.state -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.state:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append(self._broken())
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.state = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                self.held.append(byte)
            else:
                out.append(self._broken())
        return "".join(out)

    def _broken(self) -> str:
        self.state, self.low, self.high = 0, 0x80, 0xBF
        self.held.clear()
        self.damaged += 1
        return "�"

    def finish(self) -> str:
        return self._broken() if self.state else ""


class Decoder:
    """Ids to bytes and text."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.tokens = tokens
        self.table = pa.array(tokens, pa.large_binary())
        self.whole = np.array([self._whole(t) for t in tokens], bool)

    @staticmethod
    def _whole(token: bytes) -> bool:
        m = Utf8Machine()
        m.feed(token)
        return not m.state and not m.damaged

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text, token by token; a character comes with the token that completes it."""
        m = Utf8Machine()
        for i in ids:
            yield m.feed(self.tokens[i])
        yield m.finish()

    def decode_lists(self, flat: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Bytes of each list of ids (``ends``: offsets into ``flat``), and
        whether they are well-formed UTF-8. The machine runs only over
        stretches of tokens that end within a character."""
        got = self.table.take(pa.array(flat))
        offsets = np.frombuffer(got.buffers()[1], np.int64, len(flat) + 1, got.offset * 8)[ends]
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(offsets), got.buffers()[2]])
        ok = np.ones(len(ends) - 1, bool)
        odd = np.flatnonzero(~self.whole[flat])
        owner = np.searchsorted(ends, odd, "right") - 1
        machine, before, before_owner = Utf8Machine(), -2, -1
        for at, doc in zip(odd.tolist(), owner.tolist()):
            if at != before + 1 or doc != before_owner:
                if machine.state or machine.damaged:
                    ok[before_owner] = False
                machine = Utf8Machine()
            machine.feed(self.tokens[flat[at]])
            before, before_owner = at, doc
        if before_owner >= 0 and (machine.state or machine.damaged):
            ok[before_owner] = False
        return data, ok


@functools.lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _slices(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a bounded size, one row at least."""
    rows = max(1, min(batch.num_rows, int(size * batch.num_rows / max(1, batch.nbytes))))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text",
           out_col: str = "ids") -> DataFrame:
    """``docs`` without ``text_col``, with ``out_col`` (array of ids) added or
    replaced. Null and empty texts give an empty list; the path names a rank
    file that every worker can open."""
    small_batches(docs.sparkSession)
    path, pattern = path or default_path(), pattern or default_pattern()
    keep = [c for c in docs.columns if c not in (text_col, out_col)]
    src = docs.select(*keep, F.col(text_col).alias(out_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for whole in batches:
            for batch in _slices(whole):
                flat, ends = e.encode_all(batch.column(batch.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(flat, ends)], names=batch.schema.names)
        give_back()

    return src.mapInArrow(run, T.StructType([*src.schema[:-1], T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text",
               ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` in one pass: a worker holds both directions."""
    small_batches(docs.sparkSession)
    path, pattern = path or default_path(), pattern or default_pattern()
    names = [ids_col, out_col, f"{out_col}_ok"]
    keep = [c for c in docs.columns if c not in (text_col, *names)]
    src = docs.select(*keep, F.col(text_col).alias(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, d = encoder(path, pattern), decoder(path)
        for whole in batches:
            for batch in _slices(whole):
                flat, ends = e.encode_all(batch.column(batch.num_columns - 1))
                data, ok = d.decode_lists(flat, ends.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(flat, ends), data.cast(pa.binary()), pa.array(ok)],
                                                 names=[*batch.schema.names, *names[1:]])
        give_back()

    return src.mapInArrow(run, T.StructType([*src.schema[:-1], T.StructField(names[0], T.ArrayType(T.IntegerType())),
                                             T.StructField(names[1], T.BinaryType()), T.StructField(names[2], T.BooleanType())]))


def decode(ids: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``ids`` with ``out_col`` (bytes) and ``<out_col>_ok`` (well-formed UTF-8)
    added or replaced. A null list gives empty bytes; an unknown id fails."""
    path = path or default_path()
    names = [out_col, f"{out_col}_ok"]
    src = ids.select(*[c for c in ids.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(path)
        for whole in batches:
            for batch in _slices(whole):
                lists = pc.fill_null(batch.column(batch.schema.get_field_index(ids_col)), [])
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                data, ok = d.decode_lists(lists.flatten().to_numpy(zero_copy_only=False), ends)
                yield pa.RecordBatch.from_arrays([*batch.columns, data.cast(pa.binary()), pa.array(ok)],
                                                 names=[*batch.schema.names, *names])

    return src.mapInArrow(run, T.StructType([*src.schema, T.StructField(names[0], T.BinaryType()),
                                             T.StructField(names[1], T.BooleanType())]))
