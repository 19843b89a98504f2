"""Prefix trie of conversations, with count-min screening of prefix digests.

Turns are digested where they are read; only numbers move from then on. The
digest of a prefix is the exclusive-or of its turns' 128-bit digests, each mixed
with its place, so prefixes of one conversation are a running aggregate that is
cut into blocks: no conversation has to fit a task. Every prefix is counted in a
count-min sketch of bounded size that all tasks read. The sketch never counts too
low, so an estimate of one proves that the prefix belongs to one conversation;
such a node and all below it form a tail, which is emitted where it lies. Only the
other prefixes are shuffled and grouped exactly.

A prefix that several conversations share is a node named by its smallest member
and its depth. Which node a member's prefix belongs to is kept as a table keyed by
(member, depth), unique and so never skewed; it gives a node's parent, and its
ancestor ``2^k`` levels up, with which sums over subtrees take a logarithmic
number of rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.indexing import range_parts

from .common import parquet_stage, power_of_two

MAX_COUNTERS = 1 << 25      # per row of the sketch; two rows of bits are sent to each executor, 8 MB at most
PER_PREFIX = 4              # counters per prefix aimed at
SLICE = 1 << 13             # counters that are merged together
BLOCK = 4096                # turns of a conversation in one running aggregate
HOT = 1000                  # a key with more than 1/HOT of all rows is looked up apart; there are at most HOT
CHUNK = 1000                # conversation ids that are joined before they meet in one task

_EMPTY = hashlib.sha256(b"").hexdigest()


def _split_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` joined to ``lookup`` (unique on ``keys``; ``weight`` of a key is
    the number of rows that have it, ``total`` that of all rows). Keys with a
    thousandth of the rows or more, of which there can be no more than a thousand,
    are sent to the rows; the others are shuffled."""
    hot = lookup.filter(F.col(weight) * HOT > total)
    cold = lookup.filter(F.col(weight) * HOT <= total)
    mark = hot.select(*keys)
    return (rows.join(F.broadcast(hot), keys)
            .unionByName(rows.join(F.broadcast(mark), keys, "left_anti").join(cold, keys)))


def digest_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, pos`` (from 1), two 64-bit digests ``a, b`` of role and text, and
    the text's ``bytes``. Conversations are ordered by turn, null first; rows with
    the same turn by the MD5 of role and text. Null roles and texts are empty, rows
    without a conversation id are left out. A conversation may be of any length:
    rows are numbered in slices of the global order."""
    spark = turns.sparkSession
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    thin = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.md5(F.concat(role, F.lit(":"), text)).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("tie"), F.col("a"), F.col("b")]
    parts = range_parts(thin, int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("conv"), *order)
    # a conversation that goes on from one slice to the next is the last of one and the first of the other
    ends = parts.groupBy("_pid").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    at_end = (parts.join(F.broadcast(ends), "_pid").filter("conv = low OR conv = high")
              .groupBy("conv", "_pid").agg(F.count("*").alias("c")))
    before = Window.partitionBy("conv").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = at_end.select("conv", "_pid", F.sum("c").over(before).alias("off")).filter("off IS NOT NULL")  # one per slice
    place = F.row_number().over(Window.partitionBy("_pid", "conv").orderBy(*order))
    numbered = parts.withColumn("in_slice", place).join(F.broadcast(offsets), ["_pid", "conv"], "left")
    return parquet_stage(numbered.select("conv", (F.col("in_slice") + F.coalesce("off", F.lit(0))).cast("long").alias("pos"),
                                         "a", "b", "bytes"), "trie-turns")


def lengths(digested: DataFrame) -> DataFrame:
    """``conv, n``: the number of turns of each conversation."""
    return digested.groupBy("conv").agg(F.max("pos").alias("n"))


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations in ``turns`` as they are: a row per node
    with ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs`` (members), ``n_children``, ``n_leaves``, ``saved_tokens``
    (bytes of repeated texts in the subtree) and ``ends_sha256``.

    Nulls and ties as in ``digest_turns``; a repeated row is a further turn; an
    empty table gives no node, not even a root. Other columns are ignored."""
    digested = digest_turns(turns, id_col, turn_col, role_col, text_col)
    convs = parquet_stage(lengths(digested), "trie-convs")
    rows = _split_lookup(digested, convs, ["conv"], "n", digested.count())
    return trie(rows.select("conv", F.col("pos").alias("depth"), "a", "b", "bytes", "n"), convs)


# ------------------------------------------------------------------ digests and the sketch

def _prefixes(rows: DataFrame) -> DataFrame:
    """``conv, depth, n, bytes`` with the digest ``x, y`` of the prefix that ends
    here and that of its parent, ``px, py``."""
    rows = (rows.withColumn("blk", F.floor((F.col("depth") - 1) / BLOCK))
            .withColumn("dx", F.xxhash64(F.lit(1), "depth", "a", "b")).withColumn("dy", F.xxhash64(F.lit(2), "depth", "a", "b")))
    sums = (rows.filter(F.col("n") > BLOCK).groupBy("conv", "blk")
            .agg(F.bit_xor("dx").alias("bx"), F.bit_xor("dy").alias("by")))
    ahead = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv", "blk", F.bit_xor("bx").over(ahead).alias("ox"), F.bit_xor("by").over(ahead).alias("oy"))
    inside = Window.partitionBy("conv", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (rows.withColumn("rx", F.bit_xor("dx").over(inside)).withColumn("ry", F.bit_xor("dy").over(inside))
               .join(offsets, ["conv", "blk"], "left"))
    zero = F.lit(0).cast("long")
    return (running.withColumn("x", F.col("rx").bitwiseXOR(F.coalesce("ox", zero)))
            .withColumn("y", F.col("ry").bitwiseXOR(F.coalesce("oy", zero)))
            .select("conv", "depth", "n", "bytes", "x", "y", F.col("x").bitwiseXOR(F.col("dx")).alias("px"),
                    F.col("y").bitwiseXOR(F.col("dy")).alias("py")))


def _places(batch: pa.RecordBatch, names: tuple[str, str], width: int) -> list[np.ndarray]:
    """A prefix's counter in each row of the sketch."""
    return [batch.column(c).to_numpy().astype(np.uint64) & np.uint64(width - 1) for c in names]


def sketch(prefixes: DataFrame, width: int) -> list[np.ndarray]:
    """Count-min sketch of the digests (two rows of ``width`` counters, a power of
    two), as one bit per counter: has it counted two or more? Tasks count up to
    two and send slices with anything in them; slices are added up on Spark."""
    step = min(SLICE, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [np.zeros(width, np.uint8) for _ in range(2)]
        for batch in batches:
            for row, at in zip(counters, _places(batch, ("x", "y"), width)):
                used, times = np.unique(at, return_counts=True)
                row[used] = np.minimum(2, row[used] + np.minimum(times, 2))
        for r, row in enumerate(counters):
            slices = row.reshape(-1, step)
            some = np.flatnonzero(slices.any(1))
            for lo in range(0, len(some), 256):
                at = some[lo:lo + 256]
                yield pa.RecordBatch.from_pydict({
                    "r": pa.array(np.full(len(at), r, np.int32)), "s": pa.array(at.astype(np.int32)),
                    "one": pa.array([np.packbits(slices[i] > 0).tobytes() for i in at], pa.binary()),
                    "two": pa.array([np.packbits(slices[i] > 1).tobytes() for i in at], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        one = two = np.zeros(step // 8, np.uint8)
        for a, b in zip(table.column("one").to_pylist(), table.column("two").to_pylist()):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            two = two | b | (one & a)
            one = one | a
        return pa.table({"r": table.column("r").slice(0, 1), "s": table.column("s").slice(0, 1),
                         "two": pa.array([two.tobytes()], pa.binary())})

    merged = (prefixes.select("x", "y").mapInArrow(count, "r int, s int, one binary, two binary")
              .groupBy("r", "s").applyInArrow(add, "r int, s int, two binary"))
    bits = [np.zeros(width // 8, np.uint8) for _ in range(2)]
    for row in merged.toLocalIterator():        # 2 * MAX_COUNTERS bits at most
        bits[row["r"]][row["s"] * step // 8:(row["s"] + 1) * step // 8] = np.frombuffer(row["two"], np.uint8)
    return bits


def _screened(prefixes: DataFrame, bits: list[np.ndarray], width: int) -> DataFrame:
    """``prefixes`` with ``single`` (its estimate is one) and ``tail`` (its
    parent's is one as well)."""
    shared = prefixes.sparkSession.sparkContext.broadcast(bits)
    kept = ["conv", "depth", "n", "bytes", "x", "y"]

    def estimate_one(batch: pa.RecordBatch, names: tuple[str, str]) -> np.ndarray:
        several = np.ones(batch.num_rows, bool)
        for row, at in zip(shared.value, _places(batch, names, width)):
            several &= (row[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0
        return ~several

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = estimate_one(batch, ("x", "y"))
            below = single & estimate_one(batch, ("px", "py")) & (batch.column("depth").to_numpy() > 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(single), pa.array(below)],
                                             names=[*kept, "single", "tail"])

    return prefixes.mapInArrow(run, "conv long, depth long, n long, bytes long, x long, y long, single boolean, tail boolean")


# ------------------------------------------------------------------ nodes

def _sha_ids(ends: DataFrame) -> DataFrame:
    """``ends(node, depth, conv)`` -> ``node, depth, sha``: the digest of the
    ascending conversation ids of each node. Ids are sorted in slices of the
    global order and joined there into pieces of ``CHUNK``; one task then only
    runs over a node's pieces, which it does not hold."""
    def runs(batch: pa.RecordBatch) -> list[tuple[int, int, int, int]]:
        node, depth = batch.column("node").to_numpy(), batch.column("depth").to_numpy()
        new = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])))
        return list(zip(node[new].tolist(), depth[new].tolist(), new.tolist(), [*new[1:].tolist(), len(node)]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_pylist()
            rows = [(node, depth, conv[at], ",".join(map(str, conv[at:min(at + CHUNK, hi)])))
                    for node, depth, lo, hi in runs(batch) for at in range(lo, hi, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             names=["node", "depth", "low", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, state):
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()),
                                               pa.array([state.hexdigest()])], names=["node", "depth", "sha"])
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids").to_pylist()
            for node, depth, lo, hi in runs(batch):
                if (node, depth) != key:
                    if key is not None:
                        yield row(key, state)
                    key, state = (node, depth), hashlib.sha256()
                    sep = b""
                for i in range(lo, hi):
                    state.update(sep + ids[i].encode())
                    sep = b","
        if key is not None:
            yield row(key, state)

    pieces = (ends.repartitionByRange("node", "depth", "conv").sortWithinPartitions("node", "depth", "conv")
              .mapInArrow(join, "node long, depth long, low long, ids string"))
    return (pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "low")
            .mapInArrow(digest, "node long, depth long, sha string"))


def _node(conv: Column, parent: Column, n_convs: Column, children: Column, leaves: Column, saved: Column, sha: Column) -> list[Column]:
    return [conv.cast("long").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.cast("long").alias("parent_conv_id"),
            n_convs.cast("long").alias("n_convs"), children.cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"),
            saved.cast("long").alias("saved_tokens"), sha.alias("ends_sha256")]


def _single_nodes(rows: DataFrame, parent: Column) -> DataFrame:
    """Nodes of one conversation: nothing is saved, and one leaf is below."""
    ends = F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY))
    return rows.select(*_node(F.col("conv"), parent, F.lit(1), (F.col("depth") < F.col("n")).cast("long"), F.lit(1), F.lit(0), ends))


def trie(rows: DataFrame, convs: DataFrame, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """The trie of ``rows(conv, depth, a, b, bytes, n)``, depths 1 to ``n``
    without gaps, and of all conversations ``convs(conv, n)``, among which may be
    some without turns. Result as in ``prefix_trie``."""
    root, members = convs.agg(F.min("conv"), F.count("*")).first()
    prefixes = parquet_stage(_prefixes(rows), "trie-prefixes")
    width = min(max_counters, max(1024, power_of_two(PER_PREFIX * prefixes.count())))
    screened = _screened(prefixes, sketch(prefixes, width), width)
    tails = _single_nodes(screened.filter("tail"), F.col("conv"))

    open_rows = parquet_stage(screened.filter("NOT tail").drop("tail"), "trie-open")
    maybe = open_rows.filter("NOT single").select("conv", "depth", "n", "bytes", "x", "y")
    groups = maybe.groupBy("x", "y", "depth").agg(F.count("*").alias("n_convs"), F.min("conv").alias("node"), F.max("bytes").alias("size"))
    shared = parquet_stage(groups.filter("n_convs > 1"), "trie-shared")
    found = _split_lookup(maybe.drop("bytes"), shared.select("x", "y", "depth", "n_convs", "node"), ["x", "y", "depth"],
                          "n_convs", open_rows.count())
    member = parquet_stage(found.select("conv", "depth", "node", (F.col("depth") == F.col("n")).alias("ends")), "trie-members")

    above = member.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    to_root = F.when(F.col("depth") == 1, F.lit(root))
    single = (open_rows.select("conv", "depth", "n").join(member.select("conv", "depth"), ["conv", "depth"], "left_anti")
              .join(above, ["conv", "depth"], "left").withColumn("parent", F.coalesce(to_root, "parent")))
    single = parquet_stage(single, "trie-single")       # parent is null below another node of one conversation
    nodes = (shared.select(F.col("node").alias("conv"), "depth", "n_convs", "size").join(above, ["conv", "depth"], "left")
             .withColumn("parent", F.coalesce(to_root, "parent")))
    nodes = parquet_stage(nodes, "trie-nodes")

    zero = F.lit(0).cast("long")
    child = (single.filter("parent IS NOT NULL").select("parent", "depth", F.lit(1).alias("leaf"))
             .unionByName(nodes.select("parent", "depth", F.lit(0).alias("leaf")))
             .groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"))
             .agg(F.count("*").alias("n_children"), F.sum("leaf").alias("leaf")))
    child = parquet_stage(child, "trie-children")
    sums = (nodes.join(child, ["conv", "depth"], "left")
            .select("conv", "depth", F.coalesce("n_children", zero).alias("n_children"),
                    (F.coalesce("leaf", zero) + F.when(F.col("n_children").isNull(), 1).otherwise(0)).alias("leaves"),
                    ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    sums = parquet_stage(sums, "trie-sums")
    # after a round a node has the sums of all nodes less than 2 * step below it
    deepest, step = nodes.agg(F.coalesce(F.max("depth"), zero)).first()[0], 1
    up = member.select("conv", F.col("depth").alias("at"), "node")
    while step < deepest:
        lower = sums.select("conv", (F.col("depth") - step).alias("at"), "leaves", "saved").filter("at > 0")
        more = (lower.join(up, ["conv", "at"]).groupBy(F.col("node").alias("conv"), F.col("at").alias("depth"))
                .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        sums = parquet_stage(sums.join(more, ["conv", "depth"], "left").select(
            "conv", "depth", "n_children", (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved")), "trie-sums")
        step *= 2

    ends = (member.filter("ends").select("node", "depth", "conv")
            .unionByName(convs.filter("n = 0").select(F.lit(root).cast("long").alias("node"), zero.alias("depth"), "conv")))
    sha = parquet_stage(_sha_ids(ends), "trie-ends").select(F.col("node").alias("conv"), "depth", "sha")
    top = (child.filter("depth = 0").select("n_children", F.col("leaf").alias("leaves"), zero.alias("saved"))
           .unionByName(sums.filter("depth = 1").select(zero.alias("n_children"), "leaves", "saved"))
           .agg(F.coalesce(F.sum("n_children"), zero).alias("n_children"), F.coalesce(F.sum("leaves"), zero).alias("leaves"),
                F.coalesce(F.sum("saved"), zero).alias("saved"))
           .select(F.lit(root).cast("long").alias("conv"), zero.alias("depth"), F.lit(members).cast("long").alias("n_convs"),
                   F.lit(None).cast("long").alias("parent"), "n_children",
                   F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), "saved")
           .filter(F.col("conv").isNotNull()))
    kept = (nodes.select("conv", "depth", "n_convs", "parent").join(sums, ["conv", "depth"]).unionByName(top)
            .join(sha, ["conv", "depth"], "left"))
    several = kept.select(*_node(F.col("conv"), F.col("parent"), F.col("n_convs"), F.col("n_children"), F.col("leaves"),
                                 F.col("saved"), F.coalesce("sha", F.lit(_EMPTY))))
    return several.unionByName(_single_nodes(single, F.coalesce("parent", "conv"))).unionByName(tails)


# ------------------------------------------------------------------ splicing

def splice(digested: DataFrame, share: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: conversation ``conv`` takes the first ``share`` turns
    of conversation ``base`` (all if it has fewer, none if there is none) and then
    its own turns after its first ``share``. ``share`` (0 to ``most``) and ``base``
    are expressions of ``conv``; a base is its own base, and few conversations have
    the same. Returns the rows and the conversations that ``trie`` takes."""
    known = parquet_stage(lengths(digested), "splice-lengths")
    plan = (known.select("conv", F.col("n").alias("own"), share.cast("long").alias("share"), base.alias("base"))
            .join(known.select(F.col("conv").alias("base"), F.least("n", F.lit(most)).alias("there")), "base", "left")
            .withColumn("lead", F.least("share", F.coalesce("there", F.lit(0))))
            .withColumn("n", (F.col("lead") + F.greatest(F.col("own") - F.col("share"), F.lit(0))).cast("long")))
    plan = parquet_stage(plan.select("conv", "base", "own", "share", "lead", "n"), "splice-plan")
    own = _split_lookup(digested, plan.select("conv", "own", "share", "lead", "n"), ["conv"], "own", digested.count())
    own = own.filter("pos > share").select("conv", (F.col("pos") - F.col("share") + F.col("lead")).alias("depth"), "a", "b", "bytes", "n")
    first = digested.filter((F.col("pos") <= most) & (F.col("conv") == base)).withColumnRenamed("conv", "base")
    lead = (first.join(plan.select("conv", "base", "share", "n"), "base").filter("pos <= share")
            .select("conv", F.col("pos").alias("depth"), "a", "b", "bytes", "n"))
    return own.unionByName(lead), plan.select("conv", "n")
