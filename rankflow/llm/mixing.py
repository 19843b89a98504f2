"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue that sends its documents in a seeded shuffled order.
A document's *virtual finish time* is the number of words its source has
sent, this document included, divided by the source's target. One global
order of finish times interleaves all sources in proportion to their
targets; the mix is that order, cut at the total budget. A source whose
target exceeds its size sends its documents again (a second and third pass).

Running sums never gather a source, or the whole corpus, in one task: rows
are dealt into small cells of the shuffle order (or of the finish time),
summed per cell, and only the cell sums are accumulated in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parquet_stage, power_of_two, word_count

CYCLE = (1, 2, 3)        # weights of the sources in order, repeating
MAX_PASSES = 3           # a source is never asked for more than this many passes
CELL_ROWS = 20_000       # rows that one running-sum cell aims at


def source_targets(sized: DataFrame, cycle=CYCLE, max_passes=MAX_PASSES) -> DataFrame:
    """``sized(source, size)`` -> ``source, source_size, target``.

    Sources in code point order (null last) take the weights of ``cycle`` in
    turn and share the sum of all sizes. A target stops at ``max_passes``
    times its source's size; the excess goes to the others by weight until
    none is above: with sources ordered by size / weight, the first ``k``
    are at their limit, where ``k`` is the least for which the level of the
    others fits the next one. One row per source from the aggregate on.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("ratio"), F.col("rank"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(w) for w in cycle])
    s = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("rank", F.row_number().over(by_name))
         .withColumn("w", F.element_at(weights, ((F.col("rank") - 1) % len(cycle) + 1).cast("int")))
         .withColumn("limit", max_passes * F.col("source_size"))
         .withColumn("ratio", F.col("limit").cast("double") / F.col("w"))
         .withColumn("rest", (F.sum("source_size").over(everything)
                              - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double"))
         .withColumn("level", F.col("rest") / F.sum("w").over(after)))
    # the level of the first source that is not cut holds for all after it
    s = s.withColumn("fair", F.min(F.when(F.col("level") <= F.col("ratio"),
                                          F.struct("ratio", "rank", "level"))).over(everything))
    at_limit = F.col("fair").isNull() | (F.struct("ratio", "rank") < F.struct("fair.ratio", "fair.rank"))
    return s.select("source", "source_size",
                    F.when(at_limit, F.col("limit").cast("double"))
                    .otherwise(F.col("fair.level") * F.col("w")).alias("target"))


def _running(df: DataFrame, keys: list[str], cell: str, order: list, value: str, out: str) -> DataFrame:
    """``out`` = running sum of ``value`` in (``cell``, ``order``) within
    ``keys``, this row included, without a task that holds all of a key."""
    k = [*keys, cell]
    sums = df.groupBy(*k).agg(F.sum(value).alias("cell_sum"))
    ahead = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sums.withColumn("offset", F.sum("cell_sum").over(
        ahead.orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cell_sum")).drop("cell_sum")
    on = None
    for c in k:
        one = df[c].eqNullSafe(offsets[c])
        on = one if on is None else on & one
    inner = Window.partitionBy(*[df[c] for c in k]).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (df.join(offsets, on).select(*[df[c] for c in df.columns],
                                        (F.col("offset") + F.sum(value).over(inner)).alias(out)))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", seed: str = "mix", carry: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Decide what the mix takes. Returns two frames:

    * one row per input row: ``rid`` (row number of this run), ``id``, ``size``
      (words of the text), ``source_size``, ``target``, ``copies``, ``taken``
      (words taken, repeats counted), ``row`` (struct of ``carry``);
    * one row per taken copy: ``rid``, ``pass_no``, ``finish``.

    Null or empty texts have size 0 and are never taken; a null source is a
    source of its own; documents
    without an id are shuffled by a digest of their text; repeated
    rows are separate documents; an empty table gives empty frames. Other
    columns are ignored unless named in ``carry``. Rows with the same id are
    ordered by size, so reruns take the same words.
    """
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    base = parquet_stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit("")))).alias("turn"),
        row.alias("row")), "mix-base")
    thin = base.select("rid", "source", "size", "turn")
    targets = source_targets(thin)
    n_rows, budget = thin.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cells = min(1 << 20, power_of_two(n_rows / CELL_ROWS))
    width = (1 << 20) // cells
    cell = F.floor(F.conv(F.substring("turn", 1, 5), 16, 10).cast("long") / width)
    queued = _running(thin.filter("size > 0").withColumn("cell", cell), ["source"], "cell",
                      [F.col("turn"), F.col("size"), F.col("rid")], "size", "sent")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    sends = (queued.join(t, queued["source"].eqNullSafe(t["t_source"]))
             .withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))))
             .withColumn("through", F.col("pass_no") * F.col("source_size") + F.col("sent"))
             # a document that would start after its source's target is met is not queued
             .filter(F.col("through") - F.col("size") < F.col("target"))
             .withColumn("finish", F.col("through") / F.col("target"))
             .withColumn("cell", F.least(F.floor(F.col("finish") * cells), F.lit(2 * cells)))
             .select("rid", "turn", "size", "pass_no", "finish", "cell"))
    sends = parquet_stage(sends, "mix-sends")
    spent = _running(sends, [], "cell", [F.col("finish"), F.col("turn"), F.col("size"), F.col("rid"), F.col("pass_no")],
                     "size", "spent")
    taken = spent.filter(F.col("spent") <= budget).select("rid", "pass_no", "finish")
    copies = taken.groupBy("rid").agg(F.count("*").alias("copies"))
    t2 = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    decided = (base.join(copies, "rid", "left").join(t2, base["source"].eqNullSafe(t2["t_source"]))
               .withColumn("copies", F.coalesce("copies", F.lit(0)))
               .select("rid", "id", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"), "row"))
    return decided, taken


def mix_documents(docs: DataFrame, seed: str = "mix", **names) -> DataFrame:
    """The mix itself: the input's columns, a row for each time a document is
    taken, globally range-sorted by virtual finish time."""
    cols = list(docs.columns)
    decided, taken = plan_mix(docs, seed=seed, carry=cols, **names)
    return (decided.filter("copies > 0").select("rid", "row").join(taken, "rid")
            .orderBy("finish", "rid", "pass_no").select(*[F.col("row")[c].alias(c) for c in cols]))
