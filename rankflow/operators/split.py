"""Session-aware train/test split (K1) and group k-fold (K2, K3).

No session ever crosses a split or fold. The default assignment hashes the
session key (md5), so it is stable as data grows and costs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indexing import attach_row, global_index

GROUP = "ranker_id"


def key_hash32(key, seed: int | None = None) -> Column:
    """First 32 bits of ``md5([seed_]key)`` as a non-negative long (the same
    value DuckDB gets from ``CAST('0x' || substr(md5(..), 1, 8) AS BIGINT)``)."""
    k = F.col(key).cast("string") if isinstance(key, str) else key.cast("string")
    s = k if seed is None else F.concat(F.lit(f"{seed}_"), k)
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def split_flag(group: str = GROUP, test_ratio: float = 0.3, seed: int = 42) -> Column:
    """True for test sessions: hash bucket in [1 - test_ratio, 1)."""
    u = key_hash32(group, seed) / F.lit(4294967296.0)
    return u >= F.lit(1.0 - test_ratio)


def group_split(df: DataFrame, test_ratio: float = 0.3, seed: int = 42, group: str = GROUP,
                label: str | None = "selected") -> tuple[DataFrame, DataFrame]:
    """K1 (hash mode) + C5: train rows and test rows (label dropped)."""
    flag = split_flag(group, test_ratio, seed)
    train = df.filter(~flag)
    test = df.filter(flag)
    if label and label in df.columns:
        test = test.drop(label)
    return train, test


def exact_split_keys(df: DataFrame, test_ratio: float = 0.3, seed: int = 42,
                     group: str = GROUP) -> DataFrame:
    """K1 (exact mode): sessions ordered by md5, the first
    ``floor(n * (1 - test_ratio))`` are train. Returns ``(group, is_test)``,
    one row per session; the global index is distributed."""
    keys = df.select(group).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}_"),
                                                                      F.col(group).cast("string"))))
    idx = global_index(keys, [F.col("_h"), F.col(group)])
    n = keys.agg(F.count(F.lit(1)).alias("_n"))
    return (attach_row(idx, n)
               .select(group, (F.col("_idx") >= F.floor(F.col("_n") * (1 - test_ratio))).alias("is_test")))


def hash_folds(df: DataFrame, k: int = 5, group: str = GROUP, name: str = "fold") -> DataFrame:
    """K2 (default): fold = md5-hash of the session key mod k. No shuffle."""
    return df.withColumn(name, (key_hash32(group) % k).cast("int"))


def balanced_fold_keys(df: DataFrame, k: int = 5, group: str = GROUP) -> DataFrame:
    """K2 (balanced): sessions ordered by (size desc, key) are dealt to folds
    in a serpentine 0..k-1, k-1..0, ... so fold sizes stay close. Returns
    ``(group, fold)`` per session; join it back with ``with_folds``."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    idx = global_index(sizes, [F.col("_size").desc(), F.col(group)])
    i, r = F.col("_idx"), F.col("_idx") % k
    fold = F.when((F.floor(i / k) % 2) == 0, r).otherwise(F.lit(k - 1) - r)
    return idx.select(group, fold.cast("int").alias("fold"))


def greedy_deal(runs: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """Sessions, largest first, each to the fold with the fewest rows so far (the
    first of equal ones), for runs ``(size, sessions)`` of falling size, without
    going session by session. While sessions of one size are dealt, fold ``j`` is
    chosen at the loads L_j, L_j + size, ...: a cycle deals one to each fold that
    takes part, by load modulo size, and a fold takes part from cycle
    floor((L_j - lowest) / size) on. Returns ``(size, first index, folds in turn)``
    of at most ``k`` phases per run."""
    loads, phases, index = [0] * k, [], 0
    for size, n in runs:
        low = min(loads)
        begins = [(load - low) // size for load in loads]
        turn = sorted(range(k), key=lambda j: ((loads[j] - low) % size, j))
        cycles = sorted(set(begins))
        for cycle, then in zip(cycles, [*cycles[1:], None]):
            folds = [j for j in turn if begins[j] <= cycle]
            take = n if then is None else min(n, (then - cycle) * len(folds))
            if not take:
                break
            phases.append((size, index, folds))
            for place, j in enumerate(folds):
                loads[j] += size * ((take - place + len(folds) - 1) // len(folds))
            index, n = index + take, n - take
    return phases


def greedy_fold_keys(df: DataFrame, k: int = 5, group: str = GROUP) -> DataFrame:
    """K2 (greedy): sessions by (size desc, key) go to the fold with the fewest
    rows so far. Only the table of sizes, (number of sessions of each; at most the
    root of twice the rows) is solved on the driver and sent to the sessions, which
    find their fold by their global index. Returns ``(group, fold)`` per session."""
    spark = df.sparkSession
    idx = global_index(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), [F.col("_size").desc(), F.col(group)])
    runs = [(r["_size"], r["n"]) for r in idx.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_size")).collect()]
    phases: dict[int, list] = {}
    for size, begin, folds in greedy_deal(runs, k):
        phases.setdefault(size, []).append((begin, folds))
    table = spark.createDataFrame(list(phases.items()), "_size long, _phases array<struct<begin:long,folds:array<int>>>")
    phase = F.element_at(F.filter("_phases", lambda p: p["begin"] <= F.col("_idx")), -1)
    found = idx.join(F.broadcast(table), "_size").withColumn("_p", phase)
    turn = (F.col("_idx") - F.col("_p.begin")) % F.size("_p.folds")
    return found.select(group, F.get("_p.folds", turn.cast("int")).alias("fold"))


def with_folds(df: DataFrame, fold_keys: DataFrame, group: str = GROUP) -> DataFrame:
    """K3: attach the fold column (one row per session on the right side)."""
    return df.join(fold_keys, group, "left")


def fold_frames(df: DataFrame, fold: int, name: str = "fold") -> tuple[DataFrame, DataFrame]:
    """K3: (training rows, validation rows) of one fold."""
    return df.filter(F.col(name) != fold), df.filter(F.col(name) == fold)
