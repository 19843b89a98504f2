"""Per-session rank expressions (window functions over the session key).

All windows here partition by the session key only (or by session plus
value, which Spark satisfies from the same hash partitioning), so any number
of them in one ``select`` share a single Exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .exprs import col


def _keys(group) -> list:
    return [group] if isinstance(group, (str, Column)) else list(group)


def avg_rank(value, group="ranker_id") -> Column:
    """pandas ``groupby().rank()`` (method='average', ascending): ties share
    the mean of their positions, a null value keeps a null rank."""
    v = col(value)
    g = _keys(group)
    first = F.rank().over(Window.partitionBy(*g).orderBy(v.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*g, v))
    return F.when(v.isNotNull(), first + (ties - 1) / F.lit(2.0))


def pct_rank(value, group="ranker_id") -> Column:
    """pandas ``rank(pct=True)``: average rank / non-null count in group."""
    v = col(value)
    n = F.count(v).over(Window.partitionBy(*_keys(group)))
    return avg_rank(v, group) / n


def dense_rank_desc(score, group="ranker_id") -> Column:
    """pandas ``rank(method='dense', ascending=False)``; null stays null."""
    s = col(score)
    r = F.dense_rank().over(Window.partitionBy(*_keys(group)).orderBy(s.desc_nulls_last()))
    return F.when(s.isNotNull(), r)


def strict_rank(score, group="ranker_id", tiebreak="Id", ascending: bool = False) -> Column:
    """A permutation 1..n per group: best score first, ties broken by ``tiebreak``.
    This is what a submission must contain."""
    s = col(score)
    order = s.asc_nulls_last() if ascending else s.desc_nulls_last()
    return F.row_number().over(Window.partitionBy(*_keys(group)).orderBy(order, col(tiebreak).asc()))


def random_rank(group="ranker_id", row_id="Id", seed: int = 42) -> Column:
    """Deterministic pseudo-random permutation per group: order by
    ``md5(seed || '_' || id)``. Same in every engine that has md5."""
    h = F.md5(F.concat(F.lit(f"{seed}_"), col(row_id).cast("string")))
    return F.row_number().over(Window.partitionBy(*_keys(group)).orderBy(h, col(row_id)))


def group_count(group="ranker_id") -> Column:
    """``transform('count')``: rows in the group, nulls included."""
    return F.count(F.lit(1)).over(Window.partitionBy(*_keys(group)))
