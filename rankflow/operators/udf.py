"""User-function surface (P1u-P3u).

Built-in column expressions are always preferred; these helpers are the
Arrow-batched escape hatch for logic the caller owns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

FEATURE_REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def apply_rows(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """P2u: run a pandas function over Arrow batches of rows
    (``mapInPandas``); row-parallel, no shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield func(pdf)
    return df.mapInPandas(run, schema)


def apply_groups(df: DataFrame, keys, func: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """P1u: a pandas function per group (``applyInPandas``). Each group is
    materialised in one task, so use it only for groups of a known, small
    size (a search session); the built-in operators never rely on it."""
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).applyInPandas(func, schema)


def stream_groups(df: DataFrame, keys, order, step: Callable, schema, begin: Callable = lambda: None) -> DataFrame:
    """P1u for groups of any size: ``step(state, rows) -> (state, output)`` sees a
    group's rows in ``order``, a batch at a time, and carries what it needs in
    ``state`` (``begin()`` at each group's start). Memory holds one Arrow batch; a
    group still goes through one task, as a running function must."""
    keys, order = ([k] if isinstance(k, str) else list(k) for k in (keys, order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            number = pdf[keys].astype(object).where(pdf[keys].notna(), None)
            same = number.eq(number.shift()) | (number.isna() & number.shift().isna())
            starts = [0, *[i for i, new in enumerate(~same.all(axis=1)) if new and i], len(pdf)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                key = tuple(number.iloc[lo])
                if key != last:
                    last, state = key, begin()
                state, out = step(state, pdf.iloc[lo:hi])
                yield out
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def register_feature(name: str):
    """P3u: register a ``DataFrame -> DataFrame`` feature function; pass
    ``registered_features()`` as ``extra`` to ``engineer_features``."""
    def deco(fn):
        FEATURE_REGISTRY[name] = fn
        return fn
    return deco


def unregister_feature(name: str) -> None:
    """P3u: forget a registered feature function."""
    FEATURE_REGISTRY.pop(name, None)


def registered_features() -> list[Callable[[DataFrame], DataFrame]]:
    return list(FEATURE_REGISTRY.values())
