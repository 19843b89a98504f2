"""Column expressions that reproduce pandas null / NaN semantics in Spark.

Every helper returns a ``Column`` built from built-in functions only, so it
stays inside whole-stage codegen. ANSI mode is assumed on: divisions use
``try_divide`` and parses use ``try_cast`` / ``try_to_timestamp``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


_CACHE: dict = {}


def _cached(key, make):
    """Column objects are unresolved, immutable references; building each
    one is a JVM round trip from Python, so repeated names / literals reuse
    one object (per running SparkContext)."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    k = (id(sc), key)
    c = _CACHE.get(k)
    if c is None:
        if len(_CACHE) > 20000:
            _CACHE.clear()
        c = _CACHE[k] = make()
    return c


def col(c) -> Column:
    if isinstance(c, str):
        return _cached(("col", c), lambda: F.col(c))
    return c


def lit(v) -> Column:
    return _cached(("lit", type(v).__name__, v), lambda: F.lit(v))


def cols(cs: Iterable) -> list[Column]:
    return [col(c) for c in cs]


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int where null (a NaN comparison in pandas) is 0."""
    return F.coalesce(cond, lit(False)).cast("int")


def ne_nan(a, b) -> Column:
    """pandas ``a != b``: true when either side is missing."""
    return ~F.coalesce(col(a) == col(b), lit(False))


def safe_div(n, d, fill: float = 0.0) -> Column:
    """Denominator 0 -> ``fill``; null denominator -> null; else n / d."""
    n, d = col(n), col(d)
    return F.when(d == 0, F.lit(float(fill))).otherwise(F.try_divide(n, d).cast("double"))


def eps_div(n, d, eps: float = 1e-6) -> Column:
    """``n / (d + eps)``; never raises under ANSI."""
    return F.try_divide(col(n).cast("double"), col(d) + F.lit(eps))


def clip_lower(x, lo: float = 0.0) -> Column:
    """pandas ``clip(lower=lo)``: null stays null."""
    x = col(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(x, F.lit(lo)))


def row_sum(cs: Iterable) -> Column:
    """``sum(axis=1)``: nulls skipped, all-null -> 0."""
    cs = cols(cs)
    out = F.coalesce(cs[0], lit(0))
    for c in cs[1:]:
        out = out + F.coalesce(c, lit(0))
    return out


def row_count(cs: Iterable) -> Column:
    """Number of non-null values in the row."""
    cs = cols(cs)
    out = cs[0].isNotNull().cast("int")
    for c in cs[1:]:
        out = out + c.isNotNull().cast("int")
    return out


def row_min(cs: Iterable) -> Column:
    """``min(axis=1)``: nulls skipped, all-null -> null (``least`` skips nulls)."""
    cs = cols(cs)
    return cs[0] if len(cs) == 1 else F.least(*cs)


def row_max(cs: Iterable) -> Column:
    cs = cols(cs)
    return cs[0] if len(cs) == 1 else F.greatest(*cs)


def row_mean(cs: Iterable) -> Column:
    """``mean(axis=1)``: mean of the non-null values, null when none."""
    cs = list(cs)
    n = row_count(cs)
    return F.when(n > 0, row_sum(cs).cast("double") / n)


def row_nunique(cs: Iterable, count_missing: bool = False) -> Column:
    """Distinct values in the row; nulls skipped, or counted as one value
    ``'missing'`` when ``count_missing`` (the ``fillna('missing')`` form)."""
    cs = cols(cs)
    if count_missing:
        arr = F.array(*[F.coalesce(c.cast("string"), F.lit("missing")) for c in cs])
        return F.size(F.array_distinct(arr))
    return F.size(F.array_distinct(F.array_compact(F.array(*cs))))


def any_equals(cs: Iterable, value) -> Column:
    """1 when any column equals ``value`` (a literal or a column), else 0."""
    v = value if isinstance(value, Column) else F.lit(value)
    flags = [flag(c == v) for c in cols(cs)]
    return flags[0] if len(flags) == 1 else F.greatest(*flags)


def all_equal_first(cs: Iterable) -> Column:
    """1 when every later column is null or equals the first one (the
    ``&=`` loop form). A null first value with any later value set gives 0."""
    cs = cols(cs)
    first = cs[0]
    conds = [c.isNull() | F.coalesce(c == first, F.lit(False)) for c in cs[1:]]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return flag(out)


def to_ts(c) -> Column:
    """Tolerant timestamp parse: strings go through ``try_to_timestamp``,
    timestamps pass through."""
    return F.try_to_timestamp(col(c).cast("string"))


def seconds_between(end, start) -> Column:
    """Signed seconds ``end - start`` for timestamp / timestamp_ntz."""
    return F.timestamp_diff("SECOND", col(start), col(end))


def floor_days(end, start) -> Column:
    """pandas ``Timedelta.days``: floors, so -10 hours is -1 day."""
    return F.floor(seconds_between(end, start) / F.lit(86400)).cast("int")


def weekday0(c) -> Column:
    """Day of week with Monday = 0 (pandas ``dt.dayofweek``)."""
    return F.weekday(col(c))


def tolerant_double(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: bad values -> null."""
    return col(c).try_cast("double")


def numeric_or_zero(c) -> Column:
    """``pd.to_numeric(errors='coerce').fillna(0)``."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def nan_to_null(c) -> Column:
    """NaN is pandas' missing marker; Spark keeps NaN apart from null."""
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def sql_round(c, scale: int = 6) -> Column:
    """Round as ``round(x * 10^scale) / 10^scale`` (half away from zero on the
    scaled product). Spark's ``round`` works on the shortest decimal form of
    the double instead, which differs at exact halves after a division; this
    form gives bit-identical results to SQL engines that scale first."""
    f = float(10 ** scale)
    return F.round(col(c).cast("double") * F.lit(f), 0) / F.lit(f)


round6 = sql_round
