"""Projection, filtering and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DateType, DecimalType, DoubleType,
                               FloatType, IntegerType, LongType, NumericType, ShortType,
                               TimestampNTZType, TimestampType)

from ..functions.indexing import exact_quantiles
from .encode import LabelEncoder
from .features import engineer_features

ESSENTIAL = ("Id", "ranker_id")

# The compact feature set's numeric columns, in order.
SIMPLE_NUMERIC = ["totalPrice", "taxes", "price_log", "tax_ratio",
                  "request_hour", "request_day_of_week", "is_weekend", "is_business_hours",
                  "total_segments", "has_connections", "route_length", "is_round_trip",
                  "unique_carriers"]
# Categorical columns label-encoded by the compact feature set.
SIMPLE_CATEGORICAL = ["corporateTariffCode", "profileId", "companyID", "nationality", "primary_carrier"]


def simple_segments(df: DataFrame) -> DataFrame:
    """Compact form of E5: non-null segment durations and ``> 1``."""
    seg = [c for c in df.columns if "segments" in c and "duration" in c]
    if not seg:
        return df
    total = sum((F.col(c).isNotNull().cast("int") for c in seg[1:]), F.col(seg[0]).isNotNull().cast("int"))
    return df.withColumns({"total_segments": total,
                           "has_connections": F.coalesce(total > 1, F.lit(False)).cast("int")})


def simple_features(df: DataFrame) -> DataFrame:
    """The compact family chain before encoding (C3 flags included)."""
    return simple_segments(engineer_features(df, "simple"))


def select_features(df: DataFrame, label: str = "selected") -> DataFrame:
    """C4: fixed numeric list + ``*_flag`` + ``*_encoded`` columns, each
    coerced to double with missing -> 0; ``Id``, ``ranker_id`` and the label
    are kept first."""
    flags = [c for c in df.columns if c.endswith("_flag")]
    enc = [c for c in df.columns if c.endswith("_encoded")]
    feats = [c for c in SIMPLE_NUMERIC + flags + enc if c in df.columns]
    keep = [c for c in ESSENTIAL if c in df.columns] + ([label] if label in df.columns else [])
    return df.select(*keep, *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in feats])


def fit_simple_encoder(train: DataFrame) -> "LabelEncoder":
    """Label encoders of the compact set, fitted on (featured) training rows."""
    cols = [c for c in SIMPLE_CATEGORICAL if c in train.columns]
    return LabelEncoder(cols).fit(train)


def simple_feature_table(train: DataFrame, test: DataFrame | None = None, label: str = "selected"):
    """The compact 22-feature pipeline: families, encoders fitted on train
    and applied to both sides, final select, then C9 alignment."""
    tr = simple_features(train)
    model = fit_simple_encoder(tr)
    tr_out = select_features(model.transform(tr), label)
    if test is None:
        return tr_out, None, model
    te_out = select_features(model.transform(simple_features(test)), label)
    tr_out, te_out = align(tr_out, te_out, label)
    return tr_out, te_out, model


def align(train: DataFrame, test: DataFrame, label: str = "selected"):
    """Keep the feature columns present on both sides, in train order."""
    key = [c for c in ESSENTIAL if c in train.columns]
    feats = [c for c in train.columns if c not in key and c != label and c in test.columns]
    tr_cols = key + ([label] if label in train.columns else []) + feats
    return train.select(*tr_cols), test.select(*[c for c in key if c in test.columns], *feats)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Names of numeric (and boolean) columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in exclude]


def keep_numeric(df: DataFrame, exclude=()) -> DataFrame:
    """Drop every non-numeric column."""
    return df.select(*numeric_columns(df, exclude))


def datetimes_to_epoch(df: DataFrame) -> DataFrame:
    """Timestamp / date columns -> epoch seconds (null stays null).
    Wall-clock values (timestamp_ntz, date) are measured from the naive
    epoch, so the result does not depend on the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, TimestampType):
            cols[f.name] = F.unix_seconds(F.col(f.name))
        elif isinstance(f.dataType, (TimestampNTZType, DateType)):
            cols[f.name] = F.timestamp_diff("SECOND", epoch, F.col(f.name).cast("timestamp_ntz"))
    return df.withColumns(cols) if cols else df


class MedianImputerModel:
    def __init__(self, medians: dict[str, float]):
        self.medians = medians

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {c: F.coalesce(F.col(c), F.lit(m)) for c, m in self.medians.items()
                if c in df.columns and m is not None}
        return df.withColumns(cols) if cols else df


class MedianImputer:
    """Fill nulls of numeric columns with the exact (interpolated)
    training median. Every column gets one: a gap may show up in the test
    rows only. The medians come from counted, range-partitioned values."""

    def __init__(self, columns: list[str] | None = None):
        self.columns = columns

    def fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.columns or numeric_columns(df)
        cols = [c for c in cols if not isinstance(df.schema[c].dataType, BooleanType)]
        if not cols:
            return MedianImputerModel({})
        return MedianImputerModel({c: m for (c, _), m in exact_quantiles(df, cols, (0.5,)).items()})


_INT_STEPS = [("tinyint", -128, 127), ("smallint", -32768, 32767),
              ("int", -2147483648, 2147483647), ("bigint", -(2 ** 63), 2 ** 63 - 1)]
_F16_MAX = 65504.0
_F32_MAX = 3.4028234663852886e38


def downsize_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One aggregate of min / max per numeric column, then the smallest
    type whose bounds strictly contain them (floats -> float unless beyond
    float32). Returns ``(column, old_type, new_type, min, max)``."""
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, (ByteType, ShortType, IntegerType, LongType,
                                                  FloatType, DoubleType, DecimalType))]
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c)).cast("double").alias(f"mn_{c}"), F.max(F.col(c)).cast("double").alias(f"mx_{c}")]
    one = df.agg(*aggs)
    rows = []
    for c in cols:
        t = df.schema[c].dataType
        mn, mx = F.col(f"mn_{c}"), F.col(f"mx_{c}")
        if isinstance(t, (ByteType, ShortType, IntegerType, LongType)):
            new = F.lit(t.simpleString())
            for name, lo, hi in reversed(_INT_STEPS):
                new = F.when((mn > lo) & (mx < hi), F.lit(name)).otherwise(new)
        else:
            new = (F.when((mn > -_F16_MAX) & (mx < _F16_MAX), F.lit("float"))
                    .when((mn > -_F32_MAX) & (mx < _F32_MAX), F.lit("float"))
                    .otherwise(F.lit("double")))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(t.simpleString()).alias("old_type"),
                             new.alias("new_type"), mn.alias("min"), mx.alias("max")))
    return one.select(F.inline(F.array(*rows)))


def apply_downsize(df: DataFrame, report_rows: list) -> DataFrame:
    """Cast columns to the types chosen by ``downsize_report`` (the
    report is one row per column, small by construction)."""
    cols = {r["column"]: F.col(r["column"]).cast(r["new_type"]) for r in report_rows
            if r["new_type"] != r["old_type"]}
    return df.withColumns(cols) if cols else df


def filter_labelled(df: DataFrame, label: str = "selected") -> DataFrame:
    """C11: positive rows only."""
    return df.filter(F.col(label) == 1)


def filter_group_size(df: DataFrame, min_size: int, group: str = "ranker_id") -> DataFrame:
    """C11: rows of sessions with more than ``min_size`` rows (partial count
    + semi join, no window over whole sessions)."""
    big = (df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > min_size).select(group))
    return df.join(big, group, "left_semi")


def drop_label(df: DataFrame, label: str = "selected") -> DataFrame:
    """Test side never carries the label."""
    return df.drop(label)
