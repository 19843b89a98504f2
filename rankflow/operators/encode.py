"""Categorical encoders (J1-J6): ``fit`` on training rows -> model ->
``transform`` any rows. Fitted state is a dictionary table
``(feature, value, ...)`` stored as parquet in the shared folder: the planner
knows its bytes and picks the join, the same code for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from ..functions.indexing import global_index, range_parts
from ..session import materialize

MISSING = "missing"


def key_string(df: DataFrame, c: str) -> Column:
    """String form of a category. Integral columns go through ``long`` so
    that 123 and a nullable 123 both read '123' (never '123.0')."""
    t = df.schema[c].dataType
    if isinstance(t, (ByteType, ShortType, IntegerType, LongType)):
        return F.col(c).cast("long").cast("string")
    if isinstance(t, StringType):
        return F.col(c)
    return F.col(c).cast("string")


def _stack(df: DataFrame, columns: list[str], fill_missing: bool) -> DataFrame:
    """(feature, value) for every row and column; nulls become 'missing' or
    are dropped. One pass, no per-column job."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"),
                             (F.coalesce(key_string(df, c), F.lit(MISSING)) if fill_missing
                              else key_string(df, c)).alias("value")) for c in columns])
    out = df.select(F.inline(arr))
    return out if fill_missing else out.filter(F.col("value").isNotNull())


def _lookup(df: DataFrame, dictionary: DataFrame, feature: str, key: Column, value_col: str, out: str) -> DataFrame:
    d = dictionary.filter(F.col("feature") == feature).select(
        F.col("value").alias(f"_k_{out}"), F.col(value_col).alias(out))
    return df.join(d, key == F.col(f"_k_{out}"), "left").drop(f"_k_{out}")


class LabelEncoderModel:
    def __init__(self, columns, dictionary, missing_codes, suffix, with_missing):
        self.columns, self.dictionary, self.missing_codes = columns, dictionary, missing_codes
        self.suffix, self.with_missing = suffix, with_missing

    def transform(self, df: DataFrame) -> DataFrame:
        """Unseen and null values take the code of 'missing' (J1) or -1."""
        for c in self.columns:
            out = f"{c}{self.suffix}" if self.suffix else c
            key = F.coalesce(key_string(df, c), F.lit(MISSING)) if self.with_missing else key_string(df, c)
            tmp = f"_{c}_code"
            df = _lookup(df, self.dictionary, c, key, "code", tmp)
            df = df.withColumn(out, F.coalesce(F.col(tmp), F.lit(self.missing_codes[c])).cast("int")).drop(tmp)
        return df


class LabelEncoder:
    """code = position of the value among the sorted distinct training
    values, 'missing' always being a class (null and unseen map to it).
    J4 (``with_missing=False``): category codes, null and unseen -> -1.
    ``suffix=''`` replaces the column in place (the matrix-preparation form)."""

    def __init__(self, columns: list[str], suffix: str = "_encoded", with_missing: bool = True):
        self.columns, self.suffix, self.with_missing = list(columns), suffix, with_missing

    def fit(self, df: DataFrame) -> LabelEncoderModel:
        vals = _stack(df, self.columns, self.with_missing)
        if self.with_missing:
            spark = df.sparkSession
            extra = spark.createDataFrame([(c, MISSING) for c in self.columns], "feature string, value string")
            vals = vals.unionByName(extra)
        vals = vals.distinct()
        idx = global_index(vals, [F.col("feature"), F.col("value")])
        start = idx.groupBy("feature").agg(F.min("_idx").alias("_start"), F.count(F.lit(1)).alias("_n"))
        dictionary = (idx.join(F.broadcast(start), "feature")
                         .select("feature", "value", (F.col("_idx") - F.col("_start")).cast("int").alias("code")))
        dictionary = materialize(dictionary, "label-codes")
        if self.with_missing:
            meta = dictionary.filter(F.col("value") == MISSING).collect()        # one row per column
            missing_codes = {r["feature"]: int(r["code"]) for r in meta}
        else:
            missing_codes = {c: -1 for c in self.columns}
        return LabelEncoderModel(self.columns, dictionary, missing_codes, self.suffix, self.with_missing)


class FrequencyEncoderModel:
    def __init__(self, columns, dictionary, drop_source):
        self.columns, self.dictionary, self.drop_source = columns, dictionary, drop_source

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            out = f"{c}_freq"
            df = _lookup(df, self.dictionary, c, key_string(df, c), "count", out)
            df = df.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))
        return df.drop(*self.columns) if self.drop_source else df


class FrequencyEncoder:
    """``<col>_freq`` = training count of the value; null / unseen -> 0;
    the source column is dropped. Counting is a partial aggregation."""

    def __init__(self, columns: list[str], drop_source: bool = True):
        self.columns, self.drop_source = list(columns), drop_source

    def fit(self, df: DataFrame) -> FrequencyEncoderModel:
        d = (_stack(df, self.columns, fill_missing=False)
             .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count")))
        return FrequencyEncoderModel(self.columns, materialize(d, "value-counts"), self.drop_source)


class CardinalityEncoderModel:
    def __init__(self, freq_model, label_model, routes):
        self.freq_model, self.label_model, self.routes = freq_model, label_model, routes

    def transform(self, df: DataFrame) -> DataFrame:
        if self.freq_model:
            df = self.freq_model.transform(df)
        if self.label_model:
            df = self.label_model.transform(df)
        return df


class CardinalityEncoder:
    """String columns with more than ``threshold`` distinct training
    values get frequency encoding, the rest label codes in place. The
    distinct counts of all columns come from one aggregate."""

    def __init__(self, columns: list[str] | None = None, threshold: int = 1000, exact: bool = True):
        self.columns, self.threshold, self.exact = columns, threshold, exact

    def fit(self, df: DataFrame) -> CardinalityEncoderModel:
        cols = self.columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        fn = F.count_distinct if self.exact else F.approx_count_distinct
        counts = df.agg(*[fn(F.col(c)).alias(c) for c in cols]).first().asDict()
        high = [c for c in cols if counts[c] > self.threshold]
        low = [c for c in cols if c not in high]
        fm = FrequencyEncoder(high).fit(df) if high else None
        lm = LabelEncoder(low, suffix="").fit(df) if low else None
        routes = {c: ("frequency" if c in high else "label") for c in cols}
        return CardinalityEncoderModel(fm, lm, routes)


class TargetEncoderModel:
    def __init__(self, columns, dictionary, global_mean):
        self.columns, self.dictionary, self.global_mean = columns, dictionary, global_mean

    def transform(self, df: DataFrame) -> DataFrame:
        """Null and unseen categories take the training global mean."""
        for c in self.columns:
            out = f"{c}_target_encoded"
            df = _lookup(df, self.dictionary, c, key_string(df, c), "enc", out)
            df = df.withColumn(out, F.coalesce(F.col(out), F.lit(self.global_mean)))
        return df


class TargetEncoder:
    """Smoothed target mean ``(sum + global * m) / (count + m)`` per
    category, only for columns with more than ``min_distinct`` distinct
    training values. Applied to the training rows themselves it is
    in-sample (as the reference does)."""

    def __init__(self, columns: list[str], target: str = "selected", smoothing: float = 10.0,
                 min_distinct: int = 10):
        self.columns, self.target, self.m = list(columns), target, float(smoothing)
        self.min_distinct = min_distinct

    def fit(self, df: DataFrame) -> TargetEncoderModel:
        cols = [c for c in self.columns if c in df.columns]
        row = df.agg(F.avg(self.target).alias("_gm")).first()
        gm = float(row["_gm"]) if row["_gm"] is not None else 0.0
        if not cols:
            return TargetEncoderModel([], None, gm)
        arr = F.array(*[F.struct(F.lit(c).alias("feature"), key_string(df, c).alias("value"),
                                 F.col(self.target).alias("_y")) for c in cols])
        stats = (df.select(F.inline(arr)).filter(F.col("value").isNotNull())
                   .groupBy("feature", "value")
                   .agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n")))
        d = materialize(stats.select("feature", "value", (
            (F.col("_s") + F.lit(gm) * F.lit(self.m)) / (F.col("_n") + F.lit(self.m))).alias("enc")), "target-means")
        # the dictionary already has a row per distinct value
        sizes = {r["feature"]: r["n"] for r in d.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        return TargetEncoderModel([c for c in cols if sizes.get(c, 0) > self.min_distinct], d, gm)


class OrderedTargetEncoder:
    """J5 (ordered): a training row's code uses only the labels of rows before it
    in a seeded order (md5 of seed and row id), so it never sees its own label:
    ``(sum before + global * m) / (count before + m)``. Test rows take the whole
    statistics (``fit`` of ``TargetEncoder``).

    Prefix sums run in slices of the order (category, md5): a category of any size is
    spread over as many slices as it fills, and each slice adds the sums of those
    before it, one row per slice and category that reaches into it."""

    def __init__(self, columns: list[str], target: str = "selected", smoothing: float = 10.0, seed: int = 42, row_id: str = "Id"):
        self.columns, self.target, self.m, self.seed, self.row_id = list(columns), target, float(smoothing), seed, row_id

    def fit(self, df: DataFrame) -> TargetEncoderModel:
        return TargetEncoder(self.columns, self.target, self.m, min_distinct=0).fit(df)

    def fit_transform(self, df: DataFrame, slices: int | None = None) -> tuple[TargetEncoderModel, DataFrame]:
        """The model for other rows, and the training rows with a column
        ``<name>_target_ordered`` for each column. A null category takes the
        global mean; a row without a label counts for none. Row ids are unique."""
        df = materialize(df, "ordered-input")
        model = self.fit(df)
        n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = F.md5(F.concat(F.lit(f"{self.seed}_"), F.col(self.row_id).cast("string")))
        one = F.array(*[F.struct(F.lit(c).alias("feature"), key_string(df, c).alias("value")) for c in self.columns])
        rows = (df.select(F.col(self.row_id).alias("_id"), F.col(self.target).cast("double").alias("_y"), order.alias("_h"),
                          F.explode(one).alias("_c")).select("_id", "_y", "_h", "_c.feature", "_c.value").filter("value IS NOT NULL"))
        parts = range_parts(rows, n, "feature", "value", "_h", "_id")
        y, counted = F.coalesce("_y", F.lit(0.0)), F.col("_y").isNotNull().cast("long")
        sums = parts.groupBy("feature", "value", "_pid").agg(F.sum(y).alias("s"), F.sum(counted).alias("n"))
        ahead = Window.partitionBy("feature", "value").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select("feature", "value", "_pid", F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("s0"),
                             F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"))
        inside = Window.partitionBy("feature", "value", "_pid").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1)
        s = F.col("s0") + F.coalesce(F.sum(y).over(inside), F.lit(0.0))
        c = F.col("n0") + F.coalesce(F.sum(counted).over(inside), F.lit(0))
        gm = F.lit(model.global_mean)
        coded = parts.join(before, ["feature", "value", "_pid"]).select("_id", "feature", ((s + gm * self.m) / (c + self.m)).alias("enc"))
        wide = coded.groupBy("_id").agg(*[F.max(F.when(F.col("feature") == name, F.col("enc"))).alias(f"{name}_target_ordered")
                                          for name in self.columns])
        out = df.join(wide, df[self.row_id] == wide["_id"], "left").drop("_id")
        return model, out.fillna(model.global_mean, subset=[f"{name}_target_ordered" for name in self.columns])
