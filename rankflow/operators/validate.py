"""Data and submission validation (M1-M5) as aggregations.

"Ranks are exactly 1..n" is checked per session as min = 1, max = n and
distinct = n, which is equivalent for integers and needs no sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..functions.indexing import attach_row

ESSENTIAL = ("Id", "ranker_id")


def _issue(check: str, severity, value) -> F.Column:
    return F.struct(F.lit(check).alias("check"), severity.alias("severity"),
                    value.cast("double").alias("value"))


def check_train_test(train: DataFrame, test: DataFrame, label: str = "selected",
                     group: str = "ranker_id", rate_bounds=(0.001, 0.1)) -> DataFrame:
    """M2: ``(check, severity, value)`` rows. Schema checks are plan-time;
    the data checks are one aggregate over per-session label sums."""
    ok, warn, err = F.lit("ok"), F.lit("warning"), F.lit("error")
    schema_rows = [
        _issue("label_in_train", ok if label in train.columns else err, F.lit(int(label in train.columns))),
        _issue("label_not_in_test", warn if label in test.columns else ok, F.lit(int(label not in test.columns))),
    ]
    for c in ESSENTIAL:
        both = c in train.columns and c in test.columns
        schema_rows.append(_issue(f"essential_{c}", ok if both else err, F.lit(int(both))))
    if label not in train.columns:
        return train.limit(1).select(F.inline(F.array(*schema_rows)))
    per = train.groupBy(group).agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n"))
    agg = per.agg(F.sum("_s").alias("_pos"), F.sum("_n").alias("_rows"),
                  F.count_if(F.col("_s") != 1).alias("_bad"))
    rate = F.col("_pos") / F.col("_rows")
    lo, hi = rate_bounds
    data_rows = [
        _issue("selection_rate", F.when((rate < lo) | (rate > hi), warn).otherwise(ok), rate),
        _issue("sessions_not_one_selection", F.when(F.col("_bad") > 0, warn).otherwise(ok), F.col("_bad")),
    ]
    return agg.select(F.inline(F.array(*schema_rows, *data_rows)))


def _rank_groups(sub: DataFrame, group: str, rank: str) -> DataFrame:
    return sub.groupBy(group).agg(F.min(rank).alias("_min"), F.max(rank).alias("_max"),
                                  F.count(F.lit(1)).alias("_n"), F.count_distinct(rank).alias("_d"))


def _valid_group(min_c="_min", max_c="_max", n_c="_n", d_c="_d") -> F.Column:
    return (F.col(min_c) == 1) & (F.col(max_c) == F.col(n_c)) & (F.col(d_c) == F.col(n_c))


def check_submission(sub: DataFrame, test: DataFrame, group: str = "ranker_id",
                     rank: str = "selected") -> DataFrame:
    """M3: row counts, required columns, ranks a permutation per session,
    duplicate ranks. One row."""
    missing = [c for c in ("Id", group, rank) if c not in sub.columns]
    cols_ok = not missing
    # a missing column is reported, not raised: its values are null
    sub = sub.withColumns({c: F.lit(None).cast("int") for c in missing}) if missing else sub
    whole = F.col(rank).try_cast("double")
    sub = sub.withColumn("_whole", F.coalesce(whole == F.floor(whole), F.lit(False)))
    fraction = sub.groupBy(group).agg(F.count_if(~F.col("_whole")).alias("_f"))
    groups = _rank_groups(sub, group, rank).join(fraction.withColumnRenamed(group, "_fg"), F.col(group).eqNullSafe(F.col("_fg")))
    g = groups.agg(
        F.count_if(~F.coalesce(_valid_group() & (F.col("_f") == 0), F.lit(False))).alias("invalid_sessions"),
        F.count_if(F.col("_d") != F.col("_n")).alias("duplicate_rank_sessions"),
        F.sum("_n").alias("rows_submission"))
    t = test.agg(F.count(F.lit(1)).alias("rows_test"))
    j = attach_row(g, t)
    return j.select("rows_submission", "rows_test",
                    (F.col("rows_submission") == F.col("rows_test")).alias("row_count_ok"),
                    F.lit(cols_ok).alias("columns_ok"), "invalid_sessions", "duplicate_rank_sessions",
                    ((F.col("rows_submission") == F.col("rows_test")) & F.lit(cols_ok)
                     & (F.col("invalid_sessions") == 0)).alias("valid"))


def submission_report(sub: DataFrame, id_col: str = "Id", group: str = "ranker_id",
                      rank: str = "selected", samples: int = 5) -> DataFrame:
    """M4: duplicate ids, invalid sessions with up to ``samples`` example
    keys (smallest first), non-integer / non-positive ranks, and stats."""
    is_int = isinstance(sub.schema[rank].dataType, (ByteType, ShortType, IntegerType, LongType))
    groups = _rank_groups(sub, group, rank)
    bad = groups.filter(~_valid_group()).select(group)
    sample = (bad.orderBy(group).limit(samples)
                 .agg(F.sort_array(F.collect_list(group)).alias("sample_invalid_sessions")))
    g = groups.agg(F.count_if(~_valid_group()).alias("invalid_sessions"),
                   F.count(F.lit(1)).alias("total_groups"), F.sum("_n").alias("total_rows"),
                   F.min("_min").alias("min_rank"), F.max("_max").alias("max_rank"))
    dup = (sub.groupBy(id_col).agg(F.count(F.lit(1)).alias("_c"))
              .agg(F.count_if(F.col("_c") > 1).alias("duplicate_ids")))
    nonpos = sub.agg(F.count_if(F.col(rank) <= 0).alias("non_positive_ranks"))
    out = attach_row(attach_row(attach_row(g, dup), nonpos), sample)
    return out.select(
        "total_rows", "total_groups",
        (F.col("total_rows") / F.col("total_groups")).alias("avg_group_size"),
        F.col("min_rank").cast("double").alias("min_rank"), F.col("max_rank").cast("double").alias("max_rank"),
        "duplicate_ids", "invalid_sessions", "sample_invalid_sessions", "non_positive_ranks",
        F.lit(is_int).alias("integer_ranks"),
        ((F.col("duplicate_ids") == 0) & (F.col("invalid_sessions") == 0)
         & (F.col("non_positive_ranks") == 0) & F.lit(is_int)).alias("valid"))


def submission_summary(sub: DataFrame, group: str = "ranker_id", rank: str = "selected") -> DataFrame:
    """M5: sessions, rank range and mean session size."""
    return (sub.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_mn"),
                                   F.max(rank).alias("_mx"))
               .agg(F.count(F.lit(1)).alias("sessions"), F.min("_mn").alias("min_rank"),
                    F.max("_mx").alias("max_rank"), F.avg("_n").alias("mean_group_size")))
