"""Physical-plan checks: shuffles, pushdown, top-k limits, no Python UDFs
in the deterministic operators."""

import pytest

from rankflow.functions import ranking as R
from rankflow.operators import features as E
from rankflow.operators import metrics as M
from rankflow.operators import session as S
from rankflow.sources.views import options_view

from .conftest import SF_TINY


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def flat_options(spark, tmp_path_factory):
    """The option table written once as parquet (the gold layer)."""
    path = str(tmp_path_factory.mktemp("gold") / "options")
    options_view(spark, SF_TINY).write.parquet(path)
    return spark.read.parquet(path)


def test_feature_pipeline_single_exchange(spark, flat_options):
    df = S.add_session_features(E.engineer_features(flat_options, "full"))
    p = plan(df)
    assert p.count("Exchange hashpartitioning(ranker_id") == 1, p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns_and_pushes_filters(spark, flat_options):
    df = flat_options.filter("totalPrice > 100000").select("Id", "totalPrice")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(totalPrice), GreaterThan(totalPrice,100000.0)]" in p
    assert "ReadSchema: struct<Id:bigint,totalPrice:double>" in p


def test_topk_uses_window_group_limit(spark, flat_options):
    from pyspark.sql import functions as F
    top = S.topk_per_session(flat_options, F.col("totalPrice").asc(), 3)
    assert "WindowGroupLimit" in plan(top)


def test_options_view_reads_all_lines_once(spark):
    p = plan(options_view(spark, SF_TINY))
    assert "WindowGroupLimit" not in p      # no line of an order is cut
    assert p.count("lineitem.parquet") == 1


def test_metrics_have_no_python_and_limit_before_shuffle(spark, flat_options):
    df = M.baseline_hitrates(flat_options)
    p = plan(df)
    assert "Python" not in p
    assert p.count("WindowGroupLimit") >= 3


def test_ranks_share_one_exchange(spark, flat_options):
    df = flat_options.select("Id", R.avg_rank("totalPrice").alias("a"), R.pct_rank("totalPrice").alias("p"),
                             R.dense_rank_desc("totalPrice").alias("d"), R.strict_rank("totalPrice").alias("s"))
    assert plan(df).count("Exchange hashpartitioning(ranker_id") == 1


def test_options_view_shuffles_no_wide_row(spark):
    """Above the pivot there is no shuffle, below it lines are dealt by part, supplier and order only."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(options_view(spark, SF_TINY)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    def shuffles_above(n):
        found, d = 0, depth(lines[n])
        for line in reversed(lines[:n]):
            if depth(line) < d:
                d = depth(line)
                found += "Exchange hashpartitioning" in line
        return found

    pivots = [n for n, line in enumerate(lines) if "ObjectHashAggregate" in line and "collect_list(struct(pos" in line]
    assert pivots and all(shuffles_above(n) == 0 for n in pivots)
    assert [shuffles_above(n) for n, line in enumerate(lines) if "lineitem.parquet" in line] == [3]


def test_options_view_of_parts_and_suppliers_that_repeat(spark, tmp_path):
    """A repeated part or supplier gives its line once per row, without renumbering the others."""
    for t in ("nation", "region", "customer", "orders", "lineitem", "part", "supplier"):
        df = spark.read.parquet(f"{SF_TINY}/{t}.parquet")
        (df.unionByName(df) if t in ("part", "supplier") else df).write.parquet(f"{tmp_path}/{t}.parquet")
    once, twice = (options_view(spark, d) for d in (SF_TINY, str(tmp_path)))
    # four rows per line: the first four slots hold the first line of the option
    cols = ["legs0_segments0_marketingCarrier_code", "legs0_segments0_departureFrom_airport_iata"]
    got = {r["Id"]: r for r in twice.collect()}
    want = once.collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r["Id"]]
        assert all(g[c] == r[c] == g[c.replace("segments0", "segments3")] for c in cols)
        assert (g["taxes"] is None) == (r["taxes"] is None) and (r["taxes"] is None or abs(g["taxes"] - 4 * r["taxes"]) < 1e-2)


def test_options_view_of_some_columns(spark, tmp_path):
    """The same rows as the whole table's, also where a part comes twice."""
    from pyspark.sql import functions as F
    from rankflow.sources.tables import TABLES, table_path
    for t in TABLES[:8]:
        df = spark.read.parquet(table_path(SF_TINY, t))
        if t == "part":
            df = df.unionByName(df.withColumn("p_brand", F.concat("p_brand", F.lit("x"))))
        df.write.parquet(table_path(str(tmp_path), t))
    cols = ["Id", "legs0_segments1_marketingCarrier_code", "legs1_duration", "taxes", "selected"]
    for d in (SF_TINY, str(tmp_path)):
        some, whole = options_view(spark, d, columns=cols), options_view(spark, d).select(*cols)
        assert some.columns == cols and some.count() == whole.count()
        assert some.exceptAll(whole).count() == 0


@pytest.mark.parametrize("name,most", [("label_encode", 8), ("sketch_partitions", 12), ("matrix_columns", 8), ("median_impute", 8)])
def test_queries_store_the_options_columns_they_use(spark, name, most):
    """The stored copy is not the wide table."""
    import __spark_entry__ as entry
    from rankflow.session import scratch_scope
    with scratch_scope() as made:
        entry.queries()[name](spark, SF_TINY)
        stored = [p for p, _ in made if "/options-" in p]
        assert stored and all(len(spark.read.parquet(p).columns) <= most for p in stored)


def test_sessions_are_dealt_before_lines_become_columns(spark):
    """Rows go to their session with the lines as a list, and are not shuffled again as columns."""
    from rankflow.operators import session as S
    from rankflow.plans.registry import QUERIES, load_all
    from rankflow.sources import documents as D
    from rankflow.sources.views import options_view
    load_all()
    o = options_view(spark, SF_TINY, by_session=True)
    for df in (QUERIES["feat_all"](spark, SF_TINY), S.add_session_features(o), D.build_documents(o)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(ranker_id" not in plan and "REPARTITION_BY_NUM" in plan
    assert o.exceptAll(options_view(spark, SF_TINY)).isEmpty() and o.count() == options_view(spark, SF_TINY).count()


def test_session_lines_are_stored_compressed(spark):
    """the text of json_read_sessions is compressed."""
    import os

    from rankflow.plans.registry import QUERIES, load_all
    from rankflow.session import scratch_scope
    load_all()
    with scratch_scope() as made:
        assert QUERIES["json_read_sessions"](spark, SF_TINY).count() > 0
    files = [f for path, _ in made for f in os.listdir(path) if f.startswith("part-")]
    assert files and all(f.endswith(".txt.gz") for f in files)
