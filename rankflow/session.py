"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every rankflow session wants. Shuffle partitions are sized for
# the local test box; on a cluster the caller's value wins because
# ``getOrCreate`` keeps settings that were already set.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of tables no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "rankflow", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the rankflow defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Only in a local session, where all tasks see the
    same disk, do we pick a scratch folder of our own if it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="rankflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


# what the scopes that are open have stored, the innermost last: (path, table or None)
_scopes: list[list] = []


@contextmanager
def scratch_scope():
    """Collects what is stored under the scratch folder inside the block, for
    ``release_scratch`` once nothing reads it any more."""
    made: list = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def note_scratch(path: str, table: str | None = None) -> None:
    """Tell the open scope, if there is one, of a stored path (and its table)."""
    if _scopes:
        _scopes[-1].append((path, table))


def release_scratch(spark: SparkSession, made: list) -> None:
    """Delete what a scope has collected: paths that this library has written
    under the scratch folder, and their tables."""
    while made:
        path, table = made.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df, name: str = "table"):
    """Write ``df`` once as parquet under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back: lineage is cut, the data
    survives executor loss, and later jobs (fit, then transform) scan a
    columnar file instead of recomputing the plan. Parquet is much faster
    than RDD checkpoint serialization for wide rows."""
    import uuid
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    note_scratch(path)
    return df.sparkSession.read.parquet(path)


def checkpoint(df):
    """Reliable checkpoint into ``spark.checkpoint.dir`` (set from the
    session, or a scratch folder only when unset, as in local tests)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
