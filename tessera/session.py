"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tessera",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session tuned for the operators in this package.

    On a cluster, pass ``master=None`` and let spark-submit decide; shuffle
    partitions and driver memory are only set for a local master (tests and
    the bench) or where the caller names them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = bool(master and master.startswith("local"))
    if shuffle_partitions or local:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
    if local:
        builder = builder.config("spark.driver.memory", "16g")
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used.  Only a local-mode session with no setting gets a private
    temporary folder (tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster needs a shared folder for checkpoints")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches to Python workers by bytes, unless the session has a
    bound of its own.  Spark's default (10,000 rows, 64 MB) is held several
    times at once, by the JVM outside its heap and by the worker; the operators
    cut batches into blocks of a megabyte or two anyway."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Inside, the shuffle files of a job go when it ends.  By default they stay
    until the driver collects its plan as garbage, so that a chain of large
    steps, each of them materialized, holds the shuffles of all at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used after expensive per-row parsing whose outputs have several
    consumers: without the cut, filter pushdown and projection collapsing
    inline the parsing expressions into every consumer.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """Cut lineage with a table written in the shared folder.

    For tables that are joined again and again in a loop: a checkpoint keeps
    the planner's size estimate, which for a join is the product of both sides,
    so that its digits multiply with every round; a written table has the size
    of its files.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df):
    """Rows dealt evenly over the shuffle partitions, before per-row work that
    dominates: a single row group, or a few long rows that are exploded, would
    leave all of it to as many tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


BROADCAST_MAX_ROWS = 100_000


def bounded_broadcast(df, max_rows: int = BROADCAST_MAX_ROWS):
    """Broadcast ``df`` only after checking its size: one small count job;
    beyond ``max_rows`` the caller's join stays a shuffle join."""
    from pyspark.sql import functions as F
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def small_side(df, max_rows: int = BROADCAST_MAX_ROWS):
    """A per-group table as a join side: written once, then broadcast if its
    row count is within the bound.  Left to AQE, both sides' shuffles start
    together and the fact rows are already dealt by a handful of group keys
    when the small side's size becomes known."""
    return bounded_broadcast(materialize(df), max_rows)
