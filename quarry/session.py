"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings that make plans adaptive and results reproducible.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bound the driver-side job/stage/plan history kept for status reporting:
    # iterative fits run thousands of small jobs.
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "10000",
    "spark.sql.ui.retainedExecutions": "50",
}


def get_session(app: str = "quarry", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized for the data (≈ input
    bytes / 128 MB), which AQE coalesces further at runtime.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and stage tables.

    The cluster names it in ``spark.checkpoint.dir``; we only invent one
    (under the local temp folder) when the setting is absent, which happens
    in unit tests on a laptop.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Inside, generated methods of more than 8,000 bytes of code, which the JVM only interprets, are not
    generated: wide projections run as many small methods, which it compiles."""
    name = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in four partitions a core at least. Scans are split by bytes, so a small file of many
    rows is few tasks; what is written from here is read by as many tasks as there are cores."""
    most = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= most else df.repartition(most)


def executor_cores(spark: SparkSession) -> int:
    """Cores of an executor, or of the driver in local mode."""
    sc = spark.sparkContext
    executors = len(sc._jsc.sc().statusTracker().getExecutorInfos()) - (not sc.master.startswith("local["))  # the driver is listed too
    return int(sc.getConf().get("spark.executor.cores") or max(1, sc.defaultParallelism // max(1, executors)))


def stage_path(spark: SparkSession, *parts: str) -> str:
    """A location under the shared checkpoint folder for a written stage table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "quarry", spark.sparkContext.applicationId, *parts)


def store_path(spark: SparkSession, *parts: str) -> str:
    """A location under the shared checkpoint folder that later sessions find again."""
    return os.path.join(checkpoint_dir(spark), "quarry", "store", *parts)
