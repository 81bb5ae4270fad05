"""Session construction and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins/aggregations at runtime
# (coalescing small shuffle partitions, splitting skewed join partitions).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app_name: str = "churnforge",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and written tables.

    A cluster names it in ``spark.checkpoint.dir``; a folder given to
    ``SparkContext.setCheckpointDir`` counts as well. Where neither is set, a
    local session (tests, notebooks) gets a temporary folder; any other master
    fails, because executors could not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    active = sc._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and active.isDefined():
        return active.get()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="churnforge-ckpt-")
    if active.isEmpty():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written table under the shared folder that no other driver uses.

    The application id and a random part keep drivers apart on shared storage.
    ``release_scratch`` deletes what was written.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def release_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete one written scratch table, or all that this driver wrote."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in [path] if path else list(_written):
        target = jvm.org.apache.hadoop.fs.Path(p)
        target.getFileSystem(conf).delete(target, True)
        if p in _written:
            _written.remove(p)


_written: list[str] = []
