"""Spark session settings used by the jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI semantics (we use try_* where the
# reference swallows errors), UTC clock, adaptive execution for skew and
# partition coalescing, no web UI.
BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# On a cluster reading very large inputs: fewer, larger input splits. The
# number of shuffle partitions follows from the input, so the caller gives it
# (``shuffle_partitions``: input bytes of the largest shuffle / 256 MB); AQE
# merges what turns out small.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "leadframe",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    On a cluster the master and executor sizing come from spark-submit; pass
    ``master`` only for local runs and tests.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        # local mode: the driver is the only JVM, give it room
        conf["spark.driver.memory"] = "12g"
    else:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) or _is_local(spark):
        checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    m = spark.sparkContext.master
    return m == "local" or m.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it. A plain local session without the setting (tests)
    gets a scratch folder of its own; on any other master that is an error,
    since executors can't read each other's disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="leadframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_written: dict[str, list[str]] = {}     # application id -> scratch folders of ``materialize``


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: later jobs reuse the rows instead of recomputing (and
    re-planning) the lineage, and a lost executor costs a re-read, not a
    recompute of everything before. The planner knows the written bytes, so
    it broadcasts the table in a join only if they are under
    ``spark.sql.autoBroadcastJoinThreshold``. ``drop_scratch`` removes the
    folders once the results are committed."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables that ``materialize`` wrote in this application."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = hadoop.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df) -> int:
    """The planner's size of ``df`` (file bytes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df) -> bool:
    """Whether the planner would broadcast ``df`` (a written table) by its bytes."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= plan_bytes(df) <= limit


SPREAD_BYTES = 256 * 1024


def spread(df):
    """Round-robin a scan that has fewer splits than task slots, into at most
    one part per SPREAD_BYTES, so per-row rules use every core. Small
    dimensions and large inputs (many splits) are returned unchanged."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    n = min(slots, plan_bytes(df) // SPREAD_BYTES)
    if n > 1 and df.rdd.getNumPartitions() < n:
        return df.repartition(n)
    return df
