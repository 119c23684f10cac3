"""Spark session and lineage-cut helpers.

Nothing here is a scheduler or a planner: it only builds a session with the
settings the library relies on (UTC, ANSI, AQE) and resolves the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "recengine") -> SparkSession:
    """Session with the settings every operator assumes.

    On a cluster, ``master`` stays ``None`` (spark-submit decides) and the
    shuffle partition count comes from the cluster defaults; AQE coalesces
    and splits partitions at run time from real sizes.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", "8g")
    b = (b.config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Reads ``spark.checkpoint.dir`` (or the context's already-set folder).
    When neither is set, a local session (tests) takes a fresh folder under
    the system temp dir; on a cluster that folder would be machine-local, so
    it is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="recengine-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``):
    survives executor loss, and keeps iterative plans short.

    The rows are persisted (memory, spilling to disk) for the duration of
    the checkpoint: an eager checkpoint runs one job to count and another to
    write, and without it the whole input plan would be computed twice.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def reuse(df: DataFrame) -> DataFrame:
    """Keep a result that one plan reads several times (memory, spilling to
    disk).  Lazy -- no extra job; if an executor is lost its blocks are
    recomputed from the (short) lineage.  For long or iterative lineage use
    ``cut_lineage`` instead."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing sub-folder of the shared checkpoint folder;
    only Spark's writers create it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "cut", partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the
    lineage, survives lost executors, and keeps column pruning and sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``written`` that nothing reads any
    more, through Spark's own file system."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
