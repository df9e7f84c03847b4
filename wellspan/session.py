"""Session settings and the shared scratch location used by jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_MARKED: set[str] = set()


def build_session(app: str = "wellspan", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on (UTC, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="wellspan-")
    return _LOCAL_ROOT[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so reruns cannot collide.

    All scratch of an application lies in one folder, which goes when its driver ends.
    """
    app = spark.sparkContext.applicationId
    root = f"{shared_root(spark)}/wellspan/{app}"
    if root not in _MARKED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MARKED.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def reuse(df):
    """Keep a daily table that several branches of one job read, so its source is read once.

    Lazy; a lost executor's share is recomputed. Only for tables already reduced to one row per
    station and day. Disk takes what memory cannot hold.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df, *columns):
    """Hash-partition on ``columns`` into the session's shuffle partitions.

    For rows that are few bytes but much work: an explicit count keeps adaptive execution from
    merging them into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def materialize(df, label: str):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
