"""Session helpers: a local session for tests and the bench, and the
shared scratch folder that jobs use to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "farepath") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller owns the
    session; nothing in the library calls this."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("FAREPATH_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the folder the cluster names in ``spark.checkpoint.dir``. Only
    when that is unset and the master is local does it name a folder of
    its own and register it as the checkpoint folder, so
    ``DataFrame.checkpoint()`` and written tables land in the same place;
    on a cluster an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = _context(spark)
    if sc is None:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        # A machine-local folder is not shared by the executors of a cluster.
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a folder on shared storage")
    own = os.path.join(tempfile.gettempdir(), "farepath-checkpoints")
    sc.setCheckpointDir(own)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``DataFrame.checkpoint()`` has a reliable folder. (With
    Spark Connect the server owns the folder; nothing to do here.)"""
    sc = _context(spark)
    if sc is None:
        return scratch_dir(spark)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(scratch_dir(spark))
    return sc.getCheckpointDir()


def session_key(spark: SparkSession) -> str:
    """Identifies the application, for per-session caches."""
    sc = _context(spark)
    if sc is not None:
        return sc.applicationId
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no SparkContext
        return None


def _app_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/farepath/{session_key(spark)}"


def new_scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path under the application's scratch folder."""
    return f"{_app_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def named_scratch_path(spark: SparkSession, name: str) -> str:
    """The one path of this name in the application's scratch folder, for
    outputs that each run overwrites."""
    return f"{_app_folder(spark)}/{name}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it; None with Spark
    Connect, which has no JVM here."""
    sc = _context(spark)
    if sc is None:
        return None
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def release_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables that this application has written to
    the scratch folder. DataFrames that read them can't be used any more."""
    found = file_system(spark, _app_folder(spark))
    if found is not None:
        fs, where = found
        fs.delete(where, True)
