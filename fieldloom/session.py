"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("fieldloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDERS[context.applicationId]


_TWINS: dict[str, SparkSession] = {}


def region_session(spark: SparkSession) -> SparkSession:
    """A session of the same application in which joins by region and more do not move rows that lie by region.

    For panels whose regions are bounded: there a task never gets more than some regions. A session of
    its own, so that other queries of the application keep their plans.
    """
    key = spark.sparkContext.applicationId
    if key not in _TWINS:
        twin = spark.newSession()
        for name, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(name):
                twin.conf.set(name, value)
        twin.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        _TWINS[key] = twin
    return _TWINS[key]


def stage_by(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Like ``stage``, in buckets of ``key``: readers find the rows dealt by it and do not shuffle them again."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/fieldloom/{name}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a recomputation, and lets
    every later reader prune columns and push filters into the scan.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
