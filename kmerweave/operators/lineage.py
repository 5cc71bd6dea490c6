"""Cutting long lineages by writing to shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR = {}
_KEPT = set()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local master
    without that setting gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIR:
        _LOCAL_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="kmerweave-")
    return _LOCAL_DIR[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's own part of the shared folder. That part goes when the application ends."""
    sc = spark.sparkContext
    root = f"{work_dir(spark).rstrip('/')}/kmerweave/{sc.applicationId}"
    if root not in _KEPT:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _KEPT.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes a DataFrame to shared storage and reads it back, so that later
    steps neither recompute it nor depend on executors that may be lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
