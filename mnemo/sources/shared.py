"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def session_folder(spark: SparkSession) -> str:
    """This session's own folder below ``spark.checkpoint.dir``.

    Where none is set a session on one machine uses a temporary folder; on a cluster the folder is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("mnemo.scratch.dir", None)
    if not root:
        if not one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="mnemo-")
        spark.conf.set("mnemo.scratch.dir", root)
    return f"{root.rstrip('/')}/mnemo-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to a new shared table and read it back: computed once, and whole if executors are lost."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clean(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this session; frames that still read them fail from then on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
