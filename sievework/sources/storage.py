"""Folders that all executors share, tables written to cut lineage, and guards of outputs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and Spark is one process, as in tests, a folder of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="sievework-")
    atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """The DataFrame as a Parquet table in the shared folder, reread."""
    uri = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(uri)
    atexit.register(_remove, df.sparkSession, uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def _remove(spark: SparkSession, uri: str) -> None:
    """Delete a table when the driver ends, if its session still runs."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM is gone: the folder's owner cleans up
        pass


def exists_with_content(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(where) and (fs.getFileStatus(where).isFile() or len(fs.listStatus(where)) > 0)


def require_fresh(spark: SparkSession, path: str) -> None:
    """Outputs are immutable: fail where there is one already."""
    if exists_with_content(spark, path):
        raise FileExistsError(f"{path} exists and isn't empty")
