"""Tables and files that stages hand to one another, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset and Spark runs in one process, as in tests, a folder of this machine is set;
    on a cluster an unset folder is an error, since no machine's own folder is shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:  # with its scheme, so that pyarrow finds it in the same file system as Spark
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="sievework-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def remove(uri: str) -> None:
    """Delete a folder; one that is gone already is no error."""
    where, path = open_fs(uri)
    try:
        where.delete_dir(path)
    except (FileNotFoundError, OSError):
        pass


def fresh(spark: SparkSession, what: str) -> str:
    """A new folder's URI. It is deleted when the driver ends, for a result that is read lazily may need it until then."""
    uri = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, uri)
    return uri


def written(df: DataFrame, what: str) -> DataFrame:
    """The DataFrame as a Parquet table in the shared folder, reread: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    uri = fresh(spark, what)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referred to; an iterative job calls it between rounds.

    The first collection drops the references that Python's objects held, the second the plans.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
