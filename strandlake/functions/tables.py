"""Stage tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir.

    Where that is unset, a local session makes a temporary folder of its own; on a cluster it is an
    error, since executors don't share local folders. The folder goes when the session's Python ends."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
        found = spark.sparkContext.getCheckpointDir()
    folder = f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = spark
        atexit.register(_clear, folder)
    return folder


def _clear(folder: str) -> None:
    spark = _folders.pop(folder)
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def met(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged: of a table that grows with the input, which a broadcast would hold on the driver."""
    return df.hint("merge")
