"""The folder that all executors share, and cutting lineage in it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names. One of our own only where it names none and all runs on this machine; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not folder and not re.fullmatch(r"local(?:\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return (folder or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, kept as files in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @atexit.register
    def drop() -> None:
        try:
            files.delete(hadoop, True)
        except Exception:  # the session has ended before; the folder's owner clears it
            pass

    return path


def kept(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed table; for wide or many rows."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
