"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without it gets one of its own, once."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="millrace-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a table, written now: later reads neither repeat the work nor depend on executors that may be gone."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """``df`` dealt by ``key`` to tasks of about so many rows, for work that costs much a row: a small file may be a single task's."""
    return df.repartition(max(2, -(-df.count() // rows)), key)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path, for what DataFrames can't do: renaming and deleting."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            fs, at = file_system(df.sparkSession, file)
            fs.delete(at.getParent(), True)
