"""What several operators share: durable checkpoints, fan-out sizes and block frames."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a local session without it gets one of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, compression: str = "snappy", *by: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, in a folder for each value of the columns ``by``.

    A table rather than ``checkpoint()``, which hands on the estimated size of what it stands for: in loops of joins these estimates are
    products of products, and the driver drowns in their digits.
    """
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is written inside hands Python so many rows at once: of whole texts, 10,000 a batch are held several times over, in JVM and worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(df: DataFrame, compression: str = "snappy", *by: str) -> DataFrame:
    """``durable``, and the driver's garbage is collected, with which shuffle files, broadcasts and generated code of the written plan go.

    Executors remove their shuffle files when the driver's collector finds the plan gone, which may be long after; and in loops of many
    small plans the driver holds what hundreds of them left.
    """
    table = durable(df, compression, *by)
    df.sparkSession._jvm.System.gc()
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing will read again."""
    for df in tables:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:  # a union has several
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cells(spark: SparkSession, rows: int, per_cell: int) -> int:
    """How many cells hold ``rows`` at ``per_cell`` each, and at least one for every shuffle partition."""
    return max(shuffle_width(spark), -(-rows // per_cell))
