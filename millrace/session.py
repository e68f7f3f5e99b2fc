"""Session defaults and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def session(master: str = "local[*]", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session with the settings that the library is tested with; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone so that any file system works."""
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
