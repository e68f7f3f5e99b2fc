"""Streaming jobs over append-only tables; each has a bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 10) -> DataFrame:
    """New files of a folder as they arrive, a bounded number at a time."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def with_event_time(df: DataFrame, time: str, delay: str) -> DataFrame:
    """A zone-less time becomes an instant with a watermark."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def tumbling(df: DataFrame, time: str, width: str, by: list[str], *aggregates: Column) -> DataFrame:
    counts = df.groupBy(F.window(time, width), *by).agg(*aggregates)
    return counts.select(F.col("window.start").alias("start"), *[c for c in counts.columns if c != "window"])


def sliding_rate(df: DataFrame, time: str, width: str = "10 minutes", slide: str = "1 minute") -> DataFrame:
    """Rows per second in each window."""
    counts = df.groupBy(F.window(time, width, slide)).agg(F.count("*").alias("n"))
    seconds = F.col("window.end").cast("double") - F.col("window.start").cast("double")
    return counts.select(F.col("window.end").alias("at"), "n", (F.col("n") / seconds).alias("per_second"))


def once_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def score(df: DataFrame, correct: Column, by: list[str]) -> DataFrame:
    """Running totals; publish with output mode ``complete`` or ``update``."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(correct).alias("correct"))


def in_order(df: DataFrame, key: str, seq: str, value: str, most_waiting: int | None = None) -> DataFrame:
    """Rows of each key released in the order of ``seq`` (1, 2, ...); later ones wait for the gaps before them.

    The state of a key is its next number and the rows that wait. With ``most_waiting``, if more wait, the smallest waiting number is next,
    and what is missing before it is given up; ``stateful.release_in_order`` gives gaps up by time instead. A number that was released
    before, or given up, is dropped.
    """
    out = T.StructType([T.StructField(key, T.LongType()), T.StructField(seq, T.LongType()), T.StructField(value, T.StringType())])
    state = T.StructType([T.StructField("next", T.LongType()), T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.StringType()))])

    def release(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        at, seqs, values = held.get if held.exists else (1, [], [])
        waiting = dict(zip(seqs, values, strict=True))
        for p in parts:
            for s, v in zip(p[seq], p[value], strict=True):
                if s >= at:
                    waiting.setdefault(int(s), v)
        ready = []
        while at in waiting or (most_waiting is not None and len(waiting) > most_waiting):
            at = at if at in waiting else min(waiting)
            ready.append((k[0], at, waiting.pop(at)))
            at += 1
        held.update((at, list(waiting), list(waiting.values())))
        yield pd.DataFrame(ready, columns=[key, seq, value])

    rows = df.select(F.col(key).cast("long").alias(key), F.col(seq).cast("long").alias(seq), F.col(value).cast("string").alias(value))
    return rows.groupBy(key).applyInPandasWithState(release, out, state, "append", GroupStateTimeout.NoTimeout)


def admit(df: DataFrame, key: str, id_col: str, accepted: str, quota: int) -> DataFrame:
    """``(key, id, admitted)`` for requests and results of each key, as they come.

    A row whose ``accepted`` is null asks for admission: it is admitted while accepted and pending ones are fewer than ``quota``. A row
    with a verdict ends a pending request and counts if it is true. The state of a key is two numbers.
    """
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField(id_col, T.LongType()), T.StructField("admitted", T.BooleanType())])
    state = T.StructType([T.StructField("accepted", T.LongType()), T.StructField("pending", T.LongType())])

    def decide(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        done, pending = held.get if held.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(id_col)
        answers = []
        verdicts = rows["verdict"].tolist()
        for ok in (v for v in verdicts if v is not None and v == v):
            pending, done = max(0, pending - 1), done + bool(ok)
        for i, v in zip(rows[id_col], verdicts, strict=True):
            if v is None or v != v:
                granted = done + pending < quota
                pending += granted
                answers.append((k[0], i, granted))
        held.update((int(done), int(pending)))
        yield pd.DataFrame(answers, columns=[key, id_col, "admitted"])

    rows = df.select(F.col(key).cast("string").alias(key), F.col(id_col).cast("long").alias(id_col), F.col(accepted).cast("boolean").alias("verdict"))
    return rows.groupBy(key).applyInPandasWithState(decide, out, state, "append", GroupStateTimeout.NoTimeout)


def stalled(rates: DataFrame, now: Column, limit_seconds: int) -> DataFrame:
    """A batch of keys with their last time (``at``) to ``(idle_seconds, stalled)``: nothing for longer than the limit."""
    idle = now.cast("double") - F.col("at").cast("double")
    return rates.withColumn("idle_seconds", idle).withColumn("stalled", F.col("idle_seconds") > limit_seconds)


def run_until(query: StreamingQuery, stop: Callable[[], bool], every_seconds: float = 1.0) -> bool:
    """Wait for a query to end, and stop it once ``stop()`` says so; true if it was stopped. ``stop`` may look for a file."""
    while not query.awaitTermination(every_seconds):
        if stop():
            query.stop()
            return True
    return False


def paired(left: DataFrame, right: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Rows of two streams with one key, the right one at most ``within`` later."""
    r = right.withColumnRenamed(key, f"_{key}").withColumnRenamed(time, f"{time}_right")
    near = (F.col(f"{time}_right") >= F.col(time)) & (F.col(f"{time}_right") <= F.col(time) + F.expr(f"INTERVAL {within}"))
    return left.join(r, (F.col(key) == F.col(f"_{key}")) & near).drop(f"_{key}")


def drain(df: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Run over all that is there and stop; output is Parquet, the checkpoint makes a restart go on where it ended."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
