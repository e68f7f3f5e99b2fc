"""A circuit breaker for a stream: a listener that stops a query after several failing batches in a row."""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import scans

METRICS = "breaker"


def watched(df: DataFrame, failed: Column) -> DataFrame:
    """``df``, which reports its rows and failures batch by batch to listeners; no row is changed, and nothing is read twice."""
    return df.observe(METRICS, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failures"))


class Breaker(StreamingQueryListener):
    """Stops the query whose last ``limit`` batches with rows all failed; a batch fails if at least ``share`` of its rows did.

    ``batches`` keeps (number, rows, failures) of the last ``limit`` batches, ``opened`` the number of the batch that opened it.
    """

    def __init__(self, spark: SparkSession, limit: int, share: float = 1.0) -> None:
        self.spark, self.limit, self.share = spark, limit, share
        self.batches: list[tuple[int, int, int]] = []
        self.opened: int | None = None
        self.run_id: str | None = None
        self.done = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.run_id = self.run_id or str(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        if progress["runId"] != self.run_id or METRICS not in progress.get("observedMetrics", {}) or self.opened is not None:
            return
        seen = progress["observedMetrics"][METRICS]
        if seen["rows"]:
            self.batches = [*self.batches, (progress["batchId"], seen["rows"], seen["failures"])][-self.limit :]
        if len(self.batches) == self.limit and all(f >= self.share * n for _, n, f in self.batches):
            self.opened = self.batches[-1][0]
            self.done.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.done.set()


def run_guarded(query: StreamingQuery, breaker: Breaker) -> bool:
    """Wait for the query's end, or stop it when the breaker opens; true if it was stopped.

    ``breaker`` must be registered before the query starts. The listener only raises a flag: stopping a query inside its own event would
    wait for itself. A batch that is running when the breaker opens is cut off and, by its checkpoint, done again at a restart.
    """
    while not query.awaitTermination(0.2):
        if breaker.opened is not None:
            query.stop()
            return True
    breaker.done.wait(30)  # the last batches' events may come after the end
    return breaker.opened is not None


def failing_runs(batches: DataFrame, number: str, rows: str, failures: str, limit: int, share: float = 1.0) -> DataFrame:
    """The same decision over a table of batches: the ``number`` of the batch at which the breaker opens, or no row.

    Batches without rows don't count. A run of failures grows with each failing batch and ends at a success.
    """
    bad = batches.where(F.col(rows) > 0).withColumn("bad", F.col(failures) >= share * F.col(rows))

    def step(run: int, row: tuple) -> tuple[int, int]:
        run = run + 1 if row[0] else 0
        return run, run

    runs = scans.fold(bad, [], [number], ["bad"], 0, step, "run", T.IntegerType())
    return runs.where(F.col("run") == limit).agg(F.min(number).alias("opened")).where("opened IS NOT NULL")
