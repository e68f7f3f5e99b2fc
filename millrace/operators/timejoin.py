"""As-of and interval joins, sessions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last ``right`` row of its key at or before its time.

    One sort per key instead of a range join: both sides are unioned, and the last right value is carried along.
    """
    names = [c for c in left.columns]
    side = X.free_name(left, "side")
    both = left.withColumn(side, F.lit(1)).unionByName(right.select(key, time, *values).withColumn(side, F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, side).rowsBetween(Window.unboundedPreceding, 0)
    carried = {v: F.last(F.when(F.col(side) == 0, F.struct(v)), ignorenulls=True).over(w)[v] for v in values}
    return both.withColumns(carried).where(F.col(side) == 1).select(*names, *values)


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside ``[start, end)`` spans: both are dealt to buckets of ``width``, so the join has an equality."""
    bucket = lambda c: F.floor(c / width)
    name = X.free_name(points, X.free_name(spans, "bucket"))
    p = points.withColumn(name, bucket(F.col(at)))
    s = spans.withColumn(name, F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return p.join(s, name).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(name)


def islands(df: DataFrame, part: str, order: list[str], value: Column) -> DataFrame:
    """Adds ``run``: a number that grows whenever the value changes."""
    w = Window.partitionBy(part).orderBy(*order)
    changed = F.coalesce((~value.eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    new = X.free_name(df, "new")
    return df.withColumn(new, F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).withColumn("run", F.sum(new).over(w)).drop(new)


def sessions(df: DataFrame, part: str, time: str, gap_seconds: float) -> DataFrame:
    """Adds ``session``: a pause longer than the gap begins a new one."""
    w = Window.partitionBy(part).orderBy(time)
    pause = F.col(time).cast("timestamp").cast("double") - F.lag(time).over(w).cast("timestamp").cast("double")
    new = X.free_name(df, "new")
    return df.withColumn(new, F.coalesce((pause > gap_seconds).cast("int"), F.lit(0))).withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(new)
