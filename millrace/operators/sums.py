"""Values of a key that add up to a target."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Smallest values that a task takes at once.
ANCHORS = 256


def pairs_with_sum(df: DataFrame, by: Sequence[str], value: str, target: int) -> DataFrame:
    """``(by, a, b)``: distinct values ``a <= b`` of a key with ``a + b = target``, from two rows. A join on what is missing, no pairs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("a")).agg(F.count("*").alias("n"))
    other = counts.select(*by, (F.lit(target) - F.col("a")).alias("a")).withColumn("b", F.lit(target) - F.col("a"))
    return counts.join(other, [*by, "a"]).where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("n") > 1))).select(*by, "a", "b")


def triples_with_sum(df: DataFrame, by: Sequence[str], value: str, target: int) -> DataFrame:
    """``(by, a, b, c)``: distinct values ``a <= b <= c`` of a key with ``a + b + c = target``, from three rows.

    Rows are counted by value first. A key's distinct values, sorted, go to as many tasks as its smallest values need; there each ``a``
    meets all ``b`` at once, and ``c`` is looked up among the sorted values. The work of a key is the square of its distinct values, as
    triples need; memory is their number.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    own = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("own"))
    dealt = own.select(*by, F.transform("own", lambda x: x["v"]).alias("vs"), F.transform("own", lambda x: x["n"]).alias("ns"), F.explode(F.sequence(F.lit(0), F.size("own") - 1, F.lit(ANCHORS))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, found = [], []
            for i, (vs, ns, first) in enumerate(zip(b.column("vs"), b.column("ns"), b.column("first").to_pylist(), strict=True)):
                v, n = np.asarray(vs.values), np.asarray(ns.values)
                for k in range(first, min(first + ANCHORS, len(v))):
                    if 3 * v[k] > target:
                        break
                    c = target - v[k] - v[k:]
                    at = np.searchsorted(v, c)
                    hit = (c >= v[k:]) & (at < len(v)) & (v[np.minimum(at, len(v) - 1)] == c)
                    for j in np.flatnonzero(hit):
                        need = 1 + (j == 0) + (v[k] == c[j])  # rows of value a
                        if n[k] >= need and (c[j] != v[k + j] or v[k + j] == v[k] or n[k + j] >= 2):
                            row.append(i)
                            found.append((v[k], v[k + j], c[j]))
            keys = [b.column(c).take(pa.array(row, pa.int64())) for c in by]
            values = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(values[:, i]) for i in range(3)]], names=[*by, "a", "b", "c"])

    schema = T.StructType([*[f for f in own.schema.fields if f.name in by], *[T.StructField(n, T.LongType()) for n in "abc"]])
    return dealt.repartition(*by, "first").mapInArrow(run, schema)
