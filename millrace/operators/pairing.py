"""Scores of several models on the same tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S


def matched(scores: DataFrame, model: str, key: str, k: int) -> DataFrame:
    """Rows of tasks that all ``k`` models have."""
    common = scores.groupBy(key).agg(F.count_distinct(model).alias("_k")).where(F.col("_k") == k).select(key)
    return scores.join(common, key, "left_semi")


def contingency(pairs: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """Both, only a, only b, neither, n and the exact McNemar p-value, per group."""
    counts = pairs.groupBy(*by).agg(
        F.count_if(a & b).alias("in_both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"), F.count("*").alias("n")
    )
    return counts.withColumn("p", S.mcnemar(F.col("only_a"), F.col("only_b")))


def wide(scores: DataFrame, key: str, model: str, value: str, models: Sequence[str]) -> DataFrame:
    """One row per task with a column for each model."""
    return scores.groupBy(key).pivot(model, list(models)).agg(F.first(value))


def eligible(candidates: DataFrame, guards: Sequence[str], baseline: DataFrame, slack: float = 1.01) -> DataFrame:
    """Candidates whose guard metrics stay within ``slack`` of the baseline, a row of the same metrics."""
    limits = baseline.select(*[(slack * F.col(g)).alias(f"limit_{g}") for g in guards])
    ok = F.lit(True)
    for g in guards:
        ok = ok & (F.col(g) <= F.col(f"limit_{g}"))
    return candidates.join(F.broadcast(limits), ok, "left_semi")  # one row
