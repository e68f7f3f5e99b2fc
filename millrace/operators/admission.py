"""Admission with reasons, mixtures with provenance, manifests and expectations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first failing check; null if all pass."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks])


def mixture(parts: dict[str, DataFrame]) -> DataFrame:
    """Union by name with a ``mixture_source`` column; missing columns are null."""
    marked = [df.withColumn("mixture_source", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def manifest(df: DataFrame, split: str, key: str, tokens: Column, content: Column) -> DataFrame:
    """``(split, n, tokens, digest)``: the digest is an order-free sum of row hashes, so it needs no sort of a whole split."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), content), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(split).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.sum(h).cast("string").alias("digest"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, failed)`` for rules that some row breaks; null counts as broken."""
    sums = df.agg(*[F.coalesce(F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias(name) for name, ok in rules.items()])
    names = list(rules)
    stacked = ", ".join(f"'{n}', `{n}`" for n in names)
    return sums.selectExpr(f"stack({len(names)}, {stacked}) AS (rule, failed)").where("failed > 0")


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` itself, failing at run time on the first row that breaks a rule."""
    for name, ok in rules.items():
        df = df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"expectation failed: {name}")).cast("boolean")))
    return df


def unmatched_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``(key, side)`` of keys that only one side has."""
    left = a.select(key).distinct().withColumn("in_a", F.lit(True))
    right = b.select(key).distinct().withColumn("in_b", F.lit(True))
    out = left.join(right, key, "full_outer").where(F.col("in_a").isNull() | F.col("in_b").isNull())
    return out.select(key, F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("side"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only one side has, as multisets."""
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))
