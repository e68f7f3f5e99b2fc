"""First-wins deduplication and repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def first_wins(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``. Keys travel as digests, and each task sends one row of a key; a null key is a key."""
    digest = F.coalesce(F.sha2(key.cast("string"), 256), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(digest.alias("key")).agg(F.min_by(row, F.struct(*order)).alias("row")).select("row.*")


def duplicate_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """``(key, n, first_id)`` of keys that occur more than once."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def repeated_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int = 45, times: int = 4) -> DataFrame:
    """``(id, repeats)``: the most frequent line longer than ``min_chars`` in each text that has it ``times`` times or more."""
    lines = df.select(id_col, F.explode(F.split(text_col, "\n")).alias("line")).where(F.length("line") > min_chars)
    return lines.groupBy(id_col, "line").count().groupBy(id_col).agg(F.max("count").alias("repeats")).where(F.col("repeats") >= times)


def repeated_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 32, stride: int = 16, times: int = 4) -> DataFrame:
    chunks = df.select(id_col, F.explode(X.windows(X.words(F.col(text_col)), size, stride)).alias("chunk"))
    return chunks.groupBy(id_col, F.xxhash64("chunk").alias("h")).count().groupBy(id_col).agg(F.max("count").alias("repeats")).where(F.col("repeats") >= times)
