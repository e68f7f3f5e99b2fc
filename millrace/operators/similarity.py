"""Similarity join of two tables of texts by shared word n-grams, for sides of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import durable


def _grams(df: DataFrame, id_col: str, size: int, name: str) -> DataFrame:
    """``(name, n, h)``: 64-bit hashes of each row's distinct n-grams, with their number."""
    own = df.select(F.col(id_col).alias(name), F.array_distinct(X.window_hashes(X.words(F.col("text")), size)).alias("grams"))
    return own.select(name, F.size("grams").alias("n"), F.explode("grams").alias("h"))


def _needed(n: Column, min_hits: int, min_share: float) -> Column:
    """The least overlap that a pair whose smaller side has ``n`` grams must have."""
    return F.greatest(F.lit(min_hits), F.ceil(n * min_share - 1e-9)).cast("int")


def _prefix(grams: DataFrame, frequency: DataFrame, name: str, min_hits: int, min_share: float) -> DataFrame:
    """The rarest of each row's shared grams, all but ``needed - 1``: a pair with enough in common has one of them in common."""
    rare = Window.partitionBy(name).orderBy("n_docs", "h")
    ranked = grams.join(frequency, "h").withColumn("rank", F.row_number().over(rare)).withColumn("shared", F.count("*").over(Window.partitionBy(name)))
    return ranked.where(F.col("rank") <= F.col("shared") - _needed(F.col("n"), min_hits, min_share) + 1).select(name, "n", "h")


def similar_pairs(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, size: int = 8, min_hits: int = 3, min_share: float = 0.55) -> DataFrame:
    """``(doc, item, hits, share)`` where at least ``min_hits`` n-grams are shared, and ``min_share`` of the smaller side's; ``overlap_pairs``
    for items that are too many to broadcast.

    Grams that only one side has can't be shared: a semi-join drops them, which Spark turns into a Bloom filter before the exchange where
    that pays. Of what is left, in one order by frequency for both sides, the smaller text of a pair must share one of its rarest grams with
    the larger one (prefix filter): so frequent grams, which make most pairs, join nothing unless a text has hardly others. Candidates
    are then spelled out. Sides are known by ids, which shouldn't repeat; null texts have no grams.
    """
    of_items = durable(_grams(items, item_id, size, "item"))
    of_docs = durable(_grams(docs, doc_id, size, "doc").join(of_items.select("h").distinct(), "h", "left_semi"))
    frequency = of_docs.groupBy("h").agg(F.count("*").alias("n_docs"))
    small_items = _prefix(of_items, frequency, "item", min_hits, min_share).withColumnRenamed("n", "m")
    small_docs = _prefix(of_docs, frequency, "doc", min_hits, min_share)
    larger_doc = of_docs.join(small_items, "h").where("n >= m").select("doc", "item")
    larger_item = of_items.withColumnRenamed("n", "m").join(small_docs, "h").where("n < m").select("doc", "item")
    pairs = durable(larger_doc.unionAll(larger_item).distinct())
    spelled = lambda df, id_col, name: df.select(F.col(id_col).alias(name), F.array_distinct(X.shingles(F.col("text"), size)).alias(f"{name}_grams"))
    # only texts of candidates are spelled out
    named = lambda df, id_col, name: df.join(pairs.select(F.col(name).alias(id_col)).distinct(), id_col, "left_semi")
    both = pairs.join(spelled(named(docs, doc_id, "doc"), doc_id, "doc"), "doc").join(spelled(named(items, item_id, "item"), item_id, "item"), "item")
    hits = F.size(F.array_intersect("doc_grams", "item_grams"))
    share = F.col("hits") / F.greatest(F.lit(1), F.least(F.size("doc_grams"), F.size("item_grams")))
    found = both.withColumn("hits", hits.cast("long")).withColumn("share", share).where((F.col("hits") >= min_hits) & (F.col("share") >= min_share))
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "hits", "share")
