"""Overlap of documents with held-out items by shared word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def grams(df: DataFrame, id_col: str, text_col: str, size: int = 8) -> DataFrame:
    """``(id, n, gram)``: distinct n-grams of each text with their number."""
    own = df.select(id_col, X.shingles(F.col(text_col), size).alias("grams"))
    return own.select(id_col, F.size("grams").alias("n"), F.explode("grams").alias("gram"))


def gram_hashes(df: DataFrame, id_col: str, text_col: str, size: int = 8) -> DataFrame:
    """``(id, h)``: 64-bit hashes of the distinct n-grams of each text, without spelling them."""
    return df.select(id_col, F.explode(F.array_distinct(X.window_hashes(X.words(F.col(text_col)), size))).alias("h"))


def touching(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, size: int, min_hits: int) -> DataFrame:
    """Documents of which ``min_hits`` n-grams or more are some item's, by hashes: a few more than do, and none fewer."""
    known = gram_hashes(items, item_id, "text", size).select("h").distinct()
    ids = gram_hashes(docs, doc_id, "text", size).join(known, "h", "left_semi").groupBy(doc_id).count().where(F.col("count") >= min_hits).select(doc_id)
    return docs.join(ids, doc_id, "left_semi")


def overlap_pairs(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, size: int = 8, min_hits: int = 3, min_share: float = 0.55) -> DataFrame:
    """``(doc, item, hits, share)`` where at least ``min_hits`` n-grams are shared, and ``min_share`` of the smaller side's.

    Hashes find the documents that can qualify; only these are spelled out and matched. Spark broadcasts the items' n-grams while they
    are small and shuffles both sides beyond.
    """
    d, i = grams(touching(docs, items, doc_id, item_id, size, min_hits), doc_id, "text", size), grams(items, item_id, "text", size).withColumnRenamed("n", "m")
    hits = d.join(i, "gram").groupBy(doc_id, item_id).agg(F.count("*").alias("hits"), F.max("n").alias("n"), F.max("m").alias("m"))
    share = F.col("hits") / F.greatest(F.lit(1), F.least("n", "m"))
    return hits.withColumn("share", share).where((F.col("hits") >= min_hits) & (F.col("share") >= min_share)).select(doc_id, item_id, "hits", "share")


def clean(docs: DataFrame, pairs: DataFrame, doc_id: str) -> DataFrame:
    return docs.join(pairs.select(doc_id).distinct(), doc_id, "left_anti")


def global_overlap(docs: DataFrame, items: DataFrame, doc_id: str, size: int = 8, min_hits: int = 3, min_share: float = 0.5) -> DataFrame:
    """``(doc, n, hits)`` where the union of all items' n-grams covers at least ``max(min_hits, min_share * n)`` of the document's."""
    known = items.select(F.explode(X.shingles(F.col("text"), size)).alias("gram")).distinct()
    near = touching(docs, items.withColumn("item", F.lit(0)), doc_id, "item", size, min_hits)
    hits = grams(near, doc_id, "text", size).join(known, "gram", "left_semi").groupBy(doc_id).agg(F.max("n").alias("n"), F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= F.greatest(F.lit(float(min_hits)), min_share * F.col("n")))


def exposed(items: DataFrame, item_id: str, forms: list[Column], prompts: DataFrame, prompt: Column) -> DataFrame:
    """Items of which any textual form equals a prompt in normal form."""
    spelled = items.select(item_id, F.explode(F.array(*[X.norm(f) for f in forms])).alias("form")).where(F.length("form") > 0)
    return spelled.join(prompts.select(X.norm(prompt).alias("form")).distinct(), "form", "left_semi").select(item_id).distinct()
