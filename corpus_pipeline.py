"""A training-data pipeline: quality classifier, line dedup, near-dedup and packing, each over all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from millrace.llm.common import read, shared_folder
from millrace.llm.line_dedup import without_frequent_lines
from millrace.llm.minhash import drop_near_duplicates
from millrace.llm.packing import pack_documents
from millrace.llm.quality_ngrams import quality_filter
from millrace.llm.queries import tokenizer_file
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_frequent_lines(docs, min_chars=40, min_docs=5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, threshold=0.8, shingle=5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), max_tokens=4096, end_id=2)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("packing", packing)]

#: The classifier and the near-dedup can't be put in SQL; tests/llm/test_pipeline.py holds all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
