"""What steps leave behind and hand on at once."""

from types import SimpleNamespace

import pytest

pytest.importorskip("public_tokenizers")

from millrace.llm import common  # noqa: E402
from millrace.llm import neighbours as N  # noqa: E402
from millrace.llm import packing as K  # noqa: E402
from millrace.llm import shingles as S  # noqa: E402
from millrace.llm.queries import tokenizer_file  # noqa: E402

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_rounds_of_the_neighbour_search_collect_the_drivers_garbage(monkeypatch):
    done = []
    monkeypatch.setattr(common, "durable", lambda df, *how: done.append("written") or "table")
    jvm = SimpleNamespace(System=SimpleNamespace(gc=lambda: done.append("collected")))
    assert N.settled(SimpleNamespace(sparkSession=SimpleNamespace(_jvm=jvm))) == "table" and done == ["written", "collected"]


def test_texts_are_packed_from_small_batches(spark, make_docs, monkeypatch):
    docs, before, seen, write = make_docs([(i, f"text {i}") for i in range(5)]), spark.conf.get(ROWS), [], K.durable
    monkeypatch.setattr(K, "durable", lambda df: (seen.append(spark.conf.get(ROWS)), write(df))[1])
    assert K.pack_documents(docs, tokenizer_file("word_bpe_49k.json")).count() == 5
    assert seen == ["1000"] and spark.conf.get(ROWS) == before


def test_texts_are_shingled_from_small_batches(spark, monkeypatch):
    rows, before, seen, one = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "node long, text string"), spark.conf.get(ROWS), [], S.shared_folder
    monkeypatch.setattr(S, "shared_folder", lambda s: (seen.append(spark.conf.get(ROWS)), one(s))[1])
    spark.sql(f"DROP TABLE {S.written_blocks(spark, rows, 5, 30)}")
    assert seen == ["1000"] and spark.conf.get(ROWS) == before
