"""Shards along the curve, and ranked search, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from millrace.llm import hilbert_shards as H
from millrace.llm import lexical_search as X
from millrace.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    grid = spark.range(1 << (n * bits))
    points = grid.select(*[F.shiftright("id", i * bits).bitwiseAND((1 << bits) - 1).alias(f"p{i}") for i in range(n)])
    rows = points.withColumn("at", H.hilbert_index([F.col(f"p{i}") for i in range(n)], bits)).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a[f"p{i}"] - b[f"p{i}"]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_bins_keep_order(spark):
    numbers = [None, -(2**63), -70, -1, 0, 1, 5, 63, 64, 65, 127, 128, 1000, 1001, 10**6, 2**62]
    table = spark.createDataFrame([(x,) for x in numbers], "x long").select(H.number_bin(F.col("x")).alias("b"))
    got = [r.b for r in table.collect()]
    assert got == sorted(got)
    words = [None, "", "src", "src0", "src1", "src10", "src2", "srcé"]
    got = [r.b for r in spark.createDataFrame([(x,) for x in words], "x string").select(H.string_bin(F.col("x"), 0).alias("b")).collect()]
    assert got == sorted(got)
    got = [r.b for r in spark.createDataFrame([(x,) for x in words[2:]], "x string").select(H.string_bin(F.col("x"), 3).alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)
    assert H.shared_prefix("src0", "src9") == 3 and H.shared_prefix(None, None) == 0 and H.shared_prefix("a", "a") == 1


def check_law(got, want, n_shards):
    """``want``: (doc_id, text) rows. Every row once, sizes and checksums right, counts one apart, slots without gaps in curve order."""
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in want), key=str)
    counts = Counter(r.shard for r in got)
    held = [counts[s] for s in range(n_shards)]
    assert sum(held) == len(want) and (not held or max(held) - min(held) <= 1)
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    ordered = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_op12_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op12_hilbert_shards"](spark, SF)
    assert dict(rows.dtypes)["size"] == dict(rows.dtypes)["text_crc32"] == dict(rows.dtypes)["slot"] == "bigint" and dict(rows.dtypes)["shard"] == dict(rows.dtypes)["grown_shard"] == "int"
    check_law(rows.collect(), [(r.doc_id, r.text) for r in docs.collect()], 40)


@pytest.mark.parametrize("part_rows", [1, 10_000])
def test_shards_of_odd_rows(spark, make_docs, monkeypatch, part_rows):
    monkeypatch.setattr(H, "PART_ROWS", part_rows)
    rng = random.Random(part_rows)
    rows = [(None, None), (None, "a"), (None, "b"), (2**53 + 1, "x"), (2**63 - 1, "x"), (-(2**63), ""), (7, "é" * 30_000)]
    rows += [(5, "same")] * 40 + [(None, "same")] * 20 + [(i, "w " * rng.randrange(60)) for i in range(100)]
    docs = make_docs(rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.lit("en")))
    first = H.hilbert_shards(docs.repartition(5), 8).collect()
    check_law(first, rows, 8)
    again = H.hilbert_shards(docs.coalesce(1), 8).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)
    check_law(H.hilbert_shards(docs.limit(3), 8, ("lang", "n_chars")).collect(), rows[:3], 8)
    assert H.hilbert_shards(docs.limit(0), 8).collect() == []
    few = docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text"))
    check_law(H.hilbert_shards(few, 8, ()).collect(), rows * 2, 8)


def test_written_shards_prune_by_every_dimension(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    H.write_shards(docs, str(tmp_path / "out"), 40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").exceptAll(docs.select(*back.drop("shard").columns)).count() == 0 and back.count() == docs.count()
    ends = back.groupBy("shard").agg(F.min("lang").alias("l0"), F.max("lang").alias("l1"), F.min("source").alias("s0"), F.max("source").alias("s1"), F.min(F.octet_length("text")).alias("b0"), F.max(F.octet_length("text")).alias("b1")).collect()
    assert len(ends) == 40
    # a filter on one dimension alone leaves out a good part of the files, whichever it is
    read = lambda want: sum(map(want, ends)) / 40
    assert read(lambda r: r.l0 <= "es" <= r.l1) < 0.5
    assert read(lambda r: r.s0 <= "src7" <= r.s1) < 0.7
    assert read(lambda r: r.b1 >= 20_000) < 0.7


def terms(text):
    return [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_search(docs, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 100 - 90 + 90 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("part_bytes", "block"), [(8_000_000, 1_000_000), (60, 1)])
def test_search_against_brute_force(spark, make_docs, monkeypatch, part_bytes, block):
    monkeypatch.setattr(X, "PART_BYTES", part_bytes)
    monkeypatch.setattr(X, "BLOCK", block)
    rng = random.Random(3)
    words = "the The THE a été Été naïve 日本 x1 x2 1 22 o'clock a_b foo-bar ﬁ İ ſ K".split()
    text = lambda n: rng.choice([" ", "  ", "\n", " ", ", "]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 30))) for i in range(60)] + [(3, "the a"), (3, "the a"), (None, "the x1"), (2**53 + 1, "22 22"), (2**63 - 1, "22 22"), (-(2**63), "22 22"), (8, None), (9, ""), (10, "..."), (11, "été " * 20_000)]
    items = [(i, text(6)) for i in range(12)] + [(20, None), (21, ""), (None, "the 22"), (12, "the"), (12, "22"), (12, "22"), (13, "unseen"), (14, "th e t he")]
    table = spark.createDataFrame([(*r, 1, 1, 1) for r in items], "item_id long, text string, rank int, item int, doc_id int")
    got = X.search(make_docs(docs).repartition(5), table).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items)
    assert X.search(make_docs([]), table).collect() == [] and X.search(make_docs(docs), table.limit(0)).collect() == []
    assert X.search(make_docs([(1, None), (2, "!")]), table).collect() == []


def test_sums_beyond_doubles_are_exact(spark, make_docs, monkeypatch):
    part = X.Part([b"a b", b"b c"], [1, 2])
    docs = make_docs([(1, "a b"), (2, "b c c")]).select("doc_id", F.col("text").cast("binary").alias("text"))
    weights = X.np.array([2**35, 3, 5], X.np.int64)
    got = {(r.item, r.doc_id): r.score for r in X.best_of_task(docs, part, weights, 2, 5, 10).collect()}
    m = lambda n: 10 + 90 * n * 2 // 5
    gain = lambda w, tf, n: w * (10**9 * tf // (1000 * tf + 8 * m(n)))
    assert got[0, 1] == gain(2**35, 1, 2) + gain(3, 1, 2) and got[1, 2] == gain(3, 1, 3) + gain(5, 2, 3)
