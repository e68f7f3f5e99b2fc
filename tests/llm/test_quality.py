"""The quality models against brute force: every trusted text trains, and none is judged by a model that has seen it."""

import math

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from millrace.llm import quality_ngrams as Q  # noqa: E402
from pyspark.sql import GroupedData  # noqa: E402
from test_dedup import brute_classes, brute_lines  # noqa: E402
from test_pipeline import check_packing  # noqa: E402
from test_text import kneser_ney  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_nll(docs, labels):
    """``{text: (nll, words)}`` by dictionaries: two models of all trusted texts, each judging the other half's documents."""
    rows = docs.select("doc_id", *Q._text_keys(), "text").withColumn("part", Q._part()).collect()
    half = {r.text or "": r.part % 2 for r in rows}
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    good = {r.text for r in rows if r.text and r.doc_id in trusted}
    models = [kneser_ney(sorted(t for t in good if half[t] != h)) for h in (0, 1)]
    out = {}
    for text, h in half.items():
        s = [Q.START, Q.START, *text.split(), Q.END]
        out[text] = (-sum(math.log(models[h](*x)) for x in zip(s, s[1:], s[2:])) / (len(s) - 2), len(s) - 2)
    return out


def test_every_trusted_text_trains_whole(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    long = " ".join(f"word{i % 7000}" for i in range(9000))
    more = [(10**6 + i, t, "en") for i, t in enumerate([long, long + " more", long + " and more", "copy " + long, None, ""])]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(i, 1) for i, _, _ in more], "doc_id long, quality int"))
    want = brute_nll(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = Q.quality_verdicts(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.n_words == want[texts[r.doc_id]][1] and r.nll == pytest.approx(want[texts[r.doc_id]][0], abs=1e-9) for r in got)


def test_pipeline_with_models_of_all_trusted_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    nll, rows, limit = brute_nll(docs, labels), docs.collect(), {}
    for lang in {r.lang for r in rows}:
        own = sorted({r.text or "": nll[r.text or ""][0] for r in rows if r.lang == lang}.values())
        low, mid = (own[max(0, math.ceil(q * len(own)) - 1)] for q in (0.25, 0.5))
        limit[lang] = mid + 3 * max(mid - low, Q.LEAST_SPREAD * mid)
    good = [r for r in rows if nll[r.text or ""][0] - 2 * Q.WORD_SD / math.sqrt(nll[r.text or ""][1]) <= limit[r.lang]]
    assert 0 < len(good) < len(rows)
    one = dict(corpus_pipeline.STAGES)["quality"](spark, docs, SF)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in good)
    lines = {i: t for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in good], 40, 5)}
    name = brute_classes(list(lines.items()))
    check_packing(corpus_pipeline.run(spark, SF).collect(), {i: lines[i] for i in lines if name[i] == i})


def test_blocks_get_their_answers_in_any_order_of_rows(spark, monkeypatch):
    texts = [f"{'abcdefgh'[i % 8]} b c {i % 7} last{i}" for i in range(60)]
    rows = spark.createDataFrame([(i, i // 3, t) for i, t in enumerate(texts)], "key long, key2 long, text string")
    model = Q.train(spark.createDataFrame([(t,) for t in texts[::2]], "text string"))
    p = kneser_ney(texts[::2])
    seqs = [[Q.START, Q.START, *t.split(), Q.END] for t in texts]
    want = {i: -sum(math.log(p(*x)) for x in zip(s, s[1:], s[2:])) / (len(s) - 2) for i, s in enumerate(seqs)}
    one = GroupedData.applyInPandas  # a shuffle may hand on the rows of a block in one order when it asks and in another when it is scored
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: one(self, lambda pdf: f(pdf[::-1]), schema))
    assert {r.key: r.nll for r in Q.score_texts(rows, *model).collect()} == pytest.approx(want, abs=1e-9)


def test_models_take_little_room(spark):
    """Sorted keys, numbers and blocks come back as they were, in fewer bytes; a model is bucketed, so that scoring doesn't shuffle it."""
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 48, 20_000, np.uint64))
    assert (Q._unpack_gaps(Q._pack_gaps(keys)) == keys).all() and len(Q._pack_gaps(keys)) < 5 * len(keys)
    assert all((Q._unpack_gaps(Q._pack_gaps(keys[:n])) == keys[:n]).all() for n in (0, 1))
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 300) % 5000) for _ in range(40)]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "key long, key2 long, text string")
    block = Q.text_blocks(rows, None, 1).toPandas().iloc[0]
    ids, h, sizes = Q._unpacked(block)
    at = {k: i for i, k in enumerate(np.frombuffer(block["keys"], "<i8").reshape(-1, 2)[:, 0].tolist())}
    begin = np.cumsum(sizes) - sizes
    assert all(h[ids[begin[at[i]] + 2 : begin[at[i]] + sizes[at[i]] - 1]].tolist() == [Q.word_hash(w) for w in t.split()] for i, t in enumerate(texts))
    (model, shards, name), _ = Q.train(rows.select("text"))
    plan = model.groupBy("shard").applyInPandas(lambda pdf: pdf[["shard"]], "shard long")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and model.select("shard").distinct().count() == shards
    Q._forget((model, shards, name))
    assert not spark.catalog.tableExists(name)
