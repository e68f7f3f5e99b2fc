"""The pipeline against brute force, and every registered query on a small table against its contract."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from millrace.llm import piece_sampling as P  # noqa: E402
from millrace.llm import quality_ngrams as Q  # noqa: E402
from millrace.llm.queries import QUERIES, tokenizer_file  # noqa: E402
from test_dedup import brute_classes, brute_lines  # noqa: E402
from test_text import kneser_ney  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def token_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids, 2]


def kept_by_quality(docs, labels):
    rows = docs.collect()
    p = kneser_ney([r.text for r in Q.training_sample(docs, labels).collect()])
    nll = {}
    for text in {r.text or "" for r in rows}:
        s = [Q.START, Q.START, *text.split(), Q.END]
        nll[text] = (-sum(math.log(p(*x)) for x in zip(s, s[1:], s[2:])) / (len(s) - 2), len(s) - 2)
    limit = {}
    for lang in {r.lang for r in rows}:
        own = sorted({r.text or "": nll[r.text or ""][0] for r in rows if r.lang == lang}.values())
        low, mid = (own[max(0, math.ceil(q * len(own)) - 1)] for q in (0.25, 0.5))
        limit[lang] = mid + 3 * max(mid - low, Q.LEAST_SPREAD * mid)
    return [r for r in rows if nll[r.text or ""][0] - 2 * Q.WORD_SD / math.sqrt(nll[r.text or ""][1]) <= limit[r.lang]]


def check_packing(rows, texts, max_tokens=4096):
    """Every id of every document in one piece, sequences without gaps, and the packs of shortest-pack-first."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids, at = token_ids(texts[i] or ""), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= max_tokens


def test_pipeline_against_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = kept_by_quality(docs, labels)
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality"](spark, docs, SF)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in good)
    assert 0 < len(good) < docs.count()
    lines = {i: t for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in good], 40, 5)}
    two = stage["line_dedup"](spark, one, SF)
    assert two.columns == docs.columns and {r.doc_id: r.text for r in two.collect()} == lines
    name = brute_classes(list(lines.items()))
    kept = {i for i in lines if name[i] == i}
    three = stage["near_dedup"](spark, two, SF)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == kept
    check_packing(corpus_pipeline.run(spark, SF).collect(), {i: lines[i] for i in kept})


def test_op1_returns_segmentations(spark, docs):
    rows = QUERIES["op1_piece_sampling"](spark, SF).collect()
    by = collections.Counter(r.doc_id for r in rows)
    assert set(by) == {r.doc_id for r in docs.collect()} and max(by.values()) == 3 and all(r.decodes for r in rows)
    file = tokenizer_file("piece_bpe_32k.model")
    few = docs.orderBy("doc_id").limit(20)
    crc = {(r.doc_id, r.sample): r.ids_crc32 for r in rows}
    with_ids = P.sample_pieces(few, file, k=3, theta=1.0, seed=0)
    assert all(crc[r.doc_id, r.sample] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in with_ids.collect())
    texts = {r.doc_id: r.text or "" for r in few.collect()}
    assert all(r.text == texts[r.doc_id] for r in P.decode_pieces(with_ids, file).collect())


def test_op2_classes(spark, docs):
    rows = QUERIES["op2_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_op4_to_op6_columns(spark, docs):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = QUERIES["op4_html_extraction"](spark, SF).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in rows)
    assert sum(r.n_chars > 0 for r in rows) > 0.9 * len(rows)
    assert {"doc_id", "license"} <= set(QUERIES["op5_license_scan"](spark, SF).columns) and QUERIES["op5_license_scan"](spark, SF).count() == docs.count()
    verdicts = QUERIES["op6_quality_classifier"](spark, SF)
    assert {"doc_id", "nll", "keep"} <= set(verdicts.columns) and verdicts.count() == docs.count()


def test_op7_packs_every_document(spark, docs):
    rows = QUERIES["op7_packing"](spark, SF).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    sequences = 1 + max(r.sequence_id for r in rows)
    assert sequences == len({r.sequence_id for r in rows}) and sum(r.length for r in rows) > 0.9 * 4096 * (sequences - 1)


def test_op9_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = QUERIES["op9_nearest_neighbours"](spark, "/root/testdata/sf0.01").collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect() if r.embedding is not None}
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
    hits = 0
    for q in (i for i in ids if i % 20 == 0):
        s = x @ vectors[q]
        s[ids == q] = -np.inf
        hits += len(set(found[q]) & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        assert len(found[q]) == 20
    assert hits >= 0.9 * 20 * len(found)


def test_op10_keeps_what_its_lines_say(spark, docs):
    rows = QUERIES["op10_line_dedup"](spark, SF).collect()
    want = {i: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in brute_lines([(r.doc_id, r.text) for r in docs.collect()], 40, 5)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want


def test_one_query_for_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
