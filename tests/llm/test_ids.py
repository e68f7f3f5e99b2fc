"""Ids beyond 2^53 beside null ids, for the operators whose rows pass through Python."""

import pytest
from millrace.llm import exact_dedup as X
from millrace.llm import html_paths as H
from millrace.llm import line_dedup as L
from millrace.llm import packing as K
from millrace.llm import piece_sampling as P
from millrace.llm.queries import tokenizer_file

IDS = [2**53 + 1, 2**53 + 3, 2**53 + 5, None, None, 2**63 - 1, -(2**63), 0]


@pytest.fixture(scope="module")
def docs(make_docs):
    return make_docs([(i, f"text {n % 3}") for n, i in enumerate(IDS)]).coalesce(1)


def ids(rows, name="doc_id"):
    return sorted(map(str, {r[name] for r in rows}))


WANT = sorted(map(str, set(IDS)))


@pytest.mark.parametrize("largest", [True, False])
def test_exact_dedup(docs, largest):
    groups = {}
    for n, i in enumerate(IDS):
        groups.setdefault(n % 3, []).append(i)
    pick = max if largest else min
    keep = {n: pick(i for i in own if i is not None) for n, own in groups.items()}
    got = X.exact_dedup(docs, largest=largest).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.kept) for r in got) == sorted((str(i), keep[n % 3], i == keep[n % 3]) for n, i in enumerate(IDS))


def test_exact_dedup_without_any_id(make_docs):
    got = X.exact_dedup(make_docs([(None, "a"), (None, "a"), (-(2**63), "b"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in got) == sorted([(str(-(2**63)), str(-(2**63)), True), ("None", "None", True), ("None", "None", True), ("None", str(-(2**63)), False)])


def test_packing(docs):
    assert ids(K.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), 16, 2).collect()) == WANT


def test_piece_sampling(docs):
    rows = P.sample_pieces(docs, tokenizer_file("piece_bpe_32k.model"), k=2)
    assert ids(rows.collect()) == WANT
    assert ids(P.decode_pieces(rows, tokenizer_file("piece_bpe_32k.model")).collect()) == WANT


def test_html(spark):
    pages = spark.createDataFrame([(i, f"http://a.org/{n}", f"<article><p>Text number {n} of this page.</p></article>") for n, i in enumerate(IDS)], "page_id long, url string, html string").coalesce(1)
    got = {r.url: (r.page_id, r.text) for r in H.extract_pages(pages).collect()}
    assert got == {f"http://a.org/{n}": (i, f"Text number {n} of this page.") for n, i in enumerate(IDS)}


def test_line_dedup(spark, make_docs):
    line = "a line of more than forty characters, all in all"
    rows = [(i, f"{line}\nown {n}") for n, i in enumerate(IDS)]
    got = sorted((str(r.doc_id), r.kept_text) for r in L.drop_frequent_lines(make_docs(rows)).collect())
    assert got == sorted((str(i), f"{line}\nown {n}" if i == 2**63 - 1 else f"own {n}") for n, i in enumerate(IDS))


def test_a_third_of_the_rows_without_an_id_is_spread(make_docs, monkeypatch):
    monkeypatch.setattr(L, "CELL_DOCS", 10)
    docs = make_docs([(None if i % 3 == 0 else i, f"text {i} " + "x" * 60) for i in range(300)])
    rows = docs.select("doc_id", "text", *L.row_keys())
    sizes = [r["count"] for r in rows.where("doc_id IS NULL").groupBy(L.F.pmod("row_key", L.F.lit(30))).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 15
    assert L.drop_frequent_lines(docs).count() == 300
