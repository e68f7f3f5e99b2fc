"""Exact dedup, line dedup and near-duplicates against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
from millrace.llm import exact_dedup as X
from millrace.llm import line_dedup as L
from millrace.llm import minhash as M
from millrace.llm import shingles as S
from millrace.llm.components import connected_components

ODD = [(1, "a"), (5, "a"), (3, None), (4, ""), (None, "a"), (None, "z"), (7, "A"), (9, "x" * 100_000), (2, "a"), (2, "a")]


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell_rows", [1, 100_000])
def test_exact_dedup(make_docs, monkeypatch, cell_rows):
    monkeypatch.setattr(X, "CELL_ROWS", cell_rows)
    rng = random.Random(1)
    rows = ODD + [(100 + i, f"t{rng.randrange(30)}") for i in range(90)]
    got = X.exact_dedup(make_docs(rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == exact(rows)
    assert X.exact_dedup(make_docs([])).collect() == []


def test_exact_dedup_smallest(make_docs):
    got = {r.doc_id: r.kept for r in X.exact_dedup(make_docs([(1, "a"), (5, "a"), (3, "b")]), largest=False).collect()}
    assert got == {1: True, 5: False, 3: True}


def brute_lines(rows, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    docs = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                docs.setdefault(k, []).append(-(2**63) if i is None else i)
    gone = {k: max(v) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i if i is not None else -(2**63)) == (i if i is not None else -(2**63))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(make_docs, monkeypatch):
    monkeypatch.setattr(L, "SHARD_LINES", 7)
    rng = random.Random(2)
    shared = ["Footer é" * 6, "menu " * 9, "short", " nbsp stays " + "n" * 40]
    rows = [(i, "\n".join(rng.choice([f"  {rng.choice(shared)}\t", rng.choice(shared).upper(), f"own {i} " * 9]) for _ in range(6))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "menu " * 9), (52, "\n\n"), (52, "menu " * 9), (53, ("menu " * 9 + "\n") * 3), (54, "y" * 50_000)]
    got = L.drop_frequent_lines(make_docs(rows), 40, 5).drop("row_key", "row_key2").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows, 40, 5)
    assert L.drop_frequent_lines(make_docs([])).collect() == []
    docs = make_docs(rows)
    left = L.without_frequent_lines(docs, min_chars=40, min_docs=5)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.where("doc_id < 50").collect()) == sorted((i, t) for i, _, _, t in brute_lines(rows, 40, 5) if i is not None and i < 50)
    assert left.where("n_chars <> length(text)").count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    high, low = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    mph = L.PerfectHash.load(*L.PerfectHash.build(high, low).dump())
    assert sorted(mph.index(high, low).tolist()) == list(range(5000))
    assert L.PerfectHash.build(high[:0], low[:0]).index(high[:3], low[:3]).tolist() == [-1, -1, -1]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3)]
    parent = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def near(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def brute_classes(rows, threshold=0.8):
    """Smallest id of each chain of links, over rows that have ids of their own."""
    texts = {i: t or "" for i, t in rows}
    hashed = {i: np.unique(S.shingle_hashes([t])[0], return_counts=True) for i, t in texts.items()}
    df = collections.Counter(h for x in hashed.values() for h in x[0].tolist())
    own = {i: (h, M.idf_weights(tf, np.array([df[x] for x in h.tolist()]), len(rows), 0.25)) for i, (h, tf) in hashed.items()}
    name = {i: i for i in own}
    for a, b in itertools.combinations(own, 2):
        if name[a] != name[b] and (texts[a] == texts[b] or len(own[a][0]) and len(own[b][0]) and M.weighted_jaccard(own[a], own[b]) >= threshold):
            low, high = sorted((name[a], name[b]))
            name = {i: low if x == high else x for i, x in name.items()}
    return name


def test_near_duplicates(spark, make_docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:8]):
        rows += [(100 * (i + 1) + j, near(t, rng, 1 + j % 5)) for j in range(8)]
    rows += [(2000 + i, base[0]) for i in range(30)]  # equal texts
    rows += [(3000 + i, base[9] + " " + " ".join(rng.choice(words) for _ in range(120))) for i in range(10)]  # a shared passage isn't a link
    rows += [(4000, None), (4001, ""), (4002, "two words"), (4003, "Two words!"), (4004, "!!!"), (None, "alone among them all here"), (4005, base[3]), (4005, base[3])]
    docs = make_docs(rows)
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in M.near_duplicates(docs).collect()}

    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(-(2**63) if i is None else i)
    hashed = {t: np.unique(S.shingle_hashes([t])[0], return_counts=True) for t in texts}
    df = collections.Counter(h for t, ids in texts.items() for h in hashed[t][0].tolist() for _ in ids)
    features = {t: (h, M.idf_weights(tf, np.array([df[x] for x in h.tolist()]), len(rows), 0.25)) for t, (h, tf) in hashed.items()}
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if len(features[a][0]) and len(features[b][0]) and M.weighted_jaccard(features[a], features[b]) >= 0.8:
            parent[find(a)] = find(b)
    classes = {}
    for t, ids in texts.items():
        classes.setdefault(find(t), []).extend(ids)
    want = {}
    for ids in classes.values():
        for i in ids:
            first = min(ids)
            want[None if i == -(2**63) else i] = (None if first == -(2**63) else first, len(ids), i == first)
    assert got == want
    assert M.near_duplicates(make_docs([])).collect() == []
    left = M.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(i for i, (_, _, kept) in want.items() if kept and i is not None)


def test_near_duplicates_of_rows_without_an_id_of_their_own(make_docs):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, b), (None, c), (7, b), (8, a), (8, d), (8, d), (9, c + " more"), (9, "of another kind")]
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.class_size, r.kept) for r in M.near_duplicates(make_docs(rows)).collect()))
    assert got == sorted([(0, 0, 2, True)] * 3 + [(7, 0, 2, False), (8, 0, 2, False), (9, 0, 2, False)] + [(8, 8, 2, True)] * 2 + [(9, 9, 1, True)])
    left = sorted(((r.doc_id or 0), r.text) for r in M.drop_near_duplicates(make_docs(rows)).collect())
    assert left == sorted([(0, a), (0, b), (0, c), (8, d), (9, "of another kind")])


def test_document_frequencies_are_exact(spark, make_docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(S, "SHARD_SHINGLES", 500)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(60))) for _ in range(150)] + ["", "a b c"] * 2 + ["x y z v w " * 400]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string").repartition(3)
    df = collections.Counter(h for t in texts for h in np.unique(S.shingle_hashes([t])[0]).tolist())
    table = S.written_blocks(spark, rows, 5, sum(map(len, texts)))
    blocks = spark.table(table)
    got = {}

    def use(block, nodes, sizes, hashes, counts, note):
        ends = np.cumsum(sizes)
        return M.pd.DataFrame({"node": nodes, "h": [hashes[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)], "c": [counts[:, e - n : e].ravel().tolist() for e, n in zip(ends, sizes, strict=True)]})

    for r in S.with_frequencies(blocks, S.document_frequencies(blocks, sum(map(len, texts))), use, "node long, h array<long>, c array<long>").collect():
        got[r.node] = (r.h, r.c)
    spark.sql(f"DROP TABLE {table}")
    assert set(got) >= {i for i, t in enumerate(texts) if t}
    for i, (h, c) in got.items():
        own, tf = np.unique(S.shingle_hashes([texts[i]])[0], return_counts=True)
        assert h == own.tolist() and c == tf.tolist() + [df[x] for x in h]


@pytest.mark.parametrize("growth", [2, 64])
def test_unlinked_members_of_a_large_bucket_meet(spark, make_docs, monkeypatch, growth):
    """Copies of one text with many edits each: most share buckets, few are linked, and every link counts."""
    monkeypatch.setattr(M, "GROUP_ROWS", 8)
    monkeypatch.setattr(M, "ROUND_GROWTH", growth)
    rng = random.Random(7)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(120))
    rows = [(i, near(base, rng, rng.choice([1, 2, 3, 4, 5, 6]))) for i in range(60)]
    got = {r.doc_id: r.class_id for r in M.near_duplicates(make_docs(rows), bands=30, rows=1).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) > 1


def test_samples_agree_as_often_as_sets():
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 2**48, 300).astype(np.uint64))
    wa, wb = rng.uniform(1, 3, 200), rng.uniform(1, 3, 200)
    a, b = h[:200], h[100:]
    wb[:100] = wa[100:] * rng.choice([1.0, 1.0, 1.5], 100)
    s = M.icws(np.concatenate((a, b)), np.concatenate((wa, wb)), np.array([200, 200]), 4000)
    assert abs((s[0] == s[1]).mean() - M.weighted_jaccard((a, wa), (b, wb))) < 0.03


def test_blocks_of_shingles_leave_nothing_behind(spark, make_docs):
    import glob
    from pathlib import Path

    from millrace.llm.common import shared_folder

    folder = shared_folder(spark)
    before = set(glob.glob(f"{folder}/shingle_blocks_*"))
    M.near_duplicates(make_docs([(i, f"one two three four five six {i % 3}") for i in range(9)])).collect()
    assert set(glob.glob(f"{folder}/shingle_blocks_*")) == before and not [t for t in spark.catalog.listTables() if t.name.startswith("shingle_blocks")]
    warehouse = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    assert not list(warehouse.glob("shingle_blocks*"))
