"""The prefix-filtered join against brute force, with passages of any frequency on either side."""

import random

import pytest
from millrace.operators import overlap, similarity


def grams(text, size):
    w = (text or "").split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


@pytest.mark.parametrize(("size", "min_hits", "min_share"), [(3, 2, 0.55), (2, 1, 0.8), (4, 3, 0.3)])
def test_similar_pairs(spark, size, min_hits, min_share):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(25)]
    passage = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(4)]
    text = lambda n: " ".join([rng.choice(passage) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(n)])
    docs = [(i, text(rng.randrange(1, 8))) for i in range(80)] + [(100, passage[0]), (101, None), (102, ""), (103, "w1")]
    items = [(i, text(rng.randrange(1, 5))) for i in range(60)] + [(100, passage[0]), (101, None), (102, passage[1] + " " + passage[2])]
    want = {}
    for d, x in docs:
        for i, y in items:
            a, b = grams(x, size), grams(y, size)
            hits = len(a & b)
            if hits >= min_hits and hits / max(1, min(len(a), len(b))) >= min_share:
                want[d, i] = (hits, hits / min(len(a), len(b)))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for join in (similarity.similar_pairs, overlap.overlap_pairs):
        got = {(r.doc_id, r.item_id): (r.hits, r.share) for r in join(left, right, "doc_id", "item_id", size, min_hits, min_share).collect()}
        assert got == want and len(want) > 100
    assert similarity.similar_pairs(left.limit(0), right, "doc_id", "item_id").collect() == []
