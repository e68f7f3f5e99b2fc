"""Scans and pair counts over rows in order, against plain loops, with keys that span many cells."""

import random

import pytest
from millrace.operators import order_counts as O
from millrace.operators import scans as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    keys = ["hot"] * 300 + [None] * 40 + [f"k{rng.randrange(25)}" for _ in range(160)]
    return [(k, i, rng.randrange(-50, 50)) for i, k in enumerate(rng.sample(keys, len(keys)))]


def by_key(rows):
    out = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((i, v))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, v long").repartition(5)


@pytest.mark.parametrize("n_cells", [1, 7, 40])
@pytest.mark.parametrize("by", [["k"], []])
def test_recurrences(spark, rows, n_cells, by):
    groups = by_key(rows if by else [(0, i, v) for _, i, v in rows])
    lcg, poly = {}, {}
    for own in groups.values():
        x = 17
        for n, (i, v) in enumerate(own):
            x = lcg[i] = (5 * x + v) % 101
            poly[i] = sum(w * 3**j for j, (_, w) in enumerate(own[: n + 1])) % 1009
    df = frame(spark, rows)
    assert {r.i: r.x for r in S.congruential(df, by, ["i"], 5, F.col("v"), 17, 101, n_cells=n_cells).collect()} == lcg
    assert {r.i: r.x for r in S.polynomial(df, by, ["i"], 3, F.col("v"), 1009, n_cells=n_cells).collect()} == poly


def test_a_null_row_leaves_the_state_as_it_is(spark):
    df = spark.createDataFrame([(1, 4), (2, None), (3, 1)], "i long, v long")
    assert {r.i: r.x for r in S.congruential(df, [], ["i"], 2, F.col("v"), 0, 100).collect()} == {1: 4, 2: 4, 3: 9}
    assert S.congruential(df.limit(0), [], ["i"], 2, F.col("v"), 0, 100).collect() == []


@pytest.mark.parametrize("n_cells", [1, 7, 40])
def test_thinning(spark, rows, n_cells):
    want = set()
    for own in by_key(rows).values():
        last = None
        for i, v in own:
            if last is None or abs(v - last) >= 30:
                last = v
                want.add(i)
    got = S.thinned(frame(spark, rows), ["k"], ["i"], "v", 30, n_cells=n_cells)
    assert got.columns == ["k", "i", "v", "kept"] and {r.i for r in got.where("kept").collect()} == want


def test_thinning_that_never_forgets(spark):
    # only the first row is kept, so every cell must hear of it: a round a cell
    df = frame(spark, [("a", i, i % 5) for i in range(200)])
    assert [r.i for r in S.thinned(df, ["k"], ["i"], "v", 10, n_cells=6).where("kept").collect()] == [0]


def test_columns_of_the_input_may_have_any_name(spark, rows):
    names = "cell first state scan_cell scan_key map pair_key next_key next_row inside across smaller earlier found record target above at v2 n".split()
    df = frame(spark, rows).select("k", "i", "v", *[F.col("i").alias(c) for c in names])
    for out in (S.thinned(df, ["k"], ["i"], "v", 30, n_cells=5), S.congruential(df, ["k"], ["i"], 5, F.col("v"), 17, 101, n_cells=5), O.earlier_not_greater(df, ["k"], "i", "v", "was", 5), O.next_greater(df, ["k"], "i", "v", n_cells=5)):
        assert out.columns[:-1] == df.columns and out.count() == len(rows)
        assert out.where(" OR ".join(f"{c} <> i" for c in names)).count() == 0


def test_carried(spark):
    data = [("a", i, i if i % 9 == 4 else None) for i in range(60)] + [("b", 0, None)]
    got = {(r.k, r.i): r.last for r in S.carried(frame(spark, data), ["k"], ["i"], "v", "last", S.T.LongType(), n_cells=9).collect()}
    assert got == {("a", i): (i - (i - 4) % 9 if i >= 4 else None) for i in range(60)} | {("b", 0): None}


@pytest.mark.parametrize("n_cells", [1, 6, 30])
def test_pairs_in_order(spark, rows, n_cells):
    groups = by_key(rows)
    earlier = {i: sum(w <= v for _, w in own[:n]) for own in groups.values() for n, (i, v) in enumerate(own)}
    got = O.earlier_not_greater(frame(spark, rows), ["k"], "i", "v", n_cells=n_cells)
    assert got.columns == ["k", "i", "v", "earlier"] and {r.i: r.earlier for r in got.collect()} == earlier
    inv = {k: sum(a > b for n, (_, b) in enumerate(own) for _, a in own[:n]) for k, own in groups.items()}
    assert {r.k: (r.n, r.inversions) for r in O.inversions(frame(spark, rows), ["k"], "i", "v", n_cells).collect()} == {k: (len(groups[k]), x) for k, x in inv.items()}
    after = {i: next((w for _, w in own[n + 1 :] if w > v), None) for own in groups.values() for n, (i, v) in enumerate(own)}
    got = O.next_greater(frame(spark, rows), ["k"], "i", "v", n_cells=n_cells)
    assert got.columns == ["k", "i", "v", "next"] and {r.i: r.next for r in got.collect()} == after


def test_cells_grow_in_number_and_not_in_size(spark, rows, monkeypatch):
    monkeypatch.setattr(O, "CELL_ROWS", 20)
    used = []
    cut = S.in_cells
    monkeypatch.setattr(S, "in_cells", lambda df, by, order, n_cells=None: used.append(n_cells) or cut(df, by, order, n_cells))
    O.next_greater(frame(spark, rows), ["k"], "i", "v")
    O.earlier_not_greater(frame(spark, rows), ["k"], "i", "v")
    assert len(used) == 4 and min(used) == 25


@pytest.mark.parametrize("values", [range(200), range(200, 0, -1), [5] * 200, [*range(100, 0, -1), 1000, *range(99)]])
def test_pairs_of_one_key_alone(spark, values):
    values = list(values)
    df = frame(spark, [("a", i, v) for i, v in enumerate(values)])
    assert {r.i: r.next for r in O.next_greater(df, ["k"], "i", "v", n_cells=8).collect()} == {i: next((w for w in values[i + 1 :] if w > v), None) for i, v in enumerate(values)}
    assert O.inversions(df, [], "i", "v", 8).collect()[0].inversions == sum(a > b for i, b in enumerate(values) for a in values[:i])


@pytest.mark.parametrize("anchors", [2, 256])
def test_sums(spark, monkeypatch, anchors):
    import itertools

    from millrace.operators import sums

    monkeypatch.setattr(sums, "ANCHORS", anchors)
    rng = random.Random(8)
    data = [(k, rng.randrange(-12, 13)) for k in ("a", "b", "c") for _ in range({"a": 60, "b": 9, "c": 2}[k])] + [("d", 0)] * 3 + [("e", None), ("e", 0)]
    df = spark.createDataFrame(data, "k string, v long")
    own = {k: [v for x, v in data if x == k and v is not None] for k in "abcde"}
    for size, f in ((2, sums.pairs_with_sum), (3, sums.triples_with_sum)):
        want = {(k, *t) for k, vs in own.items() for t in itertools.combinations(sorted(vs), size) if sum(t) == 0}
        got = [tuple(r) for r in f(df, ["k"], "v", 0).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 5
    assert sums.triples_with_sum(df.limit(0), ["k"], "v", 0).collect() == []
