"""Kernels, statistics and validators against brute force and published values."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from millrace.functions import arrays as A
from millrace.functions import numbers as M
from millrace.functions import stats as S
from millrace.functions import text as X
from millrace.functions import validators as V
from millrace.operators.kernels import compensated
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("k", "n", "low", "high"), [(1117, 1319, 0.8264136127759949, 0.8652792532880287), (1275, 1319, 0.9555150939070569, 0.9750574942074928)])
def test_wilson(spark, k, n, low, high):
    a, b = S.wilson(F.col("k"), F.col("n"))
    row = spark.createDataFrame([(k, n)], "k long, n long").select(a, b).first()
    assert row == pytest.approx((low, high), abs=1e-12)


def test_mcnemar(spark):
    rows = spark.createDataFrame([(17, 175), (0, 0), (5, 5), (1, 9)], "b long, c long").select(S.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0
    assert rows[0].p == pytest.approx(3.1281607788081394e-34, rel=1e-9)
    assert [r.p for r in rows] == pytest.approx([exact(17, 175), 1.0, exact(5, 5), exact(1, 9)], rel=1e-9)


def test_mcnemar_below_what_doubles_hold(spark):
    rows = spark.createDataFrame([(1000, 20_000), (300, 1700), (60, 1000)], "b long, c long").select(S.log_p(S.mcnemar(F.col("b"), F.col("c"))).alias("p")).collect()
    whole = lambda b, c: math.log(2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1))) - (b + c) * math.log(2)
    assert rows[0].p == -math.inf and [r.p for r in rows[1:]] == pytest.approx([whole(300, 1700), whole(60, 1000)], rel=1e-9)


def test_nearest_rank_isnt_interpolated(spark):
    row = spark.range(20).agg(S.nearest_rank(F.collect_list("id"), 0.95).alias("a"), S.upper_median(F.collect_list("id")).alias("b"), F.percentile("id", 0.95).alias("c")).first()
    assert row == (18, 10, pytest.approx(18.05))


@pytest.mark.parametrize("x", [[0.3, -1.2, 0.9, 0.05, 2.0], [1.0, 1.0, -1.0, 1.0, 0.5], [0.0, 0.0, 0.1, 0.0, 0.0]])
def test_exact_scale_is_best_of_all_codes(spark, x):
    s = one(spark, A.exact_scale(F.col("x")), x=x)
    error = lambda scale, code: sum((v - scale * c) ** 2 for v, c in zip(x, code, strict=True))
    best = math.inf
    for code in itertools.product((-1, 0, 1), repeat=5):
        own = sum(map(abs, code)) and sum(v * c for v, c in zip(x, code, strict=True)) / sum(c * c for c in code)
        best = min(best, error(own, code))
    mine = min(error(s, code) for code in itertools.product((-1, 0, 1), repeat=5))
    assert mine == pytest.approx(best, abs=1e-12)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 127, 128, 129, 1025])
def test_packing_round_trips(spark, n):
    q = [(i * 7 + i // 3) % 3 - 1 for i in range(n)]
    packed = A.pack_trits(F.col("q"))
    assert one(spark, A.unpack_trits(packed, F.size("q")), q=q) == q
    assert one(spark, A.unpack_pairs(A.pack_pairs(F.transform("q", lambda v: (v + 1).cast("int"))), F.size("q")), q=q) == [v + 1 for v in q]


def test_packed_byte(spark):
    assert one(spark, A.pack_trits(F.col("q")), q=[1, -1, 0, 1, 1]) == [227]


def test_hadamard_matches_its_matrix(spark):
    x = [float(i * i % 7 - 3) for i in range(16)]
    got = one(spark, A.hadamard(F.col("x"), 16), x=x)
    want = [sum(v * (-1) ** (i & j).bit_count() for j, v in enumerate(x)) / 4 for i in range(16)]
    assert got == pytest.approx(want)
    assert one(spark, A.hadamard_at(F.col("x"), 16, 5), x=x) == pytest.approx(want[5])


def test_half_even_codes(spark):
    assert one(spark, A.trits(F.col("x"), F.lit(1.0)), x=[0.5, -0.5, 1.5, 0.51, -3.0]) == [0, 0, 1, 1, -1]


def test_masks(spark):
    df = spark.createDataFrame([([[1, 0, 0], [0, 1, 0]], [True, True, False]), ([[1, 1, 0], [0, 1, 0]], [True, True, False])], "m array<array<int>>, w array<boolean>")
    assert [r[0] for r in df.select(A.is_partition(F.col("m"), F.col("w"))).collect()] == [True, False]
    assert one(spark, A.mask_labels(F.col("ids"), F.lit(2)), ids=[5, 6, 7]) == [-100, -100, 7]
    assert one(spark, A.thin(F.col("x"), 2.0), x=[0.0, 1.0, 2.0, 3.5, 4.0]) == [0.0, 2.0, 4.0]
    assert one(spark, A.run_lengths_max(F.col("x")), x=[1, 1, 2, 2, 2, 1]) == 3


def test_text(spark):
    assert [one(spark, X.norm(F.col("t")), t=t) for t in ("ﬁnal ΟΔΟΣ ŉ", "ﬄ")] == ["final οδοσ ʼn".replace("ʼ", "ʼ"), "ffl"]
    cases = ["Straße  UND_x 12!", "", "a", None]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(X.norm(F.col("t")).alias("n"), F.size(X.shingles(F.col("t"), 2)).alias("s"), X.word_count(F.col("t")).alias("w")).collect()
    assert [r.n for r in rows] == ["strasse und_x 12", "", "a", None]
    assert [r.s for r in rows][:3] == [2, 0, 0]
    assert [r.w for r in rows][:3] == [3, 0, 1]
    t = lambda f, v: one(spark, f(F.col("t")), t=v)
    assert t(X.final_text, "<think>x</think> a </think> b <|end|>") == "b"
    assert t(X.last_fence, "```py\na\n```\n```\nb\n```") == "b\n"
    assert t(X.boxed_integer, r"so \boxed{ -5 }") == -5 and t(X.boxed_integer, r"\boxed{1} \boxed{2}") is None and t(X.boxed_integer, r"\boxed{\frac{1}{2}}") is None
    assert t(X.boxed, r"\boxed{\frac{1}{2}} and \boxed{x} or \boxed{open") == [r"\frac{1}{2}", "x"]
    assert t(lambda c: X.occurrences(c, "the"), "The other; the, there") == 2
    assert t(X.has_control, "a <|end|>") is True and t(X.has_control, "a < b |>") is False
    assert t(X.scrub_paths, "at /home/me/x.txt now") == "at LOCAL/x.txt now"
    assert t(X.canonical_json, '{"b":1, "a":[1, 2]}') == '{"a":[1,2],"b":1}'
    assert one(spark, X.duration(F.lit(3700.0))) == "1 h 01 min"


def test_exact_arithmetic():
    assert V.exact_value("1/3 + 2*(4-1)**2") == Fraction(55, 3)
    assert [V.exact_value(x) for x in ("1/0", "__import__('os')", "2**101", "x+1", "1" * 501, None, "factorial(201)", "factorial(-1)", "abs(1, 2)", "lcm(1/2, 3)", "comb(10001, 2)")] == [None] * 11
    assert V.exact_value("factorial(200)") == math.factorial(200) and V.exact_value("comb(10000, 5000)") == math.comb(10000, 5000) and V.exact_value("gcd(12, 18, 8)") == 2
    hostile = ("(((2**64)**64)**64)**64", "((((9**64)**64)**64)**64)**8", "comb(10000, 5000) + 1", "factorial(200)" + "*factorial(200)" * 20)
    assert [V.exact_value(x) for x in hostile] == [None] * 4
    assert [V.exact_value(x, {"a": 3}, V.WITNESS) for x in ("a**9", "factorial(3)", "+".join(["1"] * 80), "a**8", "gcd(a, 6)")] == [None, None, None, 6561, 3]
    assert V.exact_value("2**-2 + 0.75") == 1 and V.exact_value(" gcd(12, 18) * comb(5, 2) - factorial(4) ") == 36 and V.exact_value("abs(-7) % 4") == 3
    assert V.exact_value("-7 // 2") == -4 and V.exact_value("1.1 * 3") == Fraction(33, 10)
    assert V.exact_value("a*a - b", {"a": 5, "b": 3}) == 22


def test_exact_arithmetic_in_batches(spark):
    rows = spark.createDataFrame([("1/3 + 1/6", "0.5"), ("oops", "1"), ("2", None), ("3", "2")], "a string, g string")
    got = rows.select(V.exact_fraction(F.col("a")).alias("f"), V.scored(F.col("a"), F.col("g")).alias("s")).collect()
    assert [r.f for r in got] == ["1/2", None, "2/1", "3/1"]
    assert [tuple(r.s) for r in got] == [(True, None), (False, "not evaluable"), (False, "no gold value"), (False, None)]
    pairs = spark.createDataFrame([("(a+b)**2", "a*a + 2*a*b + b*b"), ("a*b", "a+b"), ("a/b", "a/b")], "x string, y string")
    check = V.identity_holds(F.col("x"), F.col("y"), ["a", "b"], [(1, 2), (2, 2), (-3, 0)])
    assert [r[0] for r in pairs.select(check).collect()] == [True, False, False]


def test_number_theory(spark):
    cases = [(12, 18), (-12, 18), (0, 5), (7, 0), (2**62, 6), (1, 1)]
    rows = spark.createDataFrame(cases, "a long, b long").select(M.gcd(F.col("a"), F.col("b")).alias("g"), M.floor_mod(F.col("a"), F.col("b")).alias("m"), M.floor_div(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.g for r in rows] == [math.gcd(a, b) for a, b in cases]
    assert [(r.m, r.d) for r in rows] == [(a % b, a // b) if b else (None, None) for a, b in cases]
    assert one(spark, M.lcm(F.col("a"), F.col("b")), a=12, b=18) == 36
    for n, k in [(5, 2), (60, 30), (4, 0), (4, 5), (10, 9)]:
        assert one(spark, M.choose(F.col("n"), F.col("k")), n=n, k=k) == math.comb(n, k)
    assert one(spark, M.modular_power(F.col("b"), F.col("e"), F.col("m")), b=7, e=12345678901, m=1000003) == pow(7, 12345678901, 1000003)
    assert one(spark, M.progress_line(F.col("d"), F.col("n"), M.remaining_seconds(F.col("d"), F.col("n"), F.lit(30.0))), d=3, n=12) == "3/12 eta 90 s"


def test_array_checks(spark):
    x = [3, 1, 2, 2, 5, 4]
    assert one(spark, A.earlier_not_larger(F.col("x")), x=x) == [sum(e <= v for e in x[:i]) for i, v in enumerate(x)]
    assert one(spark, A.next_larger(F.col("x")), x=x) == [5, 2, 5, 5, None, None]
    assert one(spark, A.block_reversed(F.col("x"), 4), x=x) == [2, 2, 1, 3, 4, 5]
    assert one(spark, A.remainder_histogram(F.col("x"), 3), x=x) == [1, 2, 3]
    assert [one(spark, A.strictly_sorted(F.col("x")), x=v) for v in ([1, 2, 9], [1, 1], [4])] == [True, False, True]
    assert one(spark, A.swap_heads(F.col("x"), 2, 3, 1), x=[0, 1, 2, 3, 4, 5]) == [0, 3, 1, 4, 2, 5]
    assert [one(spark, A.delimiter_once_before(F.col("x"), F.lit(9), F.lit(7)), x=v) for v in ([1, 9, 7], [9, 9, 7], [7, 9], [9, 1])] == [True, False, False, False]
    assert one(spark, A.lerp(F.col("x"), F.col("y"), 0.25), x=[0.0, 4.0], y=[4.0, 0.0]) == [1.0, 3.0]
    assert one(spark, A.ternary_bits(F.lit(1000), 128, 16), x=1) == pytest.approx((200 * 8 + 8 * 16) / 1000)


def test_compensated_codes_lose_less(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(12, 12))
    inputs = rng.normal(size=(400, 12)) @ mix
    rows = [(0, i, rng.normal(size=12).tolist()) for i in range(30)]
    weights = spark.createDataFrame(rows, "layer int, row int, w array<double>")
    moments = spark.createDataFrame([(0, (inputs.T @ inputs / 400).ravel().tolist())], "layer int, h array<double>")
    got = {r.row: (np.array(r.q), np.array(r.w)) for r in compensated(weights, moments, "layer", "row", "w", "h").collect()}
    error = lambda q, w: float(((inputs @ (w - q)) ** 2).sum())
    plain = sum(error(np.rint(np.clip(w / np.abs(w).mean(), -1, 1)) * np.abs(w).mean(), w) for _, w in got.values())
    assert len(got) == 30 and sum(error(q, w) for q, w in got.values()) < 0.8 * plain
    assert all(len(set(np.round(np.abs(q[q != 0]), 9))) <= 1 for q, _ in got.values())
    # a scale for every five weights: each code is a weight's own group's mean magnitude, or nothing
    for r in compensated(weights, moments, "layer", "row", "w", "h", group=5).collect():
        q, w = np.array(r.q), np.array(r.w)
        scale = np.concatenate([np.full(len(w[i : i + 5]), np.abs(w[i : i + 5]).mean()) for i in range(0, 12, 5)])
        assert np.all((np.abs(np.abs(q) - scale) < 1e-9) | (q == 0))


def test_constraints(spark):
    rows = [("min_words", "a b c", "3"), ("max_words", "a b c", "2"), ("word_once", "Tea, then tea", "tea"), ("word_banned", "no milk", "tea"), ("paragraphs", "a\n\nb", "2"), ("lines_start", "- a\n- b", "- "), ("ends", "yes. ", "."), ("odd", "x", "x")]
    df = spark.createDataFrame(rows, "k string, a string, x string")
    assert [r[0] for r in df.select(V.constrained(F.col("k"), F.col("a"), F.col("x"))).collect()] == [True, False, False, True, True, True, True, False]
    assert one(spark, V.grounded(F.lit("Paris"), F.lit("in paris now"), F.lit("he was in paris now."))) is True


def test_counter_examples(spark):
    rows = [("a*a", "2*a", '{"a": 3}'), ("a*a", "2*a", '{"a": 2}'), ("a/0", "1", '{"a": 1}'), ("a", "b", '{"a": 1.5}'), ("a", "b", None), ("a", "b", "[1]"), ("1", "2", "{}")]
    got = [r.r for r in spark.createDataFrame(rows, "l string, r string, x string").select(V.refuted(F.col("l"), F.col("r"), F.col("x")).alias("r")).collect()]
    assert [r.problem for r in got] == [None, "equal", "not evaluable", "bad assignment", "bad assignment", "bad assignment", None]
    assert (got[0].left, got[0].right, got[0].refuted) == ("9/1", "6/1", True)


def test_rows_share_a_parsed_expression():
    V._parsed.cache_clear()
    assert [V.exact_value("a * a", {"a": i}, V.WITNESS) for i in range(50)] == [i * i for i in range(50)]
    assert V._parsed.cache_info().misses == 1
    assert V.exact_value("+".join(["1"] * 60), None, V.WITNESS) is None and V.exact_value("+".join(["1"] * 30), None, V.WITNESS) == 30
    nines = "9" * 300
    assert V.exact_value(nines, None, V.WITNESS) == int(nines) and V.exact_value(f"{nines} * {nines}", None, V.WITNESS) is None


def test_labels_to_the_end(spark):
    cases = [([-100, 5, 6], True), ([5], True), ([-100, 5, -100], False), ([5, -100, 6], False), ([-100], False), ([], False)]
    rows = spark.createDataFrame([(x,) for x, _ in cases], "x array<int>").select(A.supervised_to_the_end(F.col("x")).alias("ok"))
    assert [r.ok for r in rows.collect()] == [want for _, want in cases]


def test_json_inside_text(spark):
    t = lambda f, x: one(spark, f(F.col("x")), x=x)
    assert t(lambda c: X.json_where(c, lambda v: v > 0), "[3, -1, 2.5]") == "[3.0,2.5]"
    assert t(X.json_summary, "[1, 2.5]") == '{"count":2,"sum":3.5}' and t(X.json_summary, "[]") == '{"count":0,"sum":0.0}' and t(X.json_summary, "no") is None


@pytest.mark.parametrize("n_cells", [8, 4096])
def test_medians_hold_no_group(spark, n_cells):
    import random
    import statistics

    from millrace.operators import comparison as C

    rng = random.Random(3)
    data = [("a", rng.choice((rng.random(), 1e3 * rng.random(), -5.0))) for _ in range(300)] + [("b", 2.0)] * 7 + [("b", 3.0)] * 7 + [("c", None), (None, 4.0), ("d", -1e308), ("d", 1e308), ("d", 7.0)]
    got = {r.k: r.median for r in C.median_by(spark.createDataFrame(data, "k string, v double"), "k", "v", n_cells).collect()}
    own = lambda k: [v for x, v in data if x == k and v is not None]
    assert got == {k: statistics.median(own(k)) if own(k) else None for k in ("a", "b", "c", "d", None)}


def test_exact_medians_of_a_query_are_not_collected(spark):
    from millrace import plans

    plan = plans.QUERIES["approximate_aggregates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert " percentile(" not in plan and "Expand" not in plan
