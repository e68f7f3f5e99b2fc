"""Conversation repair against a forward search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest
from millrace.llm import turn_repair as R
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BLANK = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, piece string, word string, kind string, costs string"


def cheapest(rows):
    """``rows``: (role, text, fault). Dijkstra over (position, grammar state) with (cost, audit) as distance."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, q, out = heapq.heappop(todo)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        for name in ("user", "assistant"):
            if name[0] in steps[q]:
                heapq.heappush(todo, (cost + 2, audit + "I", i, name[0], (*out, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] and role[:1] in steps[q]:
                    heapq.heappush(todo, (cost + extra, audit + "K", i + 1, role[0], (*out, (role, text))))
                for name in ("user", "assistant"):
                    if name[0] in steps[q]:
                        heapq.heappush(todo, (cost + 2 + extra, audit + "R", i + 1, name[0], (*out, (name, text))))


def brute(rows, damage=True):
    kept = {}
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20 if damage else 9
        role, text = "user" if kind == 4 else say(role), "" if kind == 1 else say(text)
        text = "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged = set(), []
        for _, role, text in own:
            bare = text.strip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        n = lambda f, judged=judged: sum(x[2] == f for x in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, text = cheapest(judged)
        gaps = min(max(turns) - min(turns) + 1 - len(turns), 2**63 - 1) if turns else 0
        out.append((conv, gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_op11_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_turn_repair"](spark, SF)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


ODD = [
    (None, 1, "user", "Hello."), (None, None, "assistant", "Yes"), (1, None, None, None), (1, None, "user", "A."), (1, None, "user", "A."), (2, 2**62, "assistant", "x."),
    (2, -5, "system", "s."), (2, 0, "", "no role."), (2, 1, "Übung", "other."), (3, 7, "user", " \t\n"), (4, 1, "tool", "é" * 5000 + "!  "), (4, 2, "user", "a "), (-(2**63), 3, "a", "k."), (5, -(2**63), "user", "low."), (5, 2**63 - 1, "assistant", "high."),
]


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_repair_of_odd_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = list(ODD)
    for conv in range(10, 60):
        texts = {}  # rows of one turn and role have one text: others stand by a hash that brute() doesn't know
        for turn in range(rng.randrange(1, 14)):
            place = (turn + rng.choice([0, 0, 0, 5]), rng.choice("user assistant user assistant system tool".split()))
            rows.append((conv, *place, texts.setdefault(place, rng.choice(["One.", "Two?", "three", "four.", "", f"{turn}."]))))
    table = spark.createDataFrame([(*r, "a", "p", "w", "k", "c") for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, R.repair_digests(R.as_rows(table)).collect()), key=str) == brute(rows, damage=False)
    assert sorted(map(tuple, R.repair_digests(R.damaged(table)).collect()), key=str) == brute(rows)
    own = [r for r in R.repaired_rows(R.as_rows(table)).collect() if r.conv_id == 12]
    text = "\n".join(f"{r.role}:{r.text}" for r in sorted(own, key=lambda r: r.place))
    assert hashlib.sha256(text.encode()).hexdigest() == next(x[-1] for x in brute(rows, damage=False) if x[0] == 12)
    assert R.repair_digests(R.as_rows(table.limit(0))).collect() == []


def test_a_node_is_computed_once(monkeypatch):
    calls = []
    real = R.symbol_node
    monkeypatch.setattr(R, "symbol_node", lambda s, n: calls.append(s) or real(s, n))
    words = ["ua" * 10, "x" + "ua" * 10, "U" + "ua" * 9, "ua" * 10]
    dawg = R.Suffixes(R.end_node(R.END_COSTS, True))
    for w in sorted(x[::-1] for x in words):
        dawg.node(w)
    assert len(calls) == len({w[i:] for w in words for i in range(len(w))})


def test_pieces_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 2)
    rows = [(1, 1, "user", "A.")] * 25 + [(1, 2, "assistant", "B.")] * 13 + [(2, None, "user", " ")] * 9
    table = spark.createDataFrame([(*r, "", "", "", "", "") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, R.repair_digests(R.as_rows(table)).collect()), key=str) == brute(rows, damage=False)


def test_one_conversation_with_most_rows(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Text {t}." if t % 7 else "cut") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(2, 200)]
    table = spark.createDataFrame([(*r, "", "", "", "", "") for r in rows], SCHEMA).repartition(8)
    got = {r.conv_id: r for r in R.repair_digests(R.as_rows(table)).collect()}
    assert len(got) == 199 and got[2].audit == "KI" and got[1].duplicate == 427 and len(got[1].audit) >= 3000
    assert tuple(got[1]) == brute([r for r in rows if r[0] == 1], damage=False)[0]
