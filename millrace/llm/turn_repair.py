"""Repair of conversations by the cheapest edits, solved once for every suffix that conversations share.

A row is a symbol: its role and fault. A conversation is a word of such symbols, and words that end alike share the nodes of a
suffix-shared automaton (DAWG): a node is a distinct suffix, its one edge reads the next symbol. A node holds, for each state of the
role grammar, the cost to go, the best audit suffix and the state it ends in; it is computed once, in order of the reversed words, for
all conversations. Long words are cut every ``CHUNK`` symbols from their ends, so nodes stay small: the costs at a cut come from
4 x 4 matrices of costs between states, one for each distinct piece.

Rows of a conversation stream through tasks in order, twice; nothing holds a conversation. That one task reads a whole conversation is
due to the result: one SHA-256 over its repaired text.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Symbols between two cuts of a word.
CHUNK = 256
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
#: States of the grammar ``(s?(ua)+)?``: at the start, after s, after u, after a. What a row may be kept as, and the role an edit gives.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Costs to go, audits and last states at the end of a conversation: what is missing is inserted.
END_COSTS, END_AUDITS = (0, 4, 2, 0), ("", "II", "I", "")
FAR = 10**9

Node = tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]


def symbol_node(symbol: str, after: Node) -> Node:
    """The node that reads ``symbol`` and goes on with ``after``: costs, audits and last states by grammar state.

    ``x`` is a row that must go; other symbols are role initials (``o``: none of the grammar's), in upper case if truncated. Of equal
    costs the audit that comes first in ASCII wins: at each step a smaller letter, since D, I, K and R lead to different places.
    """
    costs, audits, ends = after
    extra = int(symbol.isupper())
    best: list[tuple[int, str, int]] = []
    for q in range(4):
        options = [(3 + costs[q], "D", q)]
        if symbol != "x":
            if symbol.lower() in KEEP[q]:
                options.append((extra + costs[KEEP[q][symbol.lower()]], "K", KEEP[q][symbol.lower()]))
            options.append((2 + extra + costs[NEXT[q]], "R", NEXT[q]))
        best.append(min(options))
    found = [b[0] for b in best]
    for _ in range(3):  # one insertion leads to a state that may want another
        found = [min(c, 2 + found[NEXT[q]]) for q, c in enumerate(found)]
    out: list[tuple[str, int] | None] = [None] * 4

    def walk(q: int) -> tuple[str, int]:
        if out[q] is None:
            cost, letter, to = best[q]
            insert = found[q] == 2 + found[NEXT[q]] and (cost > found[q] or letter > "I")
            rest = walk(NEXT[q]) if insert else (audits[to], ends[to])
            out[q] = (("I" if insert else letter) + rest[0], rest[1])
        return out[q]

    walked = [walk(q) for q in range(4)]
    return tuple(found), tuple(a for a, _ in walked), tuple(e for _, e in walked)


def end_node(costs: tuple[int, ...], final: bool) -> Node:
    return costs, END_AUDITS if final else ("",) * 4, (START, SYSTEM, USER, ASSISTANT)


class Suffixes:
    """The automaton's nodes along one word; words that come in the order of their reversals compute each node once."""

    def __init__(self, end: Node) -> None:
        self.word, self.nodes = "", [end]

    def node(self, reversed_word: str) -> Node:
        same = next((i for i, (a, b) in enumerate(zip(self.word, reversed_word, strict=False)) if a != b), min(len(self.word), len(reversed_word)))
        del self.nodes[same + 1 :]
        for symbol in reversed_word[same:]:
            self.nodes.append(symbol_node(symbol, self.nodes[-1]))
        self.word = reversed_word
        return self.nodes[-1]


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, live, copies)`` after the test damage: by a hash of conversation and turn a row in 20 each is dropped
    (``live`` is false), emptied, loses its ends of sentences, is repeated, or gets the role user. Null roles and texts are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), (kind != 0).alias("live"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def _place() -> list[Column]:
    """Where a row stands in its conversation: by turn, nulls first, then by role and a hash of the text."""
    return [F.xxhash64(F.lit("text"), "text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]


def symbols(rows: DataFrame) -> DataFrame:
    """Rows without their texts: ``(conv_id, turn, role, h1, h2, live, initial, fault, symbol, nth)``."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    flat = rows.select("conv_id", "turn", "role", *_place(), "live", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"), initial.alias("initial"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    seen = Window.partitionBy("conv_id", "live", "role", "h1", "h2").orderBy(F.asc_nulls_first("turn"))
    # hashed by conversation once, which the window and the sort below both can use
    flat = flat.drop("copy").repartition("conv_id").withColumn("nth", F.row_number().over(seen))
    fault = F.when(F.col("blank"), "b").when(F.col("nth") > 1, "d").when(F.col("open"), "t").otherwise("")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(fault.isin("b", "d"), "x").when(fault == "t", F.upper(known)).otherwise(known)
    return flat.withColumn("fault", fault).withColumn("symbol", symbol).drop("blank", "open")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _streamed(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _table(held, schema)
            held = []
    yield _table(held, schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
PIECE = pa.schema([(n, pa.int64()) for n in ("conv_id", "piece")] + [("word", pa.string()), ("first", pa.bool_()), ("turn", pa.int64()), ("role", pa.string())] + [(n, pa.int64()) for n in ("h1", "h2", *COUNTS)])
PIECE_SQL = "conv_id long, piece long, word string, first boolean, turn long, role string, h1 long, h2 long, gaps long, blank long, duplicate long, truncated long, illegal long"


class Tally:
    """Counts of a conversation whose rows come from the last to the first."""

    def __init__(self) -> None:
        self.low = self.high = self.turn = None
        self.turns, self.faults, self.illegal, self.later = 0, {"b": 0, "d": 0, "t": 0, "": 0}, 0, None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.high = turn if self.high is None else self.high
            self.turns += turn != self.turn
            self.low = self.turn = turn
        self.faults[fault] += 1
        self.illegal += self.later is not None and initial + self.later not in LEGAL
        self.later = initial

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal


def pieces(rows: DataFrame) -> DataFrame:
    """Words cut from their ends, ``piece`` 0 being the last; the first one of a conversation (``first``) has its counts."""

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        word: list[str] = []
        at, piece, tally = (None, None, None, None), 0, Tally()

        def done() -> tuple:
            return held[0], piece, "".join(reversed(word)), True, *at, *tally.counts()

        for conv_id, turn, role, h1, h2, live, initial, fault, symbol in rows:
            if held is None or held[0] != conv_id:
                if held is not None:
                    yield done()
                held, word, at, piece, tally = (conv_id,), [], (None, None, None, None), 0, Tally()
            if not live:
                continue
            if len(word) == CHUNK_SIZE:
                yield conv_id, piece, "".join(reversed(word)), False, *at, 0, 0, 0, 0, 0
                word, piece = [], piece + 1
            word.append(symbol)
            at = (turn, role, h1, h2)
            tally.add(turn, initial, fault)
        if held is not None:
            yield done()

    CHUNK_SIZE = CHUNK  # as it is when the job is made, also in workers
    order = ["conv_id", F.desc_nulls_last("turn"), *[F.desc(c) for c in ("role", "h1", "h2", "nth")]]
    own = symbols(rows).sortWithinPartitions(*order).select("conv_id", "turn", "role", "h1", "h2", "live", "initial", "fault", "symbol")
    return own.mapInArrow(lambda b: _streamed(cut(_batches(b)), PIECE), PIECE_SQL)


def _by_reversal(words: DataFrame, *keys: str) -> DataFrame:
    """Distinct words in the order of their reversals, cut into ranges; two ranges share the nodes of one path at most."""
    distinct = words.select(*keys, F.reverse("word").alias("reversed")).distinct()
    return distinct.repartitionByRange(*keys, "reversed").sortWithinPartitions(*keys, "reversed")


def with_costs(cut: DataFrame) -> DataFrame:
    """Adds ``final``, ``costs`` (to go from the end of the piece, by state, less their minimum) and ``paid`` (the sum of such minima)."""
    ends = F.array(*[F.lit(c) for c in END_COSTS])
    if not cut.where("piece > 0").limit(1).count():
        return cut.withColumns({"final": F.lit(True), "costs": ends, "paid": F.lit(0).cast("long")})

    def matrices(rows: Iterator[tuple]) -> Iterator[tuple]:
        exits = [Suffixes(end_node(tuple(0 if q == e else FAR for q in range(4)), False)) for e in range(4)]
        for (word,) in rows:
            yield word[::-1], [c for x in exits for c in x.node(word)[0]]

    def carried(rows: Iterator[tuple]) -> Iterator[tuple]:
        costs, paid = END_COSTS, 0
        for conv_id, piece, matrix in rows:
            if piece == 0:
                costs, paid = END_COSTS, 0
            yield conv_id, piece, piece == 0, list(costs), paid
            if matrix:
                full = [min(costs[e] + matrix[4 * e + q] for e in range(4)) for q in range(4)]
                paid, costs = paid + min(full), tuple(c - min(full) for c in full)

    kinds = pa.schema([("word", pa.string()), ("matrix", pa.list_(pa.int64()))])
    known = _by_reversal(cut.where("NOT first")).mapInArrow(lambda b: _streamed(matrices(_batches(b)), kinds, 200), "word string, matrix array<long>")
    links = cut.select("conv_id", "piece", F.when(~F.col("first"), F.col("word")).alias("word")).join(known, "word", "left")
    kinds2 = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("final", pa.bool_()), ("costs", pa.list_(pa.int32())), ("paid", pa.int64())])
    ordered = links.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "piece", "matrix")
    solved = ordered.mapInArrow(lambda b: _streamed(carried(_batches(b)), kinds2), "id long, at long, final boolean, costs array<int>, paid long")
    return cut.join(solved, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("piece") == F.col("at"))).drop("id", "at")


def audited(cut: DataFrame) -> DataFrame:
    """Pieces with ``audits`` and ``ends``, an audit and a last state for each state at the piece's beginning, and ``cost`` of a first piece."""

    def solve(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, suffixes = None, None
        for final, costs, word in rows:
            if key != (final, costs):
                key, suffixes = (final, costs), Suffixes(end_node(tuple(costs), final))
            found, audits, ends = suffixes.node(word)
            yield final, costs, word[::-1], found[START], list(audits), list(ends)

    kinds = pa.schema([("final", pa.bool_()), ("costs", pa.list_(pa.int32())), ("word", pa.string()), ("to_go", pa.int64()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])
    words = _by_reversal(cut, "final", "costs").mapInArrow(lambda b: _streamed(solve(_batches(b)), kinds, 500), "final boolean, costs array<int>, word string, to_go long, audits array<string>, ends array<int>")
    return cut.join(words, ["final", "costs", "word"]).withColumn("cost", F.col("to_go") + F.col("paid"))


class Repair:
    """Edits of one conversation while its pieces and rows come in order."""

    def __init__(self) -> None:
        self.waiting: deque[tuple[list[str], list[int]]] = deque()
        self.state, self.grammar = START, START
        self.audit, self.at, self.log = "", 0, []

    def piece(self, audits: list[str], ends: list[int]) -> None:
        self.waiting.append((audits, ends))
        self._next()

    def _next(self) -> None:
        while self.at == len(self.audit) and self.waiting:
            audits, ends = self.waiting.popleft()
            self.audit, self.at, self.state = audits[self.state], 0, ends[self.state]
            self.log.append(self.audit)

    def _role(self, to: int) -> str:
        self.grammar = to
        return ROLE[to]

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        """Insertions that are next, across the ends of pieces."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._role(NEXT[self.grammar]), ""
            self._next()

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.grammar = KEEP[self.grammar][role[0]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._role(NEXT[self.grammar]), text
        self._next()


def _edited(rows: DataFrame) -> DataFrame:
    """Pieces and rows of each conversation in order, a piece before its rows."""
    cut = audited(with_costs(durable(pieces(rows))))
    parts = cut.select("conv_id", "turn", "role", "h1", "h2", F.lit(0).alias("kind"), "piece", F.lit("").alias("text"), F.when(F.col("first"), F.array("cost", *COUNTS)).alias("counts"), "audits", "ends")
    none = [F.lit(None).cast(dict(parts.dtypes)[c]).alias(c) for c in ("counts", "audits", "ends")]
    texts = rows.where("live").select("conv_id", "turn", "role", *_place(), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("kind"), F.lit(0).cast("long").alias("piece"), "text", *none)
    # pieces that begin with equal rows stand in their own order
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "h1", "h2", "kind", F.desc("piece")]
    return parts.unionAll(texts).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "counts", "audits", "ends")


def _conversations(rows: Iterator[tuple], out) -> Iterator[tuple]:
    """``out(conv_id)`` takes edits by ``add`` and gives rows by ``take`` and, with the conversation's counts and audit, by ``close``."""
    held, repair, sink, counts = None, Repair(), None, None
    for conv_id, kind, role, text, numbers, audits, ends in rows:
        if held is None or held[0] != conv_id:
            if held is not None:
                sink.add(repair.inserts())
                yield from sink.close(counts, "".join(repair.log))
            held, repair, sink, counts = (conv_id,), Repair(), out(conv_id), None
        if kind == 0:
            repair.piece(audits, ends)
            counts = numbers or counts
        else:
            sink.add(repair.row(role, text))
            yield from sink.take()
    if held is not None:
        sink.add(repair.inserts())
        yield from sink.close(counts, "".join(repair.log))


class Digest:
    """One row for a conversation: counts, audit and hash."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.hash, self.empty = conv_id, hashlib.sha256(), True

    def add(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in edits:
            self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
            self.empty = False

    def take(self) -> list[tuple]:
        return []

    def close(self, counts: list[int], audit: str) -> list[tuple]:
        return [(self.conv_id, *counts[1:], counts[0], audit, self.hash.hexdigest())]


class Rows:
    """The repaired rows, numbered from 0."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n, self.held = conv_id, 0, []

    def add(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for edit, role, text in edits:
            self.held.append((self.conv_id, self.n, edit, role, text))
            self.n += 1

    def take(self) -> list[tuple]:
        held, self.held = self.held, []
        return held

    def close(self, counts: list[int], audit: str) -> list[tuple]:
        return self.take()


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` is a result of ``damaged``, or of ``as_rows`` for rows as they are. Rows stand by turn, nulls first; rows of one turn by
    role, then by a hash of the text, so equal rows stand together. A row's first fault counts: blank, duplicate (role and text seen
    earlier), truncated (its last character that isn't white space is none of ``.!?``). Keeping costs 0, another role 2, deletion 3
    (blank and duplicate rows must go), inserting an empty turn 2, and an undeleted truncated row 1 more; the role initials that are left
    match ``(s?(ua)+)?``. Of the cheapest audits (letters K, R, D, I in order) the ASCII-least is taken. ``gaps`` counts turns missing
    between the least and the greatest, without nulls, 2^63 - 1 at most.

    A null ``conv_id`` is a conversation like any other. Null roles and texts are one space. A conversation without live rows has zeros, an
    empty audit and the hash of the empty string. Repeated rows are duplicates. Other columns are ignored. No rows give an empty result.
    """
    kinds = pa.schema([(n, pa.int64()) for n in ("conv_id", *COUNTS, "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _edited(rows).mapInArrow(lambda b: _streamed(_conversations(_batches(b), Digest), kinds, 500), schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the repaired conversations themselves; arguments as for ``repair_digests``."""
    kinds = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _edited(rows).mapInArrow(lambda b: _streamed(_conversations(_batches(b), Rows), kinds, 500), "conv_id long, place long, edit string, role string, text string")


def as_rows(rows: DataFrame) -> DataFrame:
    """Conversations as they are, for ``repair_digests`` and ``repaired_rows``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role"), name("text"), F.lit(True).alias("live"), F.lit(1).alias("copies"))
