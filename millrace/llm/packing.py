"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are tokenised once and cut into pieces of at most ``max_tokens``. Only the histogram of piece lengths (at most
``max_tokens`` rows, whatever the corpus) reaches the driver, where lengths are placed longest first and packing patterns are
counted. Pieces then find their pattern by their rank among pieces of their length; ranks come from per-cell counts, so no
task sorts all pieces of a common length.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from array import array
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, durable, small_batches

PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, {ids}cell long"
#: Words whose ids a worker keeps; the store is emptied when full.
CACHE_WORDS = 800_000
#: Marks that no letter joins in the tokenizer's own splitting; apostrophes may begin a contraction and aren't among them.
MARKS = ".,;:!?%$#&*|()[]{}<>/+=-_\"~@^"


#: Byte-level vocabularies spell a byte as itself where it is a printable Latin-1 character, else as the next one from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids as little-endian bytes, word by word.

    For vocabularies that drop white space and never join words across it, the ids of a text are the ids of its parts between
    blanks and line breaks. Parts repeat, so a dictionary answers most of them.
    """

    def __init__(self, path: str) -> None:
        self.known = {"": b""}
        self.encode, self.tokenize = _tokenizer(path).encode, _tokenizer(path).model.tokenize

    def _part(self, part: str) -> bytes:
        """Ids of a part. A plain word skips the tokenizer's normalising and splitting, which would leave it as it is."""
        got = self.known.get(part)
        if got is None:
            if part.isalpha() and part.islower() and (part.isascii() or unicodedata.is_normalized("NFC", part)):
                spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = [t.id for t in self.tokenize(spelled)]
            else:
                ids = self.encode(part, add_special_tokens=False).ids
            got = self.known[part] = array("I", ids).tobytes()
        return got

    def _learn(self, words: set[str]) -> None:
        """Letters followed by marks are cut there first, as the tokenizer cuts them, so that fewer parts are new."""
        known, part = self.known, self._part
        for w in words:
            core = w.rstrip(MARKS)
            low = core.lower()
            # A sigma's lower case depends on its place; a dotted capital I's ends in a mark, which the tokenizer joins to the next one.
            if core.isalpha() and low.isalpha() and "\u03a3" not in core:
                ids = part(low)
                known[w] = ids if len(core) == len(w) else ids + part(w[len(core) :])
            else:
                part(w)

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {"": b""}
        self._learn(words.difference(self.known))
        known = self.known
        return [b"".join(map(known.__getitem__, s)) for s in split]


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int, n_cells: int, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids], cell)``: the pieces of each document's ids followed by ``end_id``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = WordIds(tokenizer)
        for b in batches:
            for at in range(0, len(b), 1000):
                part, rows = b.iloc[at : at + 1000], []
                for doc, cell, raw in zip(part["doc_id"], part["cell"], encode(part["text"].tolist()), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, max_tokens):
                        ids = raw[4 * start : 4 * (start + max_tokens)]
                        rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, *([ids] if with_ids else []), cell))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), "cell"])

    cell = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_cells)).alias("cell")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "text", cell)
    return long_ids(texts.mapInPandas(run, PIECE.format(ids="ids binary, " if with_ids else "")))


def long_ids(rows: DataFrame) -> DataFrame:
    """Ids pass through pandas as strings: numbers beside nulls lose digits there."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_patterns(histogram: dict[int, int], max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns ``(lengths, how many packs)``: lengths longest first, each into the shortest open pack.

    The shortest pack is the one with the most room; if even that can't take the length, a new one is opened. Packs that are
    filled alike are counted, not listed: all packs of the shortest kind take as many pieces each as leave them the shortest, and a
    kind splits where pieces run out. The loop runs over distinct lengths and kinds of packs, never over pieces.
    """
    gaps: list[int] = []  # ascending
    open_packs: dict[int, Counter] = defaultdict(Counter)  # gap -> pattern -> packs

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if not n:
            return
        if not open_packs[gap]:
            insort(gaps, gap)
        open_packs[gap][pattern] += n

    for length in sorted(histogram, reverse=True):
        left, per_pack = histogram[length], max_tokens // length
        while left:
            if not gaps or gaps[-1] < length:
                full, rest = divmod(left, per_pack)
                put(max_tokens - per_pack * length, (length,) * per_pack, full)
                put(max_tokens - rest * length, (length,) * rest, int(rest > 0))
                break
            gap = gaps.pop()
            kinds = open_packs.pop(gap)
            next_gap = gaps[-1] if gaps else 0
            times = min(gap // length, (gap - next_gap) // length + 1)
            n_packs = sum(kinds.values())
            if times * n_packs > left:  # pieces run out among these packs: a piece each, as far as they go
                times = max(1, left // n_packs)
            for pattern, n in kinds.items():
                fed = min(n, left // times)
                put(gap - times * length, pattern + (length,) * times, fed)
                put(gap, pattern, n - fed)
                left -= fed * times
    return [(pattern, n) for gap in gaps for pattern, n in open_packs[gap].items()]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Length to rows ``(first rank, pieces of this length in a pack, first sequence, first offset)``, by first rank."""
    taken: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    base = 0
    for pattern, n in patterns:
        offset = 0
        for length, times in sorted(Counter(pattern).items(), reverse=True):
            rows[length].append((taken[length], times, base, offset))
            taken[length] += n * times
            offset += length * times
        base += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``max_tokens``: one row per piece.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``, little-endian unsigned 32-bit,
    on request). A null or empty text has only the end id. Cuts are made every ``max_tokens``; every id lies in one piece, and
    offsets in a sequence have no gaps. Repeated rows are separate documents with the same id. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n_cells = cells(spark, docs.count(), 5_000)
    with small_batches(spark):
        pieces = durable(token_pieces(docs, tokenizer, max_tokens, end_id, n_cells, with_ids))
    counts = pieces.groupBy("length", "cell").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    places = spark.sparkContext.broadcast(_places(pack_patterns(histogram, max_tokens)))

    # Cells of one length are few (rows / 5000), so their running sum is a small window; ranks inside a cell are smaller still.
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(first, ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("first"))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            lengths, ranks = b["length"].to_numpy(), b["rank"].to_numpy()
            for length in np.unique(lengths):
                m, rows = lengths == length, places.value[int(length)]
                at = np.searchsorted(rows[:, 0], ranks[m], "right") - 1
                past, times = ranks[m] - rows[at, 0], rows[at, 1]
                sequence[m] = rows[at, 2] + past // times
                offset[m] = rows[at, 3] + past % times * length
            yield b[names].assign(sequence_id=sequence, offset=offset)

    schema = PIECE.format(ids="ids binary, " if with_ids else "").replace("cell long", "sequence_id long, offset long")
    return long_ids(ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, schema))
