"""Ranked lexical search by scanning texts with an Aho-Corasick automaton of all query terms.

No index of the documents is built. The terms of all items, each between two guards, form one automaton, which is broadcast; a task
runs it over every whole text and counts term frequencies from its matches. The automaton's outputs are term numbers, which a flat
list maps to items. Two scans are made: the first counts document frequencies and lengths, the second scores, and a task keeps only
its best rows of each item.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of item texts whose automaton is broadcast at once; more items are searched part by part. Item scores of a block of documents.
PART_BYTES, BLOCK = 8_000_000, 1_000_000
#: ASCII letters and digits, the former in lower case, and all bytes of other characters; everything else is a guard.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE = 10**9

_automata: dict[str, ahocorasick.Automaton] = {}


def guarded(text: bytes) -> bytes:
    """UTF-8 with terms in lower case, a guard at both ends and between terms."""
    return b" " + text.translate(BYTES) + b" "


def n_terms(text: bytes) -> int:
    """Terms of a guarded text: the places where a guard is followed by something else."""
    guard = np.frombuffer(text, np.uint8) == 32
    return int(np.count_nonzero(guard[:-1] & ~guard[1:]))


class Part:
    """Terms of some items, and the items of each term as a slice of one list."""

    def __init__(self, texts: list[bytes], ids: list[int | None]) -> None:
        owners: dict[bytes, list[int]] = {}
        for item, text in enumerate(texts):
            for term in dict.fromkeys(guarded(text).split()):
                owners.setdefault(term, []).append(item)
        self.key, self.ids, self.terms = uuid.uuid4().hex, ids, list(owners)
        self.ends = np.cumsum([0, *map(len, owners.values())])
        self.items = np.array([i for own in owners.values() for i in own], np.int64)
        self.longest = int(np.bincount(self.items).max()) if len(self.items) else 0

    def automaton(self) -> ahocorasick.Automaton:
        """Built once in each worker process, which keeps the last one; letters are bytes."""
        if self.key not in _automata:
            built = ahocorasick.Automaton()
            for k, term in enumerate(self.terms):
                built.add_word(f" {term.decode('latin-1')} ", k)
            built.make_automaton()
            _automata.clear()
            _automata[self.key] = built
        return _automata[self.key]


def counted(part: Part, texts: Iterator[bytes | None]) -> Iterator[tuple[int, Counter]]:
    """Number of terms, and how often each term of the items occurs, text by text."""
    automaton, second = part.automaton(), itemgetter(1)
    for raw in texts:
        text = guarded(raw or b"")
        yield n_terms(text), Counter(map(second, automaton.iter(text.decode("latin-1"))))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column("text"))


def corpus_counts(docs: DataFrame, part: Part) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the document frequency of each term of the part."""
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(shared.value.terms), np.int64), 0, 0
        for b in batches:
            for terms, found in counted(shared.value, _texts(b)):
                n, total = n + (terms > 0), total + terms
                df[list(found)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, total, *df[at].tolist()], pa.int64())], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(part.terms), np.int64)
    got = {r.term: r.n for r in sums.collect()}  # a row for each term of the part, which is bounded
    n, total = got.pop(-2, 0), got.pop(-1, 0)
    df[list(got)] = list(got.values())
    return n, total, df


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The ``top`` rows of each item so far, in order of score, then of document id, nulls last."""

    def __init__(self, n_items: int, top: int) -> None:
        self.top, self.floor = top, np.ones(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 4  # item, score, whether the id is null, id

    def add(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: documents x items. Rows below an item's worst kept one can't enter."""
        doc, item = np.nonzero(scores >= self.floor)
        item, score, null, ids = (np.concatenate(x) for x in zip(self.rows, (item, scores[doc, item], null[doc], ids[doc]), strict=True))
        order = np.lexsort((ids, null, -score, item))
        item, score, null, ids = item[order], score[order], null[order], ids[order]
        new = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(new, np.diff(new, append=len(item)))
        self.rows = [x[place < self.top] for x in (item, score, null, ids)]
        last = place == self.top - 1
        self.floor[item[last]] = score[last]


def best_of_task(docs: DataFrame, part: Part, weights: np.ndarray, n: int, total: int, top: int) -> DataFrame:
    """``(item, salt, score, doc_id)``: each task's best documents of each item."""
    shared = docs.sparkSession.sparkContext.broadcast((part, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, weights = shared.value
        n_items, ends = len(part.ids), part.ends
        best = Best(n_items, top)
        exact = part.longest * int(weights.max(initial=0)) * 10**6 < 2**53  # then sums of doubles are exact
        terms: list[int] = []
        tfs: list[int] = []
        sizes: list[int] = []
        norms: list[int] = []
        ids: list[int | None] = []

        def flush() -> None:
            t, tf = np.array(terms, np.int64), np.array(tfs, np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            gain = weights[t] * ((SCALE * tf) // (1000 * tf + 8 * np.array(norms, np.int64)[doc]))
            width = ends[t + 1] - ends[t]
            begins = np.cumsum(width) - width
            at = np.repeat(ends[t] - begins, width) + np.arange(width.sum())
            cell = np.repeat(doc * n_items, width) + part.items[at]
            scores = np.zeros(len(sizes) * n_items, np.int64)
            if exact:
                scores += np.bincount(cell, np.repeat(gain, width), len(scores)).astype(np.int64)
            else:
                np.add.at(scores, cell, np.repeat(gain, width))
            null = np.array([i is None for i in ids], np.int64)
            best.add(scores.reshape(len(sizes), n_items), null, np.array([i or 0 for i in ids], np.int64))
            for held in (terms, tfs, sizes, norms, ids):
                held.clear()

        pairs = 0
        for b in batches:
            for doc_id, (length, found) in zip(b.column("doc_id"), counted(part, _texts(b)), strict=True):
                if not found:
                    continue
                terms.extend(found)
                tfs.extend(found.values())
                sizes.append(len(found))
                norms.append(10 + 90 * length * n // total)
                ids.append(doc_id.as_py())
                pairs += int((ends[1:] - ends[:-1])[list(found)].sum())
                if len(sizes) * n_items > BLOCK or pairs > BLOCK:
                    flush()
                    pairs = 0
        if sizes:
            flush()
        item, score, null, doc_ids = best.rows
        columns = [pa.array(item), pa.array(np.full(len(item), TaskContext.get().partitionId() % 64, np.int32)), pa.array(score), pa.array(doc_ids, mask=null.astype(bool))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "salt", "score", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "item long, salt int, score long, doc_id long")


def item_parts(items: DataFrame) -> list[Part]:
    """The items dealt by hash into parts of about ``PART_BYTES`` of text; an item is never cut, so one longer than that is a part of its own size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_parts = max(1, -(-2 * n_bytes // PART_BYTES)) if n_bytes > PART_BYTES else 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)))
    parts = []
    for k in range(n_parts):
        own = dealt.where(F.col("part") == k).orderBy("item_id", "text").collect()  # bounded by PART_BYTES
        parts.append(Part([bytes(r.text) for r in own], [r.item_id for r in own]))
    return [p for p in parts if p.terms]


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0.

    A term is a longest run of ASCII letters, digits and non-ASCII characters, with A-Z in lower case and nothing else changed. With
    ``N`` documents that have a term, ``L`` their terms with repeats, ``n`` a document's, ``df`` the documents that hold a term and
    ``tf`` its occurrences, a term weighs ``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and an item's terms, each counted once, add
    ``weight * (10^9 tf div (1000 tf + 8 m))`` with ``m = 10 + 90 n N div L``. Equal scores are ranked by ascending doc_id, nulls last.

    Null and empty texts have no terms: as documents they are never found, as items they find nothing. Rows with equal ids, equal or
    not in text, are documents or items of their own. Only ``doc_id``, ``item_id`` and ``text`` are read, so other columns may have any
    name. Empty tables give an empty result. What is broadcast is bounded by ``PART_BYTES`` of item texts: beyond it the documents are
    scanned once more for each further part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spark, out = docs.sparkSession, None
    for part in item_parts(items):
        n, total, df = corpus_counts(texts, part)
        rows = best_of_task(texts, part, term_weights(n, df), n, total, top)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for by in (["item", "salt"], ["item"]):  # many tasks' rows of one item meet in groups first
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(part.ids)), "item long, item_id long")
        found = rows.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
