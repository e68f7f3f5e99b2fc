"""Word shingles of whole texts in blocks, and their exact document frequencies.

Texts are hashed once. A task writes blocks of about a million distinct (text, shingle) pairs to a table bucketed by block, so that
later steps read a block where it lies, without a shuffle. For document frequencies each block sends every shard of the hash
range the sorted shingles it holds, once each; a shard adds up what all blocks hold and answers every block in the order of its
question. Both sides are packed: four bytes a shingle there, less than one back. Nothing has a fixed size but the block.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import shared_folder, small_batches

_WORD = re.compile(r"\w+")
_A = np.uint64(0x9E3779B97F4A7C15)
#: Shingle hashes have 48 bits, so that a hash and its text's place in a batch sort as one number.
HASH_BITS = 48
#: Code points that are hashed at once, distinct shingles of a block, shingles of a shard and blocks of a bucket (about).
BATCH_CHARS, BLOCK_SHINGLES, SHARD_SHINGLES, BUCKET_BLOCKS = 3_000_000, 1 << 20, 2_000_000, 6
BLOCK = "block long, nodes binary, sizes binary, hashes binary, tf binary"


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of all texts, and how many each text has. A text of fewer words has one of what it has."""
    found = [_WORD.findall(t.lower()) for t in texts]
    known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*found)} if found else {}
    out, counts = [], []
    for own in found:
        if not own:
            counts.append(0)
            continue
        h = np.array([known[w] for w in own], np.uint64)
        n = max(1, len(h) - size + 1)
        x = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(min(size, len(h))):
                x = (x ^ (x >> np.uint64(29))) * _A + h[i : i + n]
        out.append(mix(x) >> np.uint64(64 - HASH_BITS))
        counts.append(n)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(counts, np.int64)


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order: hashes, term frequencies, how many each text has."""
    bits = np.uint64(HASH_BITS)
    key = (np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << bits) | hashes
    key.sort()
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    return key & np.uint64((1 << HASH_BITS) - 1), tf, np.bincount((key >> bits).astype(np.int64), minlength=len(counts))


def batches_of(pdf: pd.DataFrame, column: str = "text", size: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """Parts of about ``size`` code points and fewer than 2**15 rows."""
    start = total = 0
    for i, n in enumerate(pdf[column].str.len()):
        total += n
        if total >= size or i + 1 - start >= 1 << 15:
            yield pdf.iloc[start : i + 1]
            start, total = i + 1, 0
    if start < len(pdf):
        yield pdf.iloc[start:]


def pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def pack_counts(n: np.ndarray) -> bytes:
    """Counts from 1 up, most of them 1: how many, a bit for each that is larger, and those."""
    more = n > 1
    return np.array([len(n)], "<u4").tobytes() + np.packbits(more).tobytes() + n[more].astype("<u4").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    size = int(np.frombuffer(raw, "<u4", 1)[0])
    bits = np.frombuffer(raw, np.uint8, -(-size // 8), 4)
    n = np.ones(size, np.int64)
    n[np.unpackbits(bits, count=size).astype(bool)] = np.frombuffer(raw, "<u4", offset=4 + len(bits))
    return n


def pack_sorted(h: np.ndarray) -> bytes:
    """Distances of sorted hashes, the first from zero: a byte that tells their width, and the distances."""
    gaps = np.diff(h, prepend=np.uint64(0))
    if len(gaps) and gaps[1:].max(initial=0) < 1 << 32:
        return b"\4" + gaps[:1].astype("<u8").tobytes() + gaps[1:].astype("<u4").tobytes()
    return b"\x08" + gaps.astype("<u8").tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\x08":
        return np.cumsum(np.frombuffer(raw, "<u8", offset=1), dtype=np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(raw, "<u8", 1, 1), np.frombuffer(raw, "<u4", offset=9).astype(np.uint64))), dtype=np.uint64)


def shingle_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``BLOCK`` rows of ``(node, text)`` rows: nodes, how many distinct shingles each has, the shingles and their term frequencies."""

    def block(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        nodes, sizes, hashes, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        raw = (nodes.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), pack48(hashes), pack_counts(tf))
        name = np.array([xxhash.xxh64_intdigest(raw[0] + raw[1])], np.uint64).view(np.int64)[0]
        return pd.DataFrame([(name, *raw)], columns=["block", "nodes", "sizes", "hashes", "tf"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for part in batches_of(b):
                h, tf, counts = distinct(*shingle_hashes(part["text"].tolist(), size))
                held.append((part["node"].to_numpy(np.int64), counts, h, tf))
                n += len(h) + len(part)
                if n >= BLOCK_SHINGLES:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.select("node", "text").mapInPandas(run, BLOCK)


def written_blocks(spark: SparkSession, rows: DataFrame, size: int, n_chars: int) -> str:
    """Write the blocks to a bucketed table, whose files lie in the shared folder, and return its name; the caller drops both."""
    name = f"shingle_blocks_{uuid.uuid4().hex}"
    buckets = min(50_000, max(1, n_chars // (6 * BLOCK_SHINGLES * BUCKET_BLOCKS)))
    with small_batches(spark):
        shingle_blocks(rows, size).write.bucketBy(int(buckets), "block").format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return name


def document_frequencies(blocks: DataFrame, n_chars: int) -> DataFrame:
    """``(block, shard, df)``: for each block the packed document frequencies of its distinct shingles, shard by shard in hash order."""
    bits = min(24, max(0, int(n_chars // (6 * SHARD_SHINGLES)).bit_length()))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, raw in zip(pdf["block"], pdf["hashes"], strict=True):
            h, n = np.unique(unpack48(raw), return_counts=True)
            shard = (h >> np.uint64(HASH_BITS - bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(shard, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(h)], strict=False):
                rows.append((shard[a], name, pack_sorted(h[a:b]), pack_counts(n[a:b])))
        return pd.DataFrame(rows, columns=["shard", "block", "hashes", "n"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_sorted(x) for x in pdf["hashes"]]
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        df = np.bincount(at, np.concatenate([unpack_counts(x) for x in pdf["n"]])).astype(np.int64)[at]
        ends = np.cumsum([len(x) for x in asked])
        return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"], "df": [pack_counts(df[e - len(x) : e]) for e, x in zip(ends, asked, strict=True)]})

    asked = blocks.select("block", "hashes").groupBy("block").applyInPandas(ask, "shard long, block long, hashes binary, n binary")
    return asked.groupBy("shard").applyInPandas(answer, "block long, shard long, df binary")


def with_frequencies(blocks: DataFrame, answers: DataFrame, use: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """``use(block, nodes, sizes, hashes, term and document frequencies stacked, note)`` of every block that ``answers`` speaks of.

    ``answers`` has the rows of ``document_frequencies`` and, for some blocks, a row of shard -1, whose ``df`` is passed on as the note
    (else None). A block whose texts have no words is skipped.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        # Blocks of equal content share a name: each has asked, all got the same answer.
        by_shard = dict(zip(said["shard"], said["df"], strict=True))
        note = by_shard.pop(-1, None)
        if not len(own) or not len(said):
            return pd.DataFrame(columns=names)
        row = own.iloc[0]
        hashes, parts = unpack48(row["hashes"]), [unpack_counts(by_shard[s]) for s in sorted(by_shard)]
        _, at = np.unique(hashes, return_inverse=True)
        known = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        return use(int(row["block"]), np.frombuffer(row["nodes"], "<i8"), sizes, hashes, np.stack((unpack_counts(row["tf"]), known[at])), note)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)
