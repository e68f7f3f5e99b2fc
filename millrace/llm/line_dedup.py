"""Line dedup against a sharded minimal perfect hash of all long lines.

Distinct line hashes are counted (documents and largest document of each) and dealt to shards. A shard is a minimal perfect
hash with a fingerprint, a count and an owner array. Documents are dealt to cells; a cell asks each shard once for each of
its distinct lines, gets the frequent ones back and drops its lines. Lines themselves are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cells, durable

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = np.iinfo(np.int64).min
#: Lines of a shard; documents and bytes of a cell, on average.
SHARD_LINES, CELL_DOCS, CELL_BYTES = 20_000, 500, 2_000_000
#: A level of the perfect hash has so many slots for each key that is left.
GAMMA, MAX_LEVELS = 2.0, 40


def long_keys(lines: list[str], min_chars: int) -> list[tuple[int, bytes]]:
    """Places and keys of the lines whose keys have at least ``min_chars``; a key is UTF-8, whose ``lower`` changes A-Z only."""
    found = [(i, x.strip(BLANK)) for i, x in enumerate(lines) if len(x) >= min_chars]
    return [(i, k.encode().lower()) for i, k in found if len(k) >= min_chars]


def line_hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as an n x 2 array of signed words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").astype(np.int64).reshape(-1, 2)


def _mix(high: np.ndarray, low: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = high.view(np.uint64) ^ (low.view(np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays: a key sits on the first level where nothing else shares its slot."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.concatenate(([0], np.cumsum(bits)[:-1])) if len(bits) else np.zeros(0, np.int64))
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        for seed in range(MAX_LEVELS):
            if not len(high):
                return cls(levels)
            n = int(GAMMA * len(high)) + 1
            slot = (_mix(high, low, seed) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(slot, minlength=n) == 1
            levels.append(alone)
            left = ~alone[slot]
            high, low = high[left], low[left]
        raise ValueError("keys are not distinct")

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The key's place in 0..size-1; -1 for some keys that were never put in, any place for others."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for seed, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            slot = (_mix(high[left], low[left], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[slot]
            out[left[hit]] = ranks[slot[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return b"".join(np.packbits(b).tobytes() for b in self.levels), np.array([len(b) for b in self.levels], "<i8").tobytes()

    @classmethod
    def load(cls, bits: bytes, sizes: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in np.frombuffer(sizes, "<i8").tolist():
            width = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(bits[at : at + width], np.uint8), count=n).astype(bool))
            at += width
        return cls(levels)


def line_counts(docs: DataFrame, min_chars: int, n_shards: int) -> DataFrame:
    """``(shard, high, low, n_docs, owner)`` of every distinct key of at least ``min_chars``; counted in tasks first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, keys = [], []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                own = {k for _, k in long_keys(text.split("\n"), min_chars)}
                keys.extend(own)
                ids.extend([doc] * len(own))
            h = line_hashes(keys)
            yield pd.DataFrame({"high": h[:, 0], "low": h[:, 1], "doc_id": np.array(ids, np.int64)})

    return (
        docs.mapInPandas(run, "high long, low long, doc_id long")
        .groupBy("high", "low")
        .agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
        .withColumn("shard", F.pmod(F.col("high"), F.lit(n_shards)))
    )


def build_shards(counts: DataFrame) -> DataFrame:
    """``(shard, bits, sizes, prints, counts, owners)``: a perfect hash and its arrays for each shard."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        high, low = part["high"].to_numpy(), part["low"].to_numpy()
        mph = PerfectHash.build(high, low)
        at = mph.index(high, low)
        prints, n_docs, owners = np.zeros(len(part), "<u2"), np.zeros(len(part), "<u4"), np.zeros(len(part), "<i8")
        prints[at] = (low.view(np.uint64) >> np.uint64(48)).astype("<u2")
        n_docs[at] = np.minimum(part["n_docs"].to_numpy(), 2**32 - 1)
        owners[at] = part["owner"].to_numpy()
        bits, sizes = mph.dump()
        return pd.DataFrame([(int(part["shard"].iloc[0]), bits, sizes, prints.tobytes(), n_docs.tobytes(), owners.tobytes())], columns=["shard", "bits", "sizes", "prints", "counts", "owners"])

    return counts.groupBy("shard").applyInPandas(run, "shard long, bits binary, sizes binary, prints binary, counts binary, owners binary")


def row_keys() -> list[Column]:
    """128 bits of a row's id and text."""
    return [F.xxhash64(F.lit("row"), "doc_id", "text").alias("row_key"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("row_key2")]


def drop_frequent_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, row_key, row_key2, n_lines, n_dropped, kept_text``; the keys are hashes of id and text.

    Lines end at ``\\n`` only; a null or empty text is one empty line. A line's key has ASCII white space stripped at both ends
    and A-Z in lower case. Keys of at least ``min_chars`` code points that ``min_docs`` or more documents hold lose all their
    lines, repeats inside a document too, except in the holder with the largest id. Rows with the same id count as separate
    documents, and each of them keeps the lines that its id owns; null ids never own a line that another id has. The text of a
    document whose lines all go is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"), *row_keys())
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    total, n_lines, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(breaks + 1), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_cells = max(cells(spark, total, CELL_DOCS), cells(spark, n_bytes, CELL_BYTES))
    n_shards = cells(spark, n_lines, SHARD_LINES)
    # written before they are probed: else a task that builds and probes a shard keeps two Python workers
    shards = durable(build_shards(line_counts(rows, min_chars, n_shards)))
    celled = rows.withColumn("cell", F.pmod("row_key", F.lit(n_cells)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, part in b.groupby("cell"):
                keys = list({k for t in part["text"] for _, k in long_keys(t.split("\n"), min_chars)})
                h = line_hashes(keys)
                out = pd.DataFrame({"cell": cell, "shard": h[:, 0] % n_shards, "high": h[:, 0], "low": h[:, 1]})
                yield out

    questions = celled.mapInPandas(ask, "cell long, shard long, high long, low long").distinct()

    def probe(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"cell": [], "high": [], "low": [], "owner": []}, dtype=np.int64)
        if not len(asked) or not len(shard):
            return none
        s = shard.iloc[0]
        mph, prints, n_docs, owners = PerfectHash.load(s["bits"], s["sizes"]), np.frombuffer(s["prints"], "<u2"), np.frombuffer(s["counts"], "<u4"), np.frombuffer(s["owners"], "<i8")
        high, low = asked["high"].to_numpy(), asked["low"].to_numpy()
        at = mph.index(high, low)
        hit = (at >= 0) & (prints[at] == (low.view(np.uint64) >> np.uint64(48)).astype(np.uint16)) & (n_docs[at] >= min_docs)
        return pd.DataFrame({"cell": asked["cell"][hit], "high": high[hit], "low": low[hit], "owner": owners[at[hit]]})

    hits = questions.groupBy("shard").cogroup(shards.groupBy("shard")).applyInPandas(probe, "cell long, high long, low long, owner long")

    def drop(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        owner_of = dict(zip(zip(found["high"].tolist(), found["low"].tolist(), strict=True), found["owner"].tolist(), strict=True))
        out = []
        for doc, no_id, key, key2, text in zip(part["doc_id"], part["no_id"], part["row_key"], part["row_key2"], part["text"], strict=True):
            lines = text.split("\n")
            kept = lines
            if owner_of:
                long = long_keys(lines, min_chars)
                owners = [owner_of.get(h, doc) for h in map(tuple, line_hashes([k for _, k in long]).tolist())]
                gone = {i for (i, _), owner in zip(long, owners, strict=True) if owner != doc}
                kept = [x for i, x in enumerate(lines) if i not in gone]
            out.append((doc, no_id, key, key2, len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["doc_id", "no_id", "row_key", "row_key2", "n_lines", "n_dropped", "kept_text"])

    dropped = celled.groupBy("cell").cogroup(hits.groupBy("cell")).applyInPandas(drop, "doc_id long, no_id boolean, row_key long, row_key2 long, n_lines long, n_dropped long, kept_text string")
    return dropped.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def without_frequent_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the texts that are left, all rows and columns kept, whatever their names; ``n_chars``, where it exists, follows the text."""
    new = drop_frequent_lines(docs, **options).groupBy("row_key", "row_key2").agg(F.min("kept_text").alias("kept"))
    rest = docs.select(*row_keys(), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    joined = rest.join(new, ["row_key", "row_key2"])
    column = {c: F.col("rest").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        column["n_chars"] = F.length("kept").cast(dict(docs.dtypes)["n_chars"])
    return joined.select(*[column[c].alias(c) for c in docs.columns])
