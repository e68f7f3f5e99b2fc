"""Document quality by perplexity under interpolated modified Kneser-Ney trigram models of trusted text.

Every trusted text trains: texts are cut into two halves by hash, each half trains a model, and a document is judged by the model of
the other half, so that no perplexity is that of a memorised text. Distinct texts lie in blocks, as hashes of their words and the places
of these in the texts. Blocks send the shards the distinct trigrams they hold with their counts; a shard adds them up and sends what
counts for the lower order on. A model is a table of terms sharded by context, and bucketed by shard, so that it is never shuffled: all
n-grams that begin alike lie in one shard. Blocks of documents ask the shards for the terms of the n-grams they hold, once each, and
turn the answers into probabilities. Nothing of a model is broadcast or held whole. Thresholds come from quantiles over all distinct
texts of a language.
"""

from __future__ import annotations

import collections
import itertools
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settled, shared_folder, shuffle_width
from .shingles import batches_of, mix, pack48, pack_counts, pack_sorted, unpack48, unpack_counts, unpack_sorted

#: A sample for small models, which no query uses: one in so many trusted rows, and at most so many documents and words of them.
TRAIN_FOLDS, TRAIN_DOCS, TRAIN_WORDS = 5, 10_000, 250_000
#: No text gives more than one in so many of the training words.
LONGEST_SHARE = 50
#: The least distance between median and lower quartile, as a share of the median: near-copies can't close the fence.
LEAST_SPREAD = 0.01
#: Sentence ends; white space can't occur in a word, so these can't either.
START, END = " ^", " $"
#: Standard deviation of one word's negative log-probability, for the interval of a document's mean.
WORD_SD = 3.0
#: Shards of the counts at least, code points of the documents that make one more, and of those that ask together.
SHARDS, SHARD_CHARS, GROUP_CHARS = 8, 20_000_000, 6_000_000
#: Parts of the documents, which make two halves; parts of the shards and of a half's blocks that come one after the other, to save disk.
PARTS, COUNT_TURNS, SCORE_TURNS = 4, 4, 12
#: Kinds of keys: n-grams of 1, 2 and 3 words that end in a predicted one, and contexts of 1 and 2 words.
UNI, BI, TRI, ONE, TWO = 1, 2, 3, 4, 5
KEY_BITS = 48
#: Distinct texts, some of them trusted: their keys, how many words each has, the hashes of all words, and each word's place among these.
BLOCK = "block long, keys binary, trusted binary, sizes binary, hashes binary, ids binary"
#: What a shard holds of an order (part -1), or sends on to the shards of the next lower one, by their turn.
LEVEL = "shard long, part int, keys binary, c binary, contexts binary, sizes binary, n1 long, n2 long, n3 long, n4 long, total long, types long"
#: What a model holds of a shard and an order: the sorted keys of its n-grams and of their contexts, and a term for each.
MODEL = "shard long, keys binary, values binary, codes binary"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str) -> list[str]:
    return text.split()


def word_hash(word: str) -> int:
    """48 bits."""
    return xxhash.xxh64_intdigest(word, 7) >> 16


def _key(*parts: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams from the hashes of their words."""
    with np.errstate(over="ignore"):
        return reduce(lambda h, x: (h ^ (h >> np.uint64(29))) * _A + x * _B, parts[1:], parts[0])


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = TRAIN_FOLDS, max_docs: int = TRAIN_DOCS, max_words: int = TRAIN_WORDS) -> DataFrame:
    """Distinct texts of a fold of the rows with label quality 1, at most ``max_docs`` and about ``max_words`` words. No query uses it.

    Copies are one text of one fold. Languages take turns: texts are drawn in hash order inside each, and the language with the fewest words
    so far goes next. A text longer than ``max_words // LONGEST_SHARE`` words trains with that many from its beginning.
    """
    trusted = labels.where("quality = 1").select("doc_id").distinct()
    longest = max(1, max_words // LONGEST_SHARE)
    key, size = F.xxhash64("text"), F.least(F.size(F.split("text", r"\s+")), F.lit(longest))
    texts = (
        docs.where(F.length("text") > 0)
        .select("doc_id", "lang", key.alias("key"), size.alias("size"))
        .where(F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(folds)) == 0)
        .join(trusted, "doc_id", "left_semi")
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"), F.max("size").alias("size"))
        .withColumn("at", F.xxhash64(F.lit("trusted"), "key"))
    )
    # No language is sorted in one task: a share of its hash range holds twice what all languages may take together.
    sums = texts.groupBy("lang").agg(F.sum("size").alias("_words"), F.count("*").alias("_texts")).withColumnRenamed("lang", "_lang")
    share = F.greatest(F.lit(2.0 * max_words + 20 * longest) / F.col("_words"), F.lit(0.0))
    near = texts.join(sums, F.col("lang").eqNullSafe(F.col("_lang"))).where(F.pmod("at", F.lit(2**40)) < share * F.lit(2.0**40))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("at", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = near.withColumn("turn", before).where(F.col("turn") < max_words).select("key", "doc_id", "size", "turn", "at").orderBy("turn", "at", "key").limit(max_docs)
    total = F.coalesce(F.sum("size").over(Window.orderBy("turn", "at", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = turns.withColumn("_before", total).where(F.col("_before") < max_words).select("key", "doc_id")
    found = docs.select("doc_id", "text", key.alias("key")).join(F.broadcast(chosen), ["key", "doc_id"]).dropDuplicates(["key"])  # max_docs keys at most
    return found.select(F.array_join(F.slice(F.split("text", r"\s+"), 1, longest), " ").alias("text"))


def _word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in a list of hashes for the words of all texts, each with two starts and an end; the list; how many each text has."""
    split = [[START, START, *words(t), END] for t in texts]
    number: collections.defaultdict[str, int] = collections.defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64)
    return ids, np.fromiter(map(word_hash, number), np.uint64), np.array([len(s) for s in split])


def text_blocks(rows: DataFrame, trusted: DataFrame | None, blocks: int) -> DataFrame:
    """``BLOCK`` rows of the distinct texts of rows ``(key, key2, text)``. Those with the keys of ``trusted`` are marked, or else all."""
    block = F.pmod(F.xxhash64(F.lit("block"), "key", "key2"), F.lit(blocks)).alias("block")
    one = rows.select(block, "key", "key2", "text").repartition("block").groupBy("block", "key", "key2").agg(F.first("text").alias("text"))

    def pack(own: pd.DataFrame, good: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=[x.split()[0] for x in BLOCK.split(", ")])
        ids, h, sizes = _word_ids(own["text"].tolist())
        known = None if good is None else set(zip(good["key"].tolist(), good["key2"].tolist(), strict=True))
        marks = [known is None or x in known for x in zip(own["key"].tolist(), own["key2"].tolist(), strict=True)]
        keys = own[["key", "key2"]].to_numpy("<i8").tobytes()
        # A word's first place needs no number: it is the next one.
        new = np.diff(np.maximum.accumulate(ids), prepend=-1) > 0
        raw = keys, np.packbits(marks).tobytes(), sizes.astype("<u4").tobytes(), pack48(h), _pack_codes(np.where(new, 0, ids + 1))
        return pd.DataFrame([(own["block"].iloc[0], *raw)], columns=[x.split()[0] for x in BLOCK.split(", ")])

    if trusted is None:
        return _table(one.groupBy("block").applyInPandas(lambda own: pack(own), BLOCK))
    marked = trusted.select(block, "key", "key2").distinct()
    return _table(one.groupBy("block").cogroup(marked.groupBy("block")).applyInPandas(pack, BLOCK))


def _unpacked(row: pd.Series, only_trusted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_word_ids`` gives of the texts of a ``BLOCK`` row."""
    h, sizes = unpack48(row["hashes"]), np.frombuffer(row["sizes"], "<u4").astype(np.int64)
    ids = _unpack_codes(row["ids"], int(sizes.sum())) - 1
    ids[ids < 0] = np.arange(len(h))
    if only_trusted:
        marks = np.unpackbits(np.frombuffer(row["trusted"], np.uint8), count=len(sizes)).astype(bool)
        ids, sizes = ids[np.repeat(marks, sizes)], sizes[marks]
    return ids, h, sizes


def _predicted(sizes: np.ndarray) -> np.ndarray:
    """Places of the words that are predicted: all but the two starts of each text."""
    first, ok = np.cumsum(sizes) - sizes, np.ones(int(sizes.sum()), bool)
    ok[first] = ok[first + 1] = False
    return np.flatnonzero(ok)


def _trigrams(ids: np.ndarray, sizes: np.ndarray, n: int, **also: bool) -> tuple[np.ndarray, ...]:
    """The distinct trigrams ``a, b, w`` of all texts, ordered by ``a, b, w``, and what else ``np.unique`` shall return of them."""
    at, pairs = _predicted(sizes), None
    ab = ids[at - 2] * n + ids[at - 1]
    if n**3 >= 1 << 63:
        pairs, ab = np.unique(ab, return_inverse=True)
    code, more = ab * n + ids[at], []
    if also:
        code, *more = np.unique(code, **also)
    else:
        code = np.sort(code)
        code = code[np.diff(code, prepend=-1) != 0]
    ab, w = np.divmod(code, n)
    a, b = np.divmod(ab if pairs is None else pairs[ab], n)
    return a, b, w, *more


def _discounts(n: dict[int, int]) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)]


def gram_keys(kind: int, *parts: np.ndarray) -> np.ndarray:
    """48-bit keys from the hashes of words; those of different kinds differ."""
    return mix(_key(np.full(len(parts[0]), kind, np.uint64), *parts)) >> np.uint64(64 - KEY_BITS)


def _context_keys(parts: list[np.ndarray]) -> np.ndarray:
    """Keys of the contexts of n-grams; a word without one stands for itself."""
    return gram_keys(TWO, *parts[:2]) if len(parts) == 3 else gram_keys(ONE, parts[0])


def _table(df: DataFrame, *by: str) -> DataFrame:
    """``settled``, packed closer."""
    return settled(df, "zstd", *by)


def _level_table(df: DataFrame) -> dict[int, DataFrame]:
    """``_table`` of ``LEVEL`` rows, by their part; each lies in a folder, which can be discarded alone."""
    df = _table(df, "part")
    folders = collections.defaultdict(list)
    for file in df.inputFiles():
        folders[int(file.rsplit("/part=", 1)[1].split("/")[0])].append(file)
    schema, empty = df.drop("part").schema, df.where(F.lit(False)).drop("part")
    return {x: df.sparkSession.read.schema(schema).parquet(*folders[x]) if folders[x] else empty for x in range(-1, COUNT_TURNS)}


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each of the sorted shards and where its rows lie."""
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, e in zip(cut.tolist(), [*cut[1:].tolist(), len(shard)], strict=False):
        yield int(shard[a]), slice(a, e)


def _pack_codes(x: np.ndarray) -> bytes:
    """Small numbers by planes of their four bytes; the upper ones are nearly empty."""
    return pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack_codes(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 4 * n, "zstd"), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _pack_gaps(keys: np.ndarray) -> bytes:
    """Distances of sorted keys, the first from zero: how many, their lower 32 bits, and their upper 16, which are small."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    upper = (gaps >> np.uint64(32)).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return np.array([len(keys)], "<u4").tobytes() + gaps.astype("<u4").tobytes() + pa.compress(upper, "zstd", asbytes=True)


def _unpack_gaps(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    upper = np.frombuffer(pa.decompress(raw[4 + 4 * n :], 2 * n, "zstd"), np.uint8).reshape(2, -1).T.copy().view("<u2").ravel()
    return np.cumsum(upper.astype(np.uint64) << np.uint64(32) | np.frombuffer(raw, "<u4", n, 4), dtype=np.uint64)


def _used(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the numbers below ``n`` occur, in order, and each one's place among these."""
    held = np.zeros(n, bool)
    held[ids] = True
    return np.flatnonzero(held), (np.cumsum(held) - 1)[ids]


def _sent(parts: list[np.ndarray], c: np.ndarray, shards: int, turn: int | None = None) -> list[tuple[int, bytes, bytes]]:
    """``shard, words, counts``: n-grams, given by the hashes of their words, for the shards of their contexts (those of a turn, or all)."""
    shard = _shard_of(_context_keys(parts), shards)
    at = np.argsort(shard, kind="stable")
    if turn is not None:
        at = at[shard[at] % COUNT_TURNS == turn]
    parts, c = [x[at] for x in parts], c[at]
    return [(s, b"".join(pack48(x[own]) for x in parts), pack_counts(c[own])) for s, own in _by_shard(shard[at])]


def trigram_counts(blocks: DataFrame, shards: int, turn: int) -> DataFrame:
    """``shard, keys, c``: the distinct trigrams of the trusted texts of each block, and how often it has them; for the shards of a turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            ids, h, sizes = _unpacked(row, only_trusted=True)
            *parts, c = _trigrams(ids, sizes, len(h), return_counts=True)
            yield pd.DataFrame(_sent([h[x] for x in parts], c, shards, turn), columns=["shard", "keys", "c"])

    return blocks.select("trusted", "sizes", "hashes", "ids").mapInPandas(run, "shard long, keys binary, c binary")


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.iloc[i]


def _level(order: int, shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Adds up what one shard was sent of the n-grams of an order, and counts for the next lower one how many of them end in each."""

    def run(sent: pd.DataFrame) -> pd.DataFrame:
        shard = sent["shard"].iloc[0]
        parts = list(np.concatenate([unpack48(x).reshape(order, -1) for x in sent["keys"]], axis=1))
        c = np.concatenate([unpack_counts(x) for x in sent["c"]])
        key = gram_keys(order, *parts)
        at = np.argsort(key)
        begin = np.flatnonzero(np.diff(key[at], prepend=~key[at[:1]]))
        c, first = np.add.reduceat(c[at], begin), at[begin]
        parts, key = [x[first] for x in parts], key[first]
        own, out = (None, None), []
        if order > 1:
            context = _context_keys(parts)
            at = np.argsort(context)
            context, key, c = context[at], key[at], c[at]
            begin = np.flatnonzero(np.diff(context, prepend=~context[:1]))
            own = pack_sorted(context[begin]), pack_counts(np.diff(begin, append=len(c)))
            lower = gram_keys(order - 1, *parts[1:])
            _, first, n = np.unique(lower, return_index=True, return_counts=True)
            by = np.argsort(parts[1][first])  # n-grams that begin alike lie side by side, which packs closer
            first, n = first[by], n[by]
            out = [(s, s % COUNT_TURNS, k, x, None, None, 0, 0, 0, 0, 0, 0) for s, k, x in _sent([x[first] for x in parts[1:]], n, shards)]
        out.append((shard, -1, pack48(key), pack_counts(c), *own, *(int((c == i).sum()) for i in (1, 2, 3, 4)), int(c.sum()), len(c)))
        return pd.DataFrame(out, columns=[x.split()[0] for x in LEVEL.split(", ")])

    return run


def _terms(order: int, cut: list[float], total: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``MODEL`` rows: what n-grams add to a probability, and the weight that their contexts leave to the lower order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            keys, c = unpack48(row["keys"]), unpack_counts(row["c"])
            off = np.array([0.0, *cut])[np.minimum(c, 3)]
            if order == 1:
                told = np.maximum(c - off, 0) / total
            else:
                size = unpack_counts(row["sizes"])
                begin = np.cumsum(size) - size
                t = np.add.reduceat(c, begin)
                keys = np.concatenate((keys, unpack_sorted(row["contexts"])))
                told = np.concatenate(((c - off) / np.repeat(t, size), np.add.reduceat(off, begin) / t))
            at = np.argsort(keys)
            values, codes = np.unique(told[at], return_inverse=True)
            yield pd.DataFrame([(row["shard"], _pack_gaps(keys[at]), values.tobytes(), _pack_codes(codes))], columns=[x.split()[0] for x in MODEL.split(", ")])

    return run


def _forget(counts: tuple[DataFrame, int, str]) -> None:
    """Drop a model."""
    discard(counts[0])
    counts[0].sparkSession.sql(f"DROP TABLE IF EXISTS {counts[2]}")


def train(texts: DataFrame, shards: int = SHARDS) -> tuple[tuple[DataFrame, int, str], float]:
    """``train_blocks`` of the distinct ones of some texts."""
    blocks = text_blocks(texts.select(*_text_keys(), "text"), None, shards)
    model = train_blocks(blocks, shards)
    discard(blocks)
    return model


def train_blocks(blocks: DataFrame, shards: int) -> tuple[tuple[DataFrame, int, str], float]:
    """Modified Kneser-Ney with interpolation: counts of the trigrams of trusted texts, then continuation counts for the lower orders.

    Returns the terms, a table bucketed by shard, with the number of the shards and the table's name, and the probability of an unseen word.
    """
    spark, name = blocks.sparkSession, f"quality_model_{uuid.uuid4().hex}"
    path, buckets = f"{shared_folder(spark)}/{name}", max(shards, shuffle_width(spark))  # with fewer, Spark would shuffle the table
    sent = [trigram_counts(blocks, shards, turn) for turn in range(COUNT_TURNS)]
    for order in (3, 2, 1):
        written = []
        for x in sent:
            written.append(_level_table(x.groupBy("shard").applyInPandas(_level(order, shards), LEVEL)))
            discard(*([x] if order < 3 else []))
        sums = reduce(DataFrame.union, [x[-1] for x in written]).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n1", "n2", "n3", "n4", "total", "types")]).first()
        cut = _discounts({i: sums[f"n{i}"] for i in (1, 2, 3, 4)})
        for x in written:
            terms = x[-1].select("shard", "keys", "c", "contexts", "sizes").mapInPandas(_terms(order, cut, float(max(1, sums["total"]))), MODEL)
            terms.write.mode("append").bucketBy(buckets, "shard").format("parquet").option("path", path).option("compression", "zstd").saveAsTable(name)
            discard(x[-1])
        sent = [reduce(DataFrame.union, [x[turn] for x in written]) for turn in range(COUNT_TURNS)]
    n1, n2, size, total = sums["n1"], sums["n2"], sums["types"], max(1, sums["total"])
    freed = cut[0] * n1 + cut[1] * n2 + cut[2] * (size - n1 - n2) if size else 1.0
    return (spark.table(name), shards, name), freed / total / (size + 1)


class _Questions:
    """The distinct trigrams of texts, in any order, and what they ask of a model: five kinds of keys, and the shard that holds each."""

    def __init__(self, row: pd.Series, shards: int, **also: bool) -> None:
        ids, h, self.sizes = _unpacked(row)
        n = len(h)
        a, self.b, self.w, *self.place = _trigrams(ids, self.sizes, n, **also)
        new = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(self.b, prepend=-1) != 0))
        self.ab = np.repeat(np.arange(len(new)), np.diff(new, append=len(a)))
        bw, self.bw = np.unique(self.b * n + self.w, return_inverse=True)
        b, w = np.divmod(bw, n)
        two, one = gram_keys(TWO, h[a[new]], h[self.b[new]]), gram_keys(ONE, h)
        in_two, in_one = _shard_of(two, shards), _shard_of(one, shards)
        keys = [gram_keys(TRI, h[a], h[self.b], h[self.w]), two, gram_keys(BI, h[b], h[w]), one, gram_keys(UNI, h)]
        self.ends = np.cumsum([len(x) for x in keys])[:-1]
        #: Shard and key as one number.
        self.keys = np.concatenate([in_two[self.ab], in_two, in_one[b], in_one, in_one]).astype(np.uint64) << np.uint64(KEY_BITS) | np.concatenate(keys)


def score_texts(texts: DataFrame, counts: tuple[DataFrame, int, str], unseen: float) -> DataFrame:
    """``(key, key2, n_words, nll)`` of distinct texts from rows ``(key, key2, text)``."""
    blocks = text_blocks(texts, None, _blocks_of(int(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])))
    scores = score_blocks(blocks, counts, unseen)
    discard(blocks)
    return scores


def _blocks_of(chars: int) -> int:
    return max(1, -(-chars // GROUP_CHARS))


def score_blocks(blocks: DataFrame, counts: tuple[DataFrame, int, str], unseen: float) -> DataFrame:
    """``(key, key2, n_words, nll)`` of the texts of blocks.

    Blocks ask every shard for the n-grams they hold, once each, and get their terms back in the order of their question.
    """
    known, shards, _ = counts

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows(batches):
            keys = np.sort(_Questions(row, shards).keys)
            key = keys & np.uint64((1 << KEY_BITS) - 1)
            out = [(s, row["block"], _pack_gaps(key[own])) for s, own in _by_shard((keys >> np.uint64(KEY_BITS)).astype(np.int64))]
            yield pd.DataFrame(out, columns=["shard", "block", "keys"])

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        keys, codes, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for r in own.itertuples() if len(asked) else ():
            keys.append(_unpack_gaps(r.keys))
            codes.append(_unpack_codes(r.codes, len(keys[-1])) + sum(map(len, values)))
            values.append(np.frombuffer(r.values))
        keys, codes, values = np.concatenate(keys), np.concatenate(codes), np.concatenate(values)
        at = np.argsort(keys, kind="stable")  # a few sorted runs
        keys, codes = keys[at], codes[at]
        out = []
        for r in asked.itertuples():
            want = _unpack_gaps(r.keys)
            place = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            held = keys[place] == want if len(keys) else np.zeros(len(want), bool)
            told, code = _used(codes[place[held]], len(values))
            out.append((r.block, r.shard, len(want), np.packbits(held).tobytes(), values[told].tobytes(), _pack_codes(code)))
        return pd.DataFrame(out, columns=["block", "shard", "n", "held", "values", "codes"])

    def score(own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        q = _Questions(own.iloc[0], shards, return_inverse=True)
        said = said.sort_values("shard")
        held = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(said["held"], said["n"], strict=True)])
        assert len(held) == len(q.keys), "a block was answered another question than it has"
        size = [int(x.sum()) for x in np.split(held, np.cumsum(said["n"].to_numpy())[:-1])]
        told = np.zeros(len(held))
        told[q.ends[0] : q.ends[1]] = told[q.ends[2] : q.ends[3]] = 1.0  # an unknown context leaves all to the lower order
        told[np.argsort(q.keys)[held]] = np.concatenate([np.frombuffer(v)[_unpack_codes(x, n)] for v, x, n in zip(said["values"], said["codes"], size, strict=True)])
        tri, two, bi, one, uni = np.split(told, q.ends)
        p = tri + two[q.ab] * (bi[q.bw] + one[q.b] * (uni[q.w] + unseen))
        n, (key, key2) = q.sizes - 2, np.frombuffer(own["keys"].iloc[0], "<i8").reshape(-1, 2).T
        return pd.DataFrame({"key": key, "key2": key2, "n_words": n, "nll": -np.add.reduceat(np.log(p)[q.place[0]], np.cumsum(n) - n) / n})

    asked = blocks.select("block", "sizes", "hashes", "ids").mapInPandas(ask, "shard long, block long, keys binary")
    answers = _table(asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(answer, "block long, shard long, n long, held binary, values binary, codes binary"))
    scores = _table(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, "key long, key2 long, n_words long, nll double"))
    discard(answers)
    return scores


def _text_keys() -> list[Column]:
    """128 bits of a text; a null one is empty."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("key"), F.xxhash64(F.lit("second"), text).alias("key2")]


def _part() -> Column:
    """The part of a row with ``key, key2``, from 0 to ``PARTS - 1``: copies share one. Even parts are one half, odd ones the other."""
    return F.pmod(F.xxhash64(F.lit("part"), "key", "key2"), F.lit(PARTS))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, key, key2, n_words, nll`` of every row's whole text, by the model of the trusted texts of the other half.

    Trusted texts are the distinct ones of all rows with label quality 1, but for the empty one. Both models together are trained on all of
    them, and none judges a text that it knows by heart.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    trusted = _table(docs.where(F.length("text") > 0).select("doc_id", *_text_keys()).join(good, "doc_id", "left_semi").select("key", "key2").distinct())
    chars = int(docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])
    shards = min(2**16 - 1, max(SHARDS, -(-chars // SHARD_CHARS)))
    rows = docs.select(*_text_keys(), F.coalesce("text", F.lit("")).alias("text"))
    halves = [text_blocks(*(x.where(_part() % 2 == half) for x in (rows, trusted)), _blocks_of(chars // 2)) for half in (0, 1)]
    scores = []
    for own, other in (halves, halves[::-1]):
        counts, unseen = train_blocks(other, shards)
        scores += [score_blocks(own.where(F.col("block") % SCORE_TURNS == turn), counts, unseen) for turn in range(SCORE_TURNS)]
        _forget(counts)
    discard(trusted, *halves)
    return docs.select("doc_id", "lang", *_text_keys()).join(reduce(DataFrame.union, scores), ["key", "key2"])


def judge(scored: DataFrame, fence: float = 3.0, sigmas: float = 2.0, accuracy: int = 10_000) -> DataFrame:
    """Add ``threshold`` and ``keep``.

    A language's threshold is its median plus ``fence`` times the distance from the lower quartile to the median, over all its
    distinct texts: neither junk nor a group of copies moves the quantiles much. The distance counts as ``LEAST_SPREAD`` of the median at
    least. A document is rejected if the lower end of its own interval (``sigmas`` standard errors below the mean, with ``WORD_SD``
    for one word) is above the threshold, so short texts need stronger evidence.
    """
    texts = scored.groupBy("lang", "key", "key2").agg(F.min("nll").alias("nll"))
    quantiles = texts.groupBy("lang").agg(F.percentile_approx("nll", [0.25, 0.5], accuracy).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], LEAST_SPREAD * F.col("q")[1])
    limits = quantiles.select(F.col("lang").alias("of_lang"), (F.col("q")[1] + fence * spread).alias("threshold"))
    low = F.col("nll") - sigmas * WORD_SD / F.sqrt("n_words")
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")), "left").drop("of_lang").withColumn("keep", low <= F.col("threshold"))


def _verdicts(docs: DataFrame, labels: DataFrame, fence: float, sigmas: float) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    return judge(score_documents(docs, labels.select("doc_id", "quality")), fence, sigmas)


def quality_verdicts(docs: DataFrame, labels: DataFrame, fence: float = 3.0, sigmas: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang, n_words, nll, perplexity, threshold, keep``.

    A null text counts as empty; an empty one is judged by its end alone. A null language is a language of its own. Without trusted
    rows every word is equally unlikely and nothing is rejected. Repeated rows get equal verdicts. Extra columns are ignored.
    """
    return _verdicts(docs, labels, fence, sigmas).select("doc_id", "lang", "n_words", "nll", F.exp("nll").alias("perplexity"), "threshold", "keep")


def quality_filter(docs: DataFrame, labels: DataFrame, fence: float = 3.0, sigmas: float = 2.0) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names."""
    gone = _verdicts(docs, labels, fence, sigmas).where(~F.col("keep")).select("lang", "key", "key2").distinct()
    rows = docs.select("lang", *_text_keys(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = rows["lang"].eqNullSafe(gone["lang"]) & (rows["key"] == gone["key"]) & (rows["key2"] == gone["key2"])
    return rows.join(gone, same, "left_anti").select("row.*")
