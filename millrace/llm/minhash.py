"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF weighted word shingles.

Shingles of five words are weighted by term frequency and a damped inverse document frequency, from exact frequencies over all
documents. ICWS samples are banded into buckets. Every member of a bucket is first compared, by exact weighted Jaccard
similarity, with the bucket's anchor. Buckets whose members aren't all in the anchor's component by then go on in rounds: members
outside that component lead, ever more of them at a time, and meet all others. What is compared travels in groups of members with
their leaders, never as pairs, and two components that a task has joined aren't compared again there. A bucket is settled once
every member outside its anchor's component has led, so no link between components is lost.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, durable, shared_folder
from .components import connected_components
from .shingles import document_frequencies, mix, pack48, unpack48, with_frequencies, written_blocks

_A = np.uint64(0x9E3779B97F4A7C15)
#: Members that travel with their leaders (more if there are more leaders), rows that a task compares in one call.
GROUP_ROWS, CALL_ROWS = 128, 512
#: How many times more members may lead in each round.
ROUND_GROWTH = 64
#: Shingles that are sampled at once: what numpy works on stays in the processor's cache.
SAMPLE_SHINGLES = 40_000


def idf_weights(tf: np.ndarray, df: np.ndarray, n_docs: int, damping: float) -> np.ndarray:
    """``tf * (1 + damping * ln(N / df) / ln(N))``."""
    if n_docs < 2:
        return tf.astype(np.float64)
    return tf * (1 + damping * np.log(n_docs / np.clip(df, 1, n_docs)) / np.log(n_docs))


@functools.cache
def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 65536 points, and their logarithms."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def icws(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, n_samples: int) -> np.ndarray:
    """Consistent weighted samples, one row for each set that isn't empty: the probability that two sets agree in a column is their
    weighted Jaccard similarity. Every shingle draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash."""
    r_table, lnc_table = _gamma_tables()
    counts = counts[counts > 0]
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    log_w = np.log(weights).astype(np.float32)
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros((len(counts), n_samples), np.uint64)
    for k in range(n_samples):
        x = mix(hashes ^ np.uint64((k + 1) * int(_A) & (1 << 64) - 1))
        r, lnc = r_table[(x & np.uint64(0xFFFF)).astype(np.int64)], lnc_table[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (x >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(log_w / r + beta)
        log_a = lnc - r * (t - beta + np.float32(1.0))
        low = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, first), counts))
        best = low[np.flatnonzero(np.diff(owner[low], prepend=-1))]
        out[:, k] = mix(hashes[best] + t[best].astype(np.int64).view(np.uint64) * _A)
    return out


def _signatures(blocks: DataFrame, answers: DataFrame, n_docs: int, damping: float, bands: int, rows: int) -> DataFrame:
    """``(node, block, place, buckets)``: place in the block, one bucket for each band. Texts without words have no row."""

    def use(block: int, nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, note: bytes | None) -> pd.DataFrame:
        weights, own = idf_weights(counts[0], counts[1], n_docs, damping), np.flatnonzero(sizes)
        ends = np.cumsum(sizes[own])
        out, a = np.zeros((len(own), bands), np.uint64), 0
        while a < len(own):
            begin = ends[a] - sizes[own[a]]
            b = max(a + 1, int(np.searchsorted(ends, begin + SAMPLE_SHINGLES, "right")))
            sampled = icws(hashes[begin : ends[b - 1]], weights[begin : ends[b - 1]], sizes[own[a:b]], bands * rows)
            for band in range(bands):
                key = np.full(b - a, band, np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    key = mix(key * _A + sampled[:, k])
                out[a:b, band] = key
            a = b
        return pd.DataFrame({"node": nodes[own], "block": block, "place": own, "buckets": list(out.view(np.int64))})

    return with_frequencies(blocks, answers, use, "node long, block long, place long, buckets array<long>")


def _features(blocks: DataFrame, answers: DataFrame, wanted: DataFrame, n_docs: int, damping: float) -> DataFrame:
    """``(node, mass, shingles, weights)`` of the texts at ``wanted``'s ``(block, place)``."""

    def use(block: int, nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, note: bytes | None) -> pd.DataFrame:
        rows, ends = [], np.cumsum(sizes)
        weights = idf_weights(counts[0], counts[1], n_docs, damping).astype(np.float32)
        for i in sorted(map(int, note.split(b","))) if note else ():
            own = slice(ends[i] - sizes[i], ends[i])
            rows.append((nodes[i], float(weights[own].sum(dtype=np.float64)), pack48(hashes[own]), weights[own].tobytes()))
        return pd.DataFrame(rows, columns=["node", "mass", "shingles", "weights"])

    notes = wanted.groupBy("block").agg(F.array_join(F.collect_list(F.col("place").cast("string")), ",").cast("binary").alias("df"))
    answers = answers.join(notes.select("block"), "block", "left_semi").unionByName(notes.withColumn("shard", F.lit(-1).cast("long")))
    return with_frequencies(blocks, answers, use, "node long, mass double, shingles binary, weights binary")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets of (sorted distinct hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _links(pdf: pd.DataFrame, threshold: float, by_bucket: bool) -> list[tuple[int, int]]:
    """Links between components among leaders and members of one group."""
    leads = pdf["leads"].to_numpy(bool)
    members, leaders = pdf[~leads], pdf[leads]
    if not len(members) or not len(leaders):
        return []
    parts, label = np.unique(np.concatenate((members["part"].to_numpy(np.int64), leaders["part"].to_numpy(np.int64))), return_inverse=True)
    own, lead = label[: len(members)].copy(), label[len(members) :].copy()
    name = dict(enumerate(parts.tolist()))
    hashes = [unpack48(x) for x in members["shingles"]]
    flat, weights = np.concatenate(hashes), np.frombuffer(b"".join(members["weights"]), np.float32).astype(np.float64)
    sizes = np.array([len(x) for x in hashes])
    begin = np.cumsum(sizes) - sizes
    mass, nodes = members["mass"].to_numpy(), members["node"].to_numpy(np.int64)
    keys = np.stack(members["buckets"].to_numpy()) if by_bucket else None
    bucket = int(pdf["grp"].iloc[0])
    found = []
    for i, (node, full, raw, w) in enumerate(zip(leaders["node"], leaders["mass"], leaders["shingles"], leaders["weights"], strict=True)):
        # No similarity exceeds the ratio of the two sums of weights.
        want = (own != lead[i]) & (nodes != node) & (np.minimum(mass, full) >= (threshold - 1e-6) * np.maximum(mass, full))
        if by_bucket and want.any():  # a pair is compared in the first bucket that it shares
            same = keys == np.asarray(leaders["buckets"].iloc[i])
            want &= np.where(same.any(axis=1), keys[np.arange(len(keys)), same.argmax(axis=1)] == bucket, False)
        at = np.flatnonzero(want)
        if not len(at):
            continue
        h, w = unpack48(raw), np.frombuffer(w, np.float32)
        n = sizes[at]
        pick = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.minimum(np.searchsorted(h, flat[pick]), len(h) - 1)
        both = np.where(h[place] == flat[pick], np.minimum(weights[pick], w[place]), 0.0)
        both = np.add.reduceat(both, np.cumsum(n) - n)
        for other in np.unique(own[at[both >= threshold * (mass[at] + full - both)]]):
            found.append((name[int(lead[i])], name[int(other)]))
            own[own == other], lead[lead == other] = lead[i], lead[i]
    return found


def _compare(side: DataFrame, features: DataFrame, threshold: float, by_bucket: bool, n_rows: int) -> DataFrame:
    """``(src, dst)`` components with a link, from rows ``(grp, node, part, leads)``: a group's leaders meet all its members.

    Members are split by a hash into groups of about ``GROUP_ROWS``, or as many as there are leaders; each gets all leaders.
    """
    sizes = side.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("leads").alias("n_lead")).where("n_lead > 0")
    width = F.greatest(F.lit(GROUP_ROWS), F.least("n_lead", F.lit(16 * GROUP_ROWS)))
    sized = side.join(sizes, "grp").withColumn("salts", F.ceil(F.col("n") / width).cast("int"))
    members = sized.select("grp", "node", "part", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(False).alias("leads"))
    leaders = sized.where("leads").select("grp", "node", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("leads"))
    cells = max(1, -(-2 * n_rows // CALL_ROWS))
    rows = members.unionByName(leaders).join(features if by_bucket else features.drop("buckets"), "node").withColumn("call", F.pmod(F.xxhash64("grp", "salt"), F.lit(cells)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [x for _, own in pdf.groupby(["grp", "salt"], sort=False) for x in _links(own, threshold, by_bucket)]
        return pd.DataFrame(out, columns=["src", "dst"])

    return rows.groupBy("call").applyInPandas(run, "src long, dst long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 10, rows: int = 3, damping: float = 0.25) -> DataFrame:
    """One row per row: ``doc_id, class_id, class_size, kept``.

    ``class_id`` is the smallest id among rows that a chain of links connects; a link is an equal text, or weighted Jaccard
    similarity of at least ``threshold``. Words are runs of letters, digits and underscores in lower case. Texts of fewer than
    ``shingle`` words have one shingle of all their words. Texts without words, and null texts (as empty), are linked only to equal
    texts. ``kept`` marks the smallest id, and of rows that share it the smallest hash of the text. Null ids come before all others and
    come back null. Rows that share an id but not a text are compared each by its own, so an id can be in several classes. Rows that
    share both are marked alike. Other columns are ignored.
    """
    return _classes(docs, threshold, shingle, bands, rows, damping).select("doc_id", "class_id", "class_size", "kept")


def _row_key() -> Column:
    """Texts are told apart by 64 bits; a null text is an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    df = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return df, seen.get["n"]


def _merged(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(node, part)`` with parts named anew after links between them."""
    named = connected_components(fresh).select(F.col("node").alias("part"), "component")
    return durable(state.join(named, "part", "left").select("node", F.coalesce("component", "part").alias("part")))


def _candidates(docs: DataFrame, shingle: int, bands: int, rows: int, damping: float) -> tuple[DataFrame, DataFrame, int]:
    """Features of the distinct texts that share a bucket with another, the rows of those buckets, and how many rows these are."""
    spark = docs.sparkSession
    shared_folder(spark)
    texts = docs.select(_row_key().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    n_docs, n_chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    table = written_blocks(spark, texts, shingle, n_chars)
    try:
        blocks = spark.table(table)
        answers = durable(document_frequencies(blocks, n_chars))
        signed = durable(_signatures(blocks, answers, n_docs, damping, bands, rows).dropDuplicates(["node"]))
        # One hash draws the anchors of all buckets, so that a text's buckets mostly share theirs.
        drawn = signed.select("node", F.explode("buckets").alias("bucket"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(2**40)).alias("draw"))
        sizes = drawn.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("draw", "node")).alias("first")).where("size > 1")
        buckets, n_rows = _counted(drawn.join(sizes.select("bucket", "size", F.col("first.node").alias("anchor")), "bucket"))
        wanted = signed.join(buckets.select("node").distinct(), "node", "left_semi")
        features = durable(_features(blocks, answers, wanted, n_docs, damping).join(wanted.select("node", "buckets"), "node"))
        discard(answers, signed)
    finally:
        discard(spark.table(table))
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return features, buckets, n_rows


def _components(docs: DataFrame, threshold: float, shingle: int, bands: int, rows: int, damping: float) -> DataFrame:
    """``(node, part)`` of the distinct texts that share a bucket with another."""
    features, buckets, n_rows = _candidates(docs, shingle, bands, rows, damping)
    state = durable(features.select("node", F.col("node").alias("part")))
    met = buckets.where("node <> anchor").select(F.col("anchor").alias("grp"), "node").distinct()
    led = met.select("grp").distinct()
    side = met.select("grp", "node", F.col("node").alias("part"), F.lit(False).alias("leads")).union(led.select("grp", "grp", "grp", F.lit(True)))
    fresh, n_links = _counted(_compare(side, features, threshold, False, n_rows).distinct())
    if n_links:
        state = _merged(state, fresh)
    # A member's rank in its bucket, roughly, without a sort of the bucket.
    open_, rank, low, high = buckets, F.col("draw") / F.lit(float(2**40)) * F.col("size"), 0, ROUND_GROWTH
    while True:
        of_anchor = state.select(F.col("node").alias("anchor"), F.col("part").alias("anchor_part"))
        placed = open_.select("node", "bucket", "draw", "size", "anchor").join(state, "node").join(of_anchor, "anchor").withColumn("due", (F.col("part") != F.col("anchor_part")) & (rank >= low))
        due = placed.where("due").select("bucket").distinct()
        open_, n_rows = _counted(placed.join(due, "bucket", "left_semi"))
        if not n_rows:
            discard(features, buckets, open_)
            return state
        side = open_.select(F.col("bucket").alias("grp"), "node", "part", (F.col("due") & (rank < high)).alias("leads"))
        fresh, n_links = _counted(_compare(side, features, threshold, True, n_rows).distinct())
        if n_links:
            state = _merged(state, fresh)
        low, high = high, high * ROUND_GROWTH


def _classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 10, rows: int = 3, damping: float = 0.25) -> DataFrame:
    """``doc_id, row_key, class_id, class_size, kept`` of every row. Distinct texts are compared, whatever ids they have."""
    state = _components(docs, threshold, shingle, bands, rows, damping)
    members = docs.select("doc_id", _row_key().alias("row_key"))
    named = members.join(state.withColumnRenamed("node", "row_key"), "row_key", "left").withColumn("class", F.coalesce("part", "row_key"))
    classes = named.groupBy("class").agg(F.count("*").alias("class_size"), F.min(F.struct("doc_id", "row_key")).alias("first"))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    return named.join(classes, "class").select("doc_id", "row_key", F.col("first.doc_id").alias("class_id"), "class_size", first.alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, all columns kept, whatever their names."""
    kept = _classes(docs, **options).where("kept").select("doc_id", "row_key").distinct()
    rows = docs.select("doc_id", _row_key().alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["row_key"] == kept["row_key"]), "left_semi")
    return left.dropDuplicates(["doc_id", "row_key"]).select("row.*")
