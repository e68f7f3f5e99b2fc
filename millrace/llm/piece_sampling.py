"""SentencePiece segmentations sampled without replacement, and their decoding.

A text is cut before every run of blanks; no piece of the model crosses such a cut, so the lattice of a text is a chain of
small lattices, one per chunk, and equal chunks share one. Over that chain, a perturbed best-first search (Gumbel top-k)
emits the ``k`` segmentations with the largest perturbed log-probabilities: the first is an exact sample; every step of its path
leaves behind the set of segmentations that agree up to the step and differ in it, whose perturbed maximum is a Gumbel
truncated below the path's; the best of these sets is expanded next. The best set left over gives the threshold of the
inclusion probabilities. Random numbers are hashes of seed, row key, round, chunk and step, so neither batches nor retries
change a result.
"""

from __future__ import annotations

import collections
import functools
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Code points that are segmented at once.
BATCH_CHARS = 3_000_000
#: Chunks that are sampled at once.
GROUP_CHUNKS = 120_000


class PieceModel:
    """Pieces of a model file with log-probabilities from their rank (a BPE model stores merge ranks, not probabilities).

    ``p(piece)`` falls as ``1 / (rank + 1)`` and is sharpened by ``theta``; a character without a piece becomes its bytes, each
    as likely as the last piece.
    """

    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = np.zeros(256, np.int64)
        ids = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                ids.append(i)
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece holds a blank after another character; its lattice can't be cut at blanks")
        rank = np.arange(len(ids))
        logp = -theta * np.log(rank + 1.0)
        logp -= np.log(np.exp(logp).sum())
        self.byte_logp = float(logp[-1])
        self.longest = max(len(self.pieces[i]) for i in ids)
        # By length: hashes of the beginnings of pieces, sorted, with the piece's id (-1 for a mere beginning) and log-probability.
        whole = {self.pieces[i]: (i, lp) for i, lp in zip(ids, logp.tolist(), strict=True)}
        self.tables = {}
        for n in range(1, self.longest + 1):
            heads = sorted((int(spread(hash_text(p))), *whole.get(p, (-1, 0.0))) for p in {p[:n] for p in whole if len(p) >= n})
            keys = np.array([x[0] for x in heads], np.uint64)
            if (keys[1:] == keys[:-1]).any():
                raise ValueError("two beginnings of pieces share a hash")
            first = np.searchsorted(keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
            self.tables[n] = keys, np.array([x[1] for x in heads]), np.array([x[2] for x in heads]), np.minimum(first, len(keys) - 1)
        self.spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

        sizes = np.array([len(x) for x in self.spelled])
        self.spelled_at, self.spelled_size, self.letters = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(self.spelled), np.uint8)

    def find(self, size: int, h: np.ndarray) -> np.ndarray:
        """Places in the table of beginnings of ``size`` of the first hash that isn't smaller, or the last place."""
        keys, first = self.tables[size][0], self.tables[size][3]
        k = first[(h >> np.uint64(48)).astype(np.int64)]  # hashes are spread evenly: it's there or a few places on
        open_ = np.flatnonzero((keys[k] < h) & (k < len(keys) - 1))
        while len(open_):
            k[open_] += 1
            open_ = open_[(keys[k[open_]] < h[open_]) & (k[open_] < len(keys) - 1)]
        return k

    def spell_all(self, samples: list[np.ndarray]) -> list[bytes]:
        """``spell`` of many lists of ids at once."""
        if not samples:
            return []
        ids = np.concatenate(samples)
        size = self.spelled_size[ids]
        ends = np.cumsum(size)
        raw = self.letters[np.repeat(self.spelled_at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(x) for x in samples])))].tolist()
        return [raw[a:b].removeprefix(b" ") for a, b in itertools.pairwise(cut)]

    def spell(self, ids) -> bytes:
        """Pieces and bytes in order, without the blank that encoding put in front."""
        return b"".join(map(self.spelled.__getitem__, ids)).removeprefix(b" ")

    def decode(self, ids) -> str:
        return self.spell(ids).decode("utf-8", "replace")


@functools.lru_cache(2)
def piece_model(path: str, theta: float) -> PieceModel:
    return PieceModel(path, theta)


def hash_text(text: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in text:
        h = h * _BASE + np.uint64(ord(c) + 1)
    return h[0]


def spread(h: np.ndarray) -> np.ndarray:
    """Hashes whose upper bits differ, too."""
    with np.errstate(over="ignore"):
        return h * np.uint64(0xD6E8FEB86659FD93)


def chunks(text: str) -> list[str]:
    """Parts of a text that begin with its blanks; together they spell the text with a blank in front."""
    if not text:
        return []
    if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return f"{SPACE}{text.replace(' ', ' ' + SPACE)}".split(" ")
    return _RUNS.findall(SPACE + text.replace(" ", SPACE))


class Lattices:
    """Edges of many chunks in flat arrays; node = place in the concatenated chunks, each with a final node of its own."""

    def __init__(self, model: PieceModel, texts: list[str]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.first = (np.cumsum(sizes + 1) - (sizes + 1)).astype(np.int32)
        self.last = (self.first + sizes).astype(np.int32)
        n = int((sizes + 1).sum())
        code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64) if texts else np.zeros(0, np.uint64)
        room = np.repeat(self.last, sizes + 1) - np.arange(n)
        found = []
        at, h = np.flatnonzero(room > 0), np.zeros(n, np.uint64)
        single = np.zeros(n, bool)
        for size in range(1, model.longest + 1):
            at = at[room[at] >= size]
            if not len(at):
                break
            h[at] = h[at] * _BASE + (code[at + size - 1] + np.uint64(1))
            keys, ids, lps = model.tables[size][:3]
            own = spread(h[at])
            k = model.find(size, own)
            begun = keys[k] == own
            at, k = at[begun], k[begun]
            id_ = ids[k]
            hit = id_ >= 0
            found.append((at[hit], size, id_[hit], lps[k[hit]]))
            if size == 1:
                single[found[0][0]] = True
        bare = np.flatnonzero((room > 0) & ~single)
        n_bytes = 1 + (code[bare] >= 0x80) + (code[bare] >= 0x800).astype(int) + (code[bare] >= 0x10000)
        found.insert(0, (bare, 1, -1 - code[bare].astype(np.int64), n_bytes * model.byte_logp))

        # Edges by node, long steps first: they are likely.
        edges = np.zeros(n, np.int64)
        for node, *_ in found:
            edges[node] += 1
        ends = np.cumsum(edges)
        self.begin = np.concatenate(([0], ends)).astype(np.int32)
        self.stop, self.piece, logp = np.empty(ends[-1] if n else 0, np.int32), np.empty(ends[-1] if n else 0, np.int32), np.empty(ends[-1] if n else 0)
        free = ends - edges
        for node, size, id_, lp in reversed(found):
            at = free[node]
            self.stop[at], self.piece[at], logp[at] = node + size, id_, lp
            free[node] = at + 1
        start, stop = np.repeat(np.arange(n), edges), self.stop
        self.logp = logp

        # Sums of all paths from a node to its chunk's end, from the last place of all chunks to the first.
        back = np.arange(n) - np.repeat(self.first, sizes + 1)
        back = np.repeat(back.max(initial=0) - back, edges)
        order = np.argsort(back.astype(np.uint16) if back.max(initial=0) < 1 << 16 else back, kind="stable")
        s, e, lp = start[order], stop[order], logp[order]
        self.mass = np.zeros(n)
        at_place = np.bincount(back)
        cut = np.cumsum(at_place[at_place > 0]).tolist()
        for a, b in itertools.pairwise([0, *cut]):
            value = lp[a:b] + self.mass[e[a:b]]
            node = np.flatnonzero(np.diff(s[a:b], prepend=-1))
            high = np.maximum.reduceat(value, node)
            width = np.diff(np.append(node, b - a))
            self.mass[s[a:b][node]] = high + np.log(np.add.reduceat(np.exp(value - np.repeat(high, width)), node))

        # What a step adds to a path's log-probability.
        self.start, self.log_share = start.astype(np.int32), np.minimum(logp + self.mass[stop] - np.repeat(self.mass, edges), 0.0)
        self.share = np.exp(self.log_share)
        # Share of the steps from a node up to this one; the last one's is above every random number.
        sums = np.cumsum(self.share)
        self.upto = sums - np.repeat(np.concatenate(([0.0], sums))[self.begin[:-1]], edges)
        self.upto[self.begin[1:][edges > 0] - 1] = 2.0


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), from 64-bit keys."""
    with np.errstate(over="ignore"):
        return ((_mix(key + np.uint64(salt) * _BASE) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _uniform_one(key: int, salt: int) -> float:
    """``_uniform`` of one key."""
    mask = (1 << 64) - 1
    x = (key + salt * int(_BASE)) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return (((x ^ (x >> 31)) >> 11) + 0.5) / 2.0**53


def _below_one(limit: float, mass: float, u: float) -> float:
    """The perturbed maximum of a set with log-probability ``mass``, given that it is below ``limit``."""
    a, b = mass - limit, math.log(-math.log(u))
    high = max(a, b)
    return mass - high - math.log1p(math.exp(min(a, b) - high))


def _walk(lat: Lattices, node: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled paths from nodes to ends: ``(walker, step, edge)`` in walker order."""
    who, found = np.arange(len(node)), []
    left, step = np.flatnonzero(node < end), 0
    node = node.copy()
    while len(left):
        u = _uniform(key[left], 2 * step + 1)
        e, open_ = lat.begin[node[left]], np.arange(len(left))
        while len(open_):
            open_ = open_[lat.upto[e[open_]] < u[open_]]
            e[open_] += 1
        found.append((who[left], np.full(len(left), step), e))
        node[left] = lat.stop[e]
        left = left[node[left] < end[left]]
        step += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    walker, step_, edge = map(np.concatenate, zip(*found, strict=True))
    steps = np.bincount(walker, minlength=len(node))
    at = (np.cumsum(steps) - steps)[walker] + step_
    path = np.empty(len(edge), np.int64)
    path[at] = edge
    return np.repeat(np.arange(len(node)), steps), np.arange(len(edge)) - np.repeat(np.cumsum(steps) - steps, steps), path


def sample_texts(model: PieceModel, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations ``(ids, log_prob, perturbed, inclusion)``, largest perturbed first."""
    split = [chunks(t) for t in texts]
    number: collections.defaultdict[str, int] = collections.defaultdict(itertools.count().__next__)
    flat = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64)
    types = list(number)
    lat = Lattices(model, types)
    n_chunks = np.array([len(s) for s in split], np.int64)
    ends = np.cumsum(n_chunks)
    out, a = [], 0
    while a < len(texts):  # so many chunks at once that what is sampled stays in the processor's cache
        begin = int(ends[a] - n_chunks[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + GROUP_CHUNKS, "right")))
        out.extend(_sample(model, lat, flat[begin : ends[b - 1]], n_chunks[a:b], keys[a:b].astype(np.uint64), k))
        a = b
    return out


def _sample(model: PieceModel, lat: Lattices, flat: np.ndarray, n_chunks: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """``sample_texts`` of texts whose chunks have the numbers ``flat`` in ``lat``."""
    n, base = len(n_chunks), np.concatenate(([0], np.cumsum(n_chunks)))
    of_text, of_place = np.repeat(np.arange(n), n_chunks), np.arange(len(flat)) - np.repeat(base[:-1], n_chunks)
    first_node, last_node = lat.first[flat], lat.last[flat]

    # A node left to expand: (perturbed maximum, log mass, sample, step, edges ruled out). A sample: its steps' edges and chunks.
    frontier: list[list[tuple[float, float, int, int, tuple[int, ...]]]] = [[] for _ in range(n)]
    samples: list[list[tuple[np.ndarray, np.ndarray, float, float]]] = [[] for _ in range(n)]
    share, begin, start_of, stop_of = lat.share, lat.begin, lat.start, lat.stop

    for turn in range(k):
        with np.errstate(over="ignore"):
            chunk_key = _mix(_mix(keys + np.uint64(turn + 1) * _BASE)[of_text] + of_place.astype(np.uint64))
        # What to expand in each text: at first everything, later the best node.
        jobs, heads = [], []
        fresh = np.zeros(len(flat), bool)  # chunks that are walked from their beginning
        nodes, chunks_ = [], []  # steps after which the rest of a chunk is walked
        for t in range(n):
            if turn == 0:
                g = -math.log(-math.log(_uniform_one(int(keys[t]), 0)))
                jobs.append((t, g))
                heads.append(None)
                fresh[base[t] : base[t + 1]] = True
            elif frontier[t]:
                best = max(range(len(frontier[t])), key=lambda i: frontier[t][i][0])
                g, _, parent, step, out = frontier[t].pop(best)
                edges, of_chunk, _, _ = samples[t][parent]
                node = int(start_of[edges[step]])
                row = [e for e in range(int(begin[node]), int(begin[node + 1])) if e not in out]
                c = int(of_chunk[step])
                key = int(chunk_key[base[t] + c])
                weights = share[row].tolist()
                left, pick = _uniform_one(key, 4 * len(out) + 2) * sum(weights), row[-1]
                for e, w in zip(row, weights, strict=True):
                    left -= w
                    if left <= 0:
                        pick = e
                        break
                before = float(lat.log_share[edges[:step]].sum())
                rest = sum(w for e, w in zip(row, weights, strict=True) if e != pick)
                jobs.append((t, g))
                heads.append((np.append(edges[:step], pick), of_chunk[: step + 1], before + float(lat.log_share[pick]), (before, rest, pick, out, key)))
                nodes.append(stop_of[pick])
                chunks_.append(base[t] + c)
                fresh[base[t] + c + 1 : base[t + 1]] = True
        if not jobs:
            break
        # Rests of chunks and whole chunks, in the order of the chunks.
        whole = np.flatnonzero(fresh)
        place = np.concatenate((np.array(chunks_, np.int64), whole))
        node = np.concatenate((np.array(nodes, np.int32), first_node[whole]))
        order = np.argsort(place, kind="stable") if chunks_ else np.arange(len(place))
        place, node = place[order], node[order]
        key = chunk_key[place]
        walker, step_, edge = _walk(lat, node, last_node[place], key)
        text, chunk, key = of_text[place][walker], of_place[place][walker], key[walker]
        with np.errstate(over="ignore"):
            u = _uniform(_mix(key + step_.astype(np.uint64)), 0x40000000)
        span = np.searchsorted(text, np.arange(n + 1)).tolist()
        log_q = lat.log_share[edge]
        with np.errstate(divide="ignore"):
            log_rest = np.log1p(-np.minimum(share[edge], 1.0))  # what a step's alternatives together leave
        log_u = np.log(-np.log(u))
        for (t, g), head in zip(jobs, heads, strict=True):
            a, b = span[t], span[t + 1]
            edges, of_chunk, before = (edge[:0], chunk[:0], 0.0) if head is None else head[:3]
            if head is not None:
                above, rest, pick, out, own_key = head[3]
                if rest > 0:
                    m = above + math.log(rest)
                    frontier[t].append((_below_one(g, m, _uniform_one(own_key, 4 * len(out) + 4)), m, len(samples[t]), len(edges) - 1, (*out, pick)))
            phi = before + np.cumsum(log_q[a:b])
            if b > a:
                left = log_rest[a:b] + before
                left[1:] += phi[:-1] - before
                late, want = log_u[a:b] - left, k - turn  # the perturbed maximum falls as this grows
                top = np.argpartition(late, want - 1)[:want] if len(late) > want else np.arange(len(late))
                top = top[np.isfinite(left[top])]
                value = left[top] - np.logaddexp(left[top] - g, log_u[a:b][top])
                for i, x in zip(top.tolist(), value.tolist(), strict=True):
                    frontier[t].append((x, float(left[i]), len(samples[t]), len(edges) + i, (int(edge[a + i]),)))
            samples[t].append((np.concatenate((edges, edge[a:b])), np.concatenate((of_chunk, chunk[a:b])), float(phi[-1]) if b > a else before, g))

    out = []
    for t in range(n):
        kappa = max((f[0] for f in frontier[t]), default=-np.inf)
        out.append([(_ids(model, lat, edges), lp, g, float(-np.expm1(-np.exp(min(lp - kappa, 700.0)))) if np.isfinite(kappa) else 1.0) for edges, _, lp, g in samples[t]])
    return out


def _ids(model: PieceModel, lat: Lattices, edges: np.ndarray) -> np.ndarray:
    ids = lat.piece[edges]
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids
    ids[bare] = np.where(ids[bare] >= -128, model.byte_ids[np.minimum(-1 - ids[bare], 127)], ids[bare])
    if (ids[bare] < 0).any():
        spelled: list[int] = []
        for i in ids.tolist():
            if i < 0:
                spelled.extend(model.byte_ids[list(chr(-1 - i).encode("utf-8", "surrogatepass"))].tolist())
            else:
                spelled.append(i)
        ids = np.array(spelled, np.int64)
    return ids


def sample_pieces(docs: DataFrame, model_file: str, k: int = 3, theta: float = 1.0, seed: int = 0, with_ids: bool = True) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of each whole text: one row each, and one row for a text without pieces.

    Columns: ``doc_id, sample`` (1 is the largest perturbed value), ``n_pieces, log_prob, perturbed, inclusion_prob, ids_crc32``
    (unsigned, little-endian unsigned 32-bit ids), ``decodes`` (decoding gives the text back) and, on request, ``ids``. A null or empty
    text has the empty segmentation alone, with probability and inclusion 1. A text with fewer than ``k`` segmentations returns all
    of them, each with inclusion 1. The row key is the id together with the text: rows that share both are sampled alike. The block
    character U+2581 in a text stands for a blank, as in the model, and so decodes to one. Other columns are ignored.
    """
    names = "doc_id string, sample int, n_pieces long, log_prob double, perturbed double, inclusion_prob double, ids_crc32 long, decodes boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = piece_model(model_file, theta)
        for b in batches:
            ends = np.searchsorted(np.cumsum(b["text"].str.len().to_numpy()), np.arange(1, 10**6) * BATCH_CHARS) + 1
            start = 0
            for stop in [*dict.fromkeys(int(x) for x in ends[ends < len(b)]), len(b)]:
                part, start = b.iloc[start:stop], stop
                if not len(part):
                    continue
                texts, rows = part["text"].tolist(), []
                found = sample_texts(model, texts, part["key"].to_numpy(np.int64).view(np.uint64), k)
                spelled = iter(model.spell_all([ids for own in found for ids, *_ in own]))
                for doc, text, own in zip(part["doc_id"], texts, found, strict=True):
                    want = text.replace(SPACE, " ").encode("utf-8", "surrogatepass")
                    for i, (ids, lp, g, inc) in enumerate(own):
                        rows.append((doc, i + 1, len(ids), lp, g, inc, zlib.crc32(ids.astype("<u4").tobytes()), next(spelled) == want, *([ids.tolist()] if with_ids else [])))
                cols = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion_prob", "ids_crc32", "decodes", *(["ids"] if with_ids else [])]
                yield pd.DataFrame(rows, columns=cols)

    text = F.coalesce("text", F.lit(""))
    # ids pass through pandas as strings: numbers beside nulls lose digits there
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(seed), "doc_id", text).alias("key"))
    return rows.mapInPandas(run, names).withColumn("doc_id", F.col("doc_id").cast("long"))


def decode_pieces(rows: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Add the text of an array of ids; null stays null, an empty array is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file, 1.0)
        for b in batches:  # Arrow columns, as they are: in pandas, numbers beside nulls would lose digits
            texts = [None if ids is None else model.decode(np.array(ids, np.int64)) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    kept = [f for f in rows.schema.fields if f.name != out_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out_col}` string"])
    return rows.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)
