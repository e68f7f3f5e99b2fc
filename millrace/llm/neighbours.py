"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node. The graph joins neighbours by angle and works on 8-bit codes, each scaled by its own vector, so that no large
vector makes the codes of others coarse. A round joins every node's neighbours, forward and reverse, with their codes, compares them
with each other where one of the two is new, and keeps each node's best. Queries start from their own node and from the nodes of largest
norm, which are near by inner product from far away, and expand the best nodes of their pool by inner product until all are expanded;
the pool's original vectors give the result in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import discard, settled

#: Nodes of a start block, on average; they are compared with each other.
BLOCK_NODES = 200
EDGE = "u long, w long, score float, fresh boolean"


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, raw, norm)``: little-endian doubles of the vectors that take part, shorter ones filled up with zeros."""
    v = F.col(vector_col).cast("array<double>")
    fine = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    dim = fine.agg(F.max(F.size("v"))).first()[0] or 0

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sizes = b["v"].str.len().to_numpy()
                x = np.zeros((len(b), dim), "<f8")
                x[np.arange(dim) < sizes[:, None]] = np.concatenate(b["v"].to_numpy()) + 0.0  # no negative zero
                with np.errstate(over="ignore"):
                    yield pd.DataFrame({"vec_id": b["vec_id"], "raw": [r.tobytes() for r in x], "norm": np.sqrt((x**2).sum(axis=1))})

    packed = fine.mapInPandas(pack, "vec_id long, raw binary, norm double")
    # Of several vectors of one id the smallest by its bytes stays.
    return packed.groupBy("vec_id").agg(F.min(F.struct("raw", "norm")).alias("one")).select("vec_id", "one.*")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Equally long binaries as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, offset=int(offsets[0]), count=(int(offsets[-1]) - int(offsets[0])) // np.dtype(kind).itemsize).reshape(len(column), -1)


def _codes(nodes: DataFrame, seed: int, trees: int, bits: int) -> DataFrame:
    """``(node, code, leaves)``: the code of each vector, and its cell of each random partition by angle.

    A code holds a byte for each component, relative to the vector's largest, then two 32-bit numbers: what makes the bytes a unit
    vector, and the logarithm of the norm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for b in batches:
            if not len(b):
                continue
            x = np.frombuffer(b"".join(b["raw"]), "<f8").reshape(len(b), -1)
            largest = np.abs(x).max(axis=1)
            whole = np.rint(x / largest[:, None] * 127)
            size = np.sqrt((whole**2).sum(axis=1))
            log_norm = np.log(largest) + 0.5 * np.log(((x / largest[:, None]) ** 2).sum(axis=1))
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(trees, x.shape[1], max(1, bits)))
            tail = np.stack((1 / size, log_norm), axis=1).astype("<f4")
            code = np.concatenate((whole.astype(np.int8).view(np.uint8), tail.view(np.uint8).reshape(len(b), 8)), axis=1)
            leaves = [((whole @ planes[t] > 0) @ (1 << np.arange(max(1, bits)))).tolist() for t in range(trees)]
            yield pd.DataFrame({"node": b["node"], "code": [c.tobytes() for c in code], "leaves": list(zip(*leaves, strict=True))})

    return nodes.mapInPandas(run, "node long, code binary, leaves array<long>")


def _units(codes: np.ndarray) -> np.ndarray:
    """Unit vectors of codes, the rows of a matrix of bytes."""
    tail = np.ascontiguousarray(codes[:, -8:]).view("<f4")
    return codes[:, :-8].view(np.int8).astype(np.float32) * tail[:, :1]


def _log_norms(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes[:, -4:]).view("<f4")[:, 0]


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The k best distinct edges of each node; an edge that was there before isn't fresh."""
    once = candidates.groupBy("u", "w").agg(F.max("score").alias("score"), F.bool_and("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("score"), "w"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _start(codes: DataFrame, k: int) -> DataFrame:
    """Edges inside the blocks of random partitions; a crowded cell is dealt to several blocks."""
    cells = codes.select("node", "code", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = cells.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
    blocks = cells.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / BLOCK_NODES)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["node"].to_numpy()
        x = _units(np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(ids), -1))
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        n = min(k, len(ids) - 1)
        if n < 1:
            return pd.DataFrame({"u": [], "w": [], "score": [], "fresh": []}).astype({"u": "int64", "w": "int64", "score": "float32", "fresh": bool})
        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return pd.DataFrame({"u": np.repeat(ids, n), "w": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel(), "fresh": True})

    return blocks.select("tree", "leaf", "part", "node", "code").groupBy("tree", "leaf", "part").applyInPandas(run, EDGE)


def _around(graph: DataFrame, k: int, turn: int) -> DataFrame:
    """``(v, member, fresh)``: forward neighbours and ``k`` reverse ones at most, drawn anew each turn."""
    back = graph.select(F.col("w").alias("v"), F.col("u").alias("member"), "fresh")
    draw = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("member", "v", F.lit(turn)), "member"))
    back = back.withColumn("draw", draw).where(F.col("draw") <= k).drop("draw")
    return graph.select(F.col("u").alias("v"), F.col("w").alias("member"), "fresh").unionByName(back).groupBy("v", "member").agg(F.bool_or("fresh").alias("fresh"))


def _descend(graph: DataFrame, codes: DataFrame, k: int, emit: int, turn: int) -> DataFrame:
    """One round: neighbours of a node become candidates of each other, at most ``emit`` of one node for one other."""
    floors = graph.groupBy("u").agg(F.min("score").alias("floor"), F.count("*").alias("n")).select(
        F.col("u").alias("member"), F.when(F.col("n") >= k, F.col("floor")).otherwise(float("-inf")).cast("float").alias("floor")
    )
    facts = codes.select(F.col("node").alias("member"), "code").join(floors, "member")
    met = _around(graph, k, turn).join(facts, "member").groupBy("v").agg(F.collect_list(F.struct("member", "fresh", "floor", "code")).alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = b.column(0)
            ends = met.offsets.to_numpy()
            rows = met.values
            ids, fresh, floor = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            code = _units(_matrix(rows.field(3), "u1"))
            u, w, score = [], [], []
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                new = fresh[a:z]
                if z - a < 2 or not new.any():
                    continue
                own, x = ids[a:z], code[a:z]
                s = x @ x.T
                np.fill_diagonal(s, -np.inf)
                s[~((new[:, None] | new) & (s > floor[a:z, None]))] = -np.inf
                n = min(emit, z - a - 1)
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                best = np.take_along_axis(s, top, 1)
                i, j = np.nonzero(best > -np.inf)
                u.append(own[i]), w.append(own[top[i, j]]), score.append(best[i, j])
            if u:
                u, w, score = np.concatenate(u), np.concatenate(w), np.concatenate(score)
                # a node meets the same candidate at several neighbours; once per batch is enough
                order = np.lexsort((w, u))
                u, w, score = u[order], w[order], score[order]
                once = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))
                yield pa.RecordBatch.from_arrays([pa.array(u[once]), pa.array(w[once]), pa.array(score[once].astype(np.float32)), pa.array(np.ones(len(once), bool))], names=["u", "w", "score", "fresh"])

    found = met.select("met").mapInArrow(run, EDGE)
    return _best(graph.withColumn("fresh", F.lit(False)).unionByName(found), k)


def nn_descent(codes: DataFrame, k: int, rounds: int, emit: int, stop_share: float) -> DataFrame:
    """``(u, w, score, fresh)``: the neighbour graph; ends early when a round replaces fewer than ``stop_share`` of the edges."""
    graph = settled(_best(_start(codes, k), k))
    for turn in range(rounds):
        seen, last = Observation(), graph
        graph = settled(_descend(graph, codes, k, emit, turn).observe(seen, F.count_if("fresh").alias("fresh"), F.count(F.lit(1)).alias("all")))
        discard(last)
        if seen.get["fresh"] <= stop_share * max(1, seen.get["all"]):
            break
    return graph


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, seeds: list[int], k: int, pool: int, expand: int, rounds: int) -> DataFrame:
    """``(q, node)``: the pools of a greedy search from each query's own node and the ``seeds``, ``expand`` open nodes a round.

    ``queries`` and ``seeds`` are nodes. A pool row is ``(node, score, open)``; nodes that were dropped may come back, but only with the
    same score. Ends when no node of a pool is open, or after ``rounds`` rounds, whatever is open then.
    """
    near = settled(_around(graph, k, 0).select("v", F.col("member").alias("node")))
    asked = queries.select(F.col("node").alias("q")).join(codes.select(F.col("node").alias("q"), F.col("code").alias("q_code")), "q")

    def scored(pairs: DataFrame) -> DataFrame:
        """Codes join twice, and each pair is scored by itself: the larger the inner product, the larger the score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    own, other = _matrix(b.column(2), "u1"), _matrix(b.column(3), "u1")
                    cos = np.einsum("ij,ij->i", _units(own), _units(other)).astype(np.float64)
                    # Of norms only their order matters, and their product with the cosine may not overflow.
                    s = np.sign(cos) * np.exp(np.clip((np.log(np.maximum(np.abs(cos), 1e-12)) + _log_norms(other)) / 16, -80, 80))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["q", "node", "score"])

        return pairs.join(codes.select("node", "code"), "node").join(asked, "q").select("q", "node", "q_code", "code").mapInArrow(run, "q long, node long, score double")

    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "node")
    own = queries.select(F.col("node").alias("q"))
    first = own.join(near.withColumnRenamed("v", "q"), "q").select("q", "node").union(own.withColumn("node", F.explode(F.array(*[F.lit(x) for x in seeds]).cast("array<long>"))).where("q <> node")).distinct()
    pools = settled(scored(first).withColumn("open", F.lit(True)))
    for _ in range(rounds):
        best_open = Window.partitionBy("q", "open").orderBy(F.desc("score"), "node")
        marked = pools.withColumn("turn", F.col("open") & (F.row_number().over(best_open) <= expand))
        reached = marked.where("turn").select("q", F.col("node").alias("v")).join(near, "v").where(F.col("node") != F.col("q")).select("q", "node").distinct()
        fresh = scored(reached.join(pools.select("q", "node"), ["q", "node"], "left_anti")).withColumn("open", F.lit(True))
        merged = marked.select("q", "node", "score", (F.col("open") & ~F.col("turn")).alias("open")).unionByName(fresh)
        seen, last = Observation(), pools
        kept = merged.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= pool).drop("rank")
        pools = settled(kept.observe(seen, F.count_if("open").alias("open")))
        discard(last)
        if not seen.get["open"]:
            break
    return pools.select("q", "node")


def nearest(
    table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20,
    neighbours: int = 32, rounds: int = 6, emit: int = 6, trees: int = 3, pool: int = 240, expand: int = 40, hops: int = 40, seeds: int = 32, seed: int = 0,
) -> DataFrame:
    """Each query's ``top`` rows of largest inner product, itself excluded: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on ``vec_id``; every other row is a candidate, and queries are candidates of each other. Scores are
    inner products of the original vectors in double precision; equal scores rank by the smaller id. Vectors that are null or zero or
    hold null or non-finite components take no part, nor do rows without an id; shorter vectors count as filled up with zeros. Equal
    vectors share a node, whose smallest ids are listed, as many as a result can hold. Of rows that repeat an id the one with the
    smallest bytes counts. With at most ``top`` candidates all are returned; an empty table gives no rows. Other columns are ignored.
    """
    valid = settled(usable_vectors(table, id_col, vector_col))
    rank = F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))
    first = valid.groupBy("raw").agg(F.min("vec_id").alias("node"), F.max("norm").alias("norm"))
    first = settled(first)
    few = valid.select("vec_id", "raw").withColumn("n", rank).where(F.col("n") <= top + 1)
    members = settled(few.join(first, "raw").select("node", "vec_id"))
    n = first.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n) / BLOCK_NODES))))
    codes = settled(_codes(first.select("node", "raw"), seed, trees, bits))
    graph = nn_descent(codes, neighbours, rounds, emit, 0.02)

    asked = valid.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("raw").alias("q_raw"))
    at = settled(asked.join(first.select(F.col("raw").alias("q_raw"), F.col("node").alias("q")), "q_raw"))
    longest = [r["node"] for r in first.orderBy(F.desc("norm"), "node").select("node").limit(seeds).collect()]  # so many ids at most
    found = search(graph, codes, at.select(F.col("q").alias("node")).distinct(), longest, neighbours, max(pool, top), expand, hops)
    found = found.union(at.select("q", F.col("q").alias("node")).distinct())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (_matrix(b.column(2), "<f8") * _matrix(b.column(3), "<f8")).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["q", "node", "score"])

    raw = first.select("node", "raw")
    own = raw.select(F.col("node").alias("q"), F.col("raw").alias("q_raw"))
    scores = found.join(raw, "node").join(own, "q").select("q", "node", "q_raw", "raw").mapInArrow(exact, "q long, node long, score double")
    best_nodes = scores.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))).where(F.col("n") <= top + 1)
    listed = at.select("query_id", "q").join(best_nodes, "q").join(members, "node").where(F.col("vec_id") != F.col("query_id"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", order).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
