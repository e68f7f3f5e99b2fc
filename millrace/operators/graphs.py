"""Reachability over edges of any number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, durable


def hops(steps: Sequence[DataFrame], sources: DataFrame, limit: int | None = None) -> DataFrame:
    """``(node, hops)``: the least number of edges from any source to each node that can be reached; sources have 0.

    ``steps`` are tables ``(src, dst)``, used in turn: one table for a plain graph; two for a graph of memberships (node to group, group to
    node), where a hop leads to the nodes that share a group and no pair of nodes is ever a row. Only nodes after a whole turn are given, and
    hops count turns. Each round joins the frontier with the edges, drops what is known, and is a table of its own; a node, or
    group, is expanded once. The search ends with an empty frontier, or after ``limit`` turns. Null ends are no nodes.
    """
    kinds = len(steps)
    edges = [e.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct() for e in steps]
    frontier = durable(sources.select(F.col(sources.columns[0]).alias("node")).where("node IS NOT NULL").distinct().withColumn("hops", F.lit(0)))
    # known[k]: tables of nodes of the k-th kind, one a round
    known: list[list[DataFrame]] = [[frontier], *[[] for _ in range(kinds - 1)]]
    turn = 0
    while (limit is None or turn < limit) and frontier.limit(1).count():
        turn += 1
        for k, own in enumerate(edges):
            into = (k + 1) % kinds
            found = frontier.join(own, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            for table in known[into]:
                found = found.join(table, "node", "left_anti")
            frontier = durable(found.withColumn("hops", F.lit(turn)))
            known[into].append(frontier)
            if len(known[into]) > 8:  # few tables to look into, however long the search
                merged = durable(_all(known[into][:-1]))
                discard(*known[into][:-1])
                known[into] = [merged, frontier]
    return _all(known[0])


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionAll(t)
    return out
