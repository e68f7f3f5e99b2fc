"""Connected components by minimum labels and pointer jumping, in DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, durable


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(src, dst)`` edges to ``(node, component)``; a component's name is its smallest node.

    Every round takes the smallest label among a node's neighbours (a partially aggregated minimum, so a hub costs one
    row per task) and then jumps to the label's own label, which halves the remaining distance. Joins are sort-merge joins: label
    tables grow with the graph, and small ones are cheap either way. Null ends and loops are
    ignored; a node without edges isn't listed. Raises if the labels still move after ``max_rounds``.
    """
    pairs = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    both = durable(pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = durable(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")))
    for _ in range(max_rounds):
        heard = (
            both.join(labels.withColumnRenamed("node", "dst").hint("merge"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        lower = labels.join(heard.hint("merge"), "node").select(
            "node", F.col("component").alias("was"), F.least("component", "heard").alias("component")
        )
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        step = lower.join(roots.hint("merge"), "component", "left").select(
            "node", F.least("component", F.coalesce("root", "component")).alias("component"), "was"
        )
        seen, last = Observation(), labels
        labels = durable(step.observe(seen, F.count_if(F.col("component") != F.col("was")).alias("moved"))).select("node", "component")
        discard(last)
        if not seen.get["moved"]:
            discard(both)
            return labels
    raise RuntimeError(f"components still move after {max_rounds} rounds")
