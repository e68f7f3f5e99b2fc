"""Merkle trees over ordered ranges of a table: digests that know order, and where two tables differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

#: Keys of a leaf, and children of a node.
WIDTH, FAN = 256, 64
#: The leaf of rows without a key.
NO_KEY = -(2**40)


def row_text(columns: Sequence[Column]) -> Column:
    """Values as text that no other row of values has: each with its length before it, nulls as ``~``."""
    say = [F.concat(F.length(s).cast("string"), F.lit(":"), s) for s in (c.cast("string") for c in columns)]
    return F.concat(*[F.coalesce(s, F.lit("~")) for s in say])


def _joined(key: str, digest: str) -> Column:
    """Digest of ``key=digest`` lines in the order of their keys; a leaf has ``WIDTH`` keys, a node ``FAN`` children."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(digest).alias("digest"))))
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["digest"])), "\n"), 256)


def merkle_tree(df: DataFrame, key: str, columns: Sequence[Column]) -> DataFrame:
    """``(level, node, digest, n_rows)`` of all nodes; level 0 has the leaves, the highest one root.

    ``key`` is a whole number that doesn't repeat; a leaf is a range of ``WIDTH`` keys, wherever the rows lie, so equal tables have equal
    trees however they are cut into files, and a change touches one node a level. The rows of a null key share a leaf of their own. Levels
    are written as they are built: each is ``FAN`` times smaller than the one below.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.sha2(row_text(columns), 256).alias("digest"))
    leaf = F.coalesce(F.floor(F.col("key") / WIDTH), F.lit(NO_KEY))
    below = durable(rows.groupBy(leaf.alias("node")).agg(_joined("key", "digest").alias("digest"), F.count("*").alias("n_rows")))
    tree, level = below.select(F.lit(0).alias("level"), "node", "digest", "n_rows"), 0
    while below.limit(2).count() > 1:
        level += 1
        # nodes -1 and 0 are their own parents, so the last two meet in a root 0
        last = below.where("node NOT IN (-1, 0)").limit(1).count() == 0
        up = below.withColumn("parent", F.lit(0).cast("long") if last else F.floor(F.col("node") / FAN))
        below = durable(up.groupBy(F.col("parent").alias("node")).agg(_joined("node", "digest").alias("digest"), F.sum("n_rows").alias("n_rows")))
        tree = tree.unionAll(below.select(F.lit(level).alias("level"), "node", "digest", "n_rows"))
    return tree


def changed_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(level, node, first_key, last_key)`` of nodes that differ between two trees, from the root down: only children of changed nodes
    are compared, so equal parts of the trees aren't looked at below the node that shows them equal."""
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    level = max((t for t in tops if t is not None), default=-1)
    out, parents = None, None
    while level >= 0:
        own = [t.where(F.col("level") == level).select("node", F.col("digest").alias(f"digest_{s}")) for t, s in ((a, "a"), (b, "b"))]
        if parents is not None:
            own = [t.withColumn("parent", F.floor(F.col("node") / FAN)).join(parents, "parent", "left_semi").drop("parent") for t in own]
        both = own[0].join(own[1], "node", "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        found = durable(both.select(F.lit(level).alias("level"), "node"))
        parents = found.select(F.col("node").alias("parent"))
        out = found if out is None else out.unionAll(found)
        # just below a root all nodes are compared: its children may have other numbers than the rest, and the lower tree begins there
        if level >= min((t for t in tops if t is not None), default=0):
            parents = None
        level -= 1
    if out is None:
        return a.select("level", "node", F.lit(0).cast("long").alias("first_key"), F.lit(0).cast("long").alias("last_key")).limit(0)
    keys = F.lit(WIDTH) * F.pow(F.lit(FAN), F.col("level")).cast("long")
    return out.select("level", "node", (F.col("node") * keys).alias("first_key"), (F.col("node") * keys + keys - 1).alias("last_key"))


def first_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(first_key, last_key, ranges)``: the first range of keys in which two tables differ, and how many do; no row if they are equal."""
    leaves = changed_nodes(a, b).where("level = 0")
    return leaves.agg(F.min("first_key").alias("first_key"), F.min("last_key").alias("last_key"), F.count("*").alias("ranges")).where("ranges > 0")
