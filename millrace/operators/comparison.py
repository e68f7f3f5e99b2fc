"""Two runs, two files, two configurations: what must be equal, and how far apart the rest may be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import durable


def differing_fields(a: str, b: str, fields: Sequence[str]) -> Column:
    """Names of the fields of two structs that differ, joined by commas; nulls are equal to nulls."""
    return F.concat_ws(",", *[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.lit(f)) for f in fields])


def tolerance(a: DataFrame, b: DataFrame, key: str, tokens: str, loss: str, limit: float) -> DataFrame:
    """One row: keys that one run lacks, keys whose token counts differ, the largest difference a token, and if all is within ``limit``."""
    sides = [df.select(key, F.col(tokens).alias(f"tokens_{s}"), F.col(loss).alias(f"loss_{s}")) for df, s in ((a, "a"), (b, "b"))]
    lone = F.col("tokens_a").isNull() | F.col("tokens_b").isNull()
    apart = F.abs(F.col("loss_a") - F.col("loss_b")) / F.greatest(F.col("tokens_a"), F.lit(1))
    out = sides[0].join(sides[1], key, "full_outer").agg(
        F.count("*").alias("n"), F.count_if(lone).alias("unmatched"), F.count_if(F.col("tokens_a") != F.col("tokens_b")).alias("tokens_differ"), F.coalesce(F.max(apart), F.lit(0.0)).alias("max_diff")
    )
    return out.withColumn("passed", (F.col("unmatched") == 0) & (F.col("tokens_differ") == 0) & (F.col("max_diff") <= limit))


def drift(df: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """How many values changed, and the largest and mean absolute difference."""
    d = F.abs(a - b)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~a.eqNullSafe(b)).alias("changed"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))


def parity(df: DataFrame, difference: Column, by: Sequence[str], mean_limit: float, p95_limit: float) -> DataFrame:
    """Mean and 95th percentile of a difference for each group, and if both are within their limits."""
    out = df.groupBy(*by).agg(F.avg(difference).alias("mean"), F.percentile(difference, 0.95).alias("p95"))
    return out.withColumn("passed", (F.col("mean") <= mean_limit) & (F.col("p95") <= p95_limit))


def hash_mismatches(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, problem)``: keys with different digests, and keys that one side lacks."""
    both = a.select(key, F.col(digest).alias("digest_a"), F.lit(True).alias("in_a")).join(b.select(key, F.col(digest).alias("digest_b"), F.lit(True).alias("in_b")), key, "full_outer")
    problem = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(~F.col("digest_a").eqNullSafe(F.col("digest_b")), "differs")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def chain_breaks(configs: DataFrame, files: DataFrame, manifests: DataFrame, path: str) -> DataFrame:
    """``(path, broken)``: configured paths whose digest isn't that of the file, or whose file isn't what the manifest says."""
    c, f, m = (df.select(path, F.col("digest").alias(name)) for df, name in ((configs, "config"), (files, "file"), (manifests, "manifest")))
    joined = c.join(f, path, "left").join(m, path, "left")
    broken = F.when(F.col("file").isNull(), "no_file").when(F.col("manifest").isNull(), "no_manifest").when(F.col("config") != F.col("file"), "config_file").when(F.col("file") != F.col("manifest"), "file_manifest")
    return joined.select(path, broken.alias("broken")).where("broken IS NOT NULL")


def complete(done: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """``(group, expected, have, complete)`` of every expected group, and of groups that nobody expects (expected 0)."""
    have = done.groupBy(group).agg(F.count("*").alias("have"))
    out = expected.select(group, "expected").join(have, group, "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("expected", "have")})
    return out.withColumn("complete", F.col("expected") == F.col("have"))


def prefix_of(log: DataFrame, plan: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """``(group, n, is_prefix)``: whether a group's logged values are the first ones of its plan, by their places from 1."""
    joined = log.select(group, place, value).join(plan.select(group, place, F.col(value).alias("planned")), [group, place], "left")
    return joined.groupBy(group).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col(value) == F.col("planned"), F.lit(False))).alias("is_prefix"))


def resumable(saved: DataFrame, current: DataFrame, key: str, config: str, steps: str) -> DataFrame:
    """``(key, same_values, same_order, resumable)``: whether maps of settings agree on every name, and lists of steps in their order."""
    both = saved.select(key, F.col(config).alias("saved_config"), F.col(steps).alias("saved_steps")).join(current.select(key, config, steps), key)
    names = F.array_union(F.map_keys("saved_config"), F.map_keys(config))
    values = F.forall(names, lambda n: F.try_element_at(F.col("saved_config"), n).eqNullSafe(F.try_element_at(F.col(config), n)))
    order = F.col("saved_steps").eqNullSafe(F.col(steps))
    return both.select(key, values.alias("same_values"), order.alias("same_order"), (values & order).alias("resumable"))


def revalidated(stored: DataFrame, accepted: str, verdict: Column) -> DataFrame:
    """Stored decisions with a corrected rule: the old one is kept as ``<accepted>_before``."""
    return stored.withColumn(f"{accepted}_before", F.col(accepted)).withColumn(accepted, F.coalesce(verdict, F.lit(False)))


def strict_and_normalised(df: DataFrame, answer: Column, gold: Column, by: Sequence[str]) -> DataFrame:
    """Correct answers as they are, by collapsed white space and case, and by words alone."""
    return agreement(df.select(*[F.col(f"`{c}`") for c in by], forms(answer).alias("_answer"), forms(gold).alias("_gold")), by, "_answer", "_gold")


def forms(text: Column) -> Column:
    """SHA-256 digests of a text as it is, by collapsed white space and case, and by words alone: 32 bytes each, whatever its length."""
    digest = lambda c: F.unhex(F.sha2(c, 256))
    return F.struct(digest(text).alias("strict"), digest(X.weak_norm(text)).alias("weak"), digest(X.norm(text)).alias("normalised"))


def agreement(df: DataFrame, by: Sequence[str], answer: str, gold: str) -> DataFrame:
    """Counts of equal ``forms`` in two columns; nulls are equal to nothing."""
    same = lambda k: F.count_if(F.coalesce(F.col(f"{answer}.{k}") == F.col(f"{gold}.{k}"), F.lit(False))).alias(k)
    return df.groupBy(*by).agg(F.count("*").alias("n"), same("strict"), same("weak"), same("normalised"))


def median_by(df: DataFrame, by: str, value: str, n_cells: int = 4096) -> DataFrame:
    """``(by, median)``: the exact median of a number, null for a group without any; no task holds a group's values.

    A group's range is cut into cells of equal width. Counts tell the cells of the middle one or two values, and only their distinct
    values are ranked; a cell with many is cut again.
    """
    group, v = X.free_name(df, "group"), X.free_name(df, "value")
    counts = durable(df.select(F.col(by).alias(group), F.col(value).cast("double").alias(v)).groupBy(group, v).agg(F.count(v).alias("c")))
    all_of = counts.groupBy(group).agg(F.sum("c").alias("n"))
    mine = F.col(group).eqNullSafe(F.col("of"))
    # of each wanted rank (from 0), what is left to search and how many values lie below it
    ranks = F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("rank")
    wanted = all_of.where("n > 0").select(F.col(group).alias("of"), ranks).distinct()
    left = counts.where(F.col("c") > 0).join(F.broadcast(wanted), mine).select(group, v, "c", "rank").withColumn("below", F.lit(0).cast("long"))
    while True:
        span = left.groupBy(group, "rank").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("values"))
        if span.where((F.col("values") > n_cells) & (F.col("low") < F.col("high"))).isEmpty():
            break
        ends = F.broadcast(span.select(F.col(group).alias("of"), F.col("rank").alias("of_rank"), "low", "high"))
        cell = F.when(F.col("low") < F.col("high"), F.least(F.floor((F.col(v) / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * n_cells), F.lit(n_cells - 1))).otherwise(F.lit(0).cast("long"))
        cells = left.join(ends, mine & (F.col("rank") == F.col("of_rank"))).select(group, v, "c", "rank", "below", cell.alias("cell"))
        per = cells.groupBy(group, "rank", "below", "cell").agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(group, "rank").orderBy("cell"))
        hit = per.withColumn("upto", F.col("below") + upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
        hit = hit.select(F.col(group).alias("of"), F.col("rank").alias("of_rank"), F.col("cell").alias("of_cell"), (F.col("upto") - F.col("c")).alias("under"))
        left = durable(cells.join(F.broadcast(hit), mine & (F.col("rank") == F.col("of_rank")) & (F.col("cell") == F.col("of_cell"))).select(group, v, "c", "rank", F.col("under").alias("below")))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(group, "rank").orderBy(v))
    middle = left.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    found = middle.groupBy(group).agg(F.avg(v).alias("median")).withColumnRenamed(group, "of")
    return all_of.join(found, mine, "left").select(F.col(group).alias(by), "median")


def recoverable(rejected: DataFrame, commits: DataFrame, tasks: DataFrame, raw: DataFrame, key: str, response: str, fields: Sequence[str]) -> DataFrame:
    """Rejected rows without a commit whose raw response is one JSON object with exactly the fields wanted (``parsed``), with their tasks."""
    parsed = F.from_json(X.unwrap_json(F.col(response)), "map<string,string>")
    left = rejected.join(commits, key, "left_anti").join(tasks, key).join(raw.select(key, response), key).withColumn("parsed", parsed)
    return left.where(F.col("parsed").isNotNull() & (F.array_sort(F.map_keys("parsed")) == F.array(*[F.lit(f) for f in sorted(fields)])))


def breaker(df: DataFrame, part: str, order: Sequence[str], failed: Column, limit: int) -> DataFrame:
    """Adds ``failures``, how many in a row up to here, and ``open``: a run of ``limit`` failures has occurred by now."""
    w = Window.partitionBy(part).orderBy(*order)
    wins = F.sum(F.when(F.coalesce(failed, F.lit(False)), 0).otherwise(1)).over(w)
    run = df.withColumn("streak", wins)
    count = F.sum(F.when(F.coalesce(failed, F.lit(False)), 1).otherwise(0)).over(Window.partitionBy(part, "streak").orderBy(*order))
    out = run.withColumn("failures", count).drop("streak")
    return out.withColumn("open", F.max(F.col("failures") >= limit).over(w))
