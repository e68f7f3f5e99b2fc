"""Quotas, interleaving, strata and reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import durable


#: Values of an ordering key that share a cell, and cells that share the next larger one, when ranks are taken level by level.
CELL = 4096


def ranked(df: DataFrame, group: str | None, order: str, cell: int = CELL) -> DataFrame:
    """Adds ``rank``, from 1, and ``size`` of the group, by a whole-numbered ``order`` that doesn't repeat inside the group.

    Ranks are taken inside cells of the order. Cells are counted, ``CELL`` of them make a larger cell, and so on until a few are left,
    so that no window holds more than ``CELL`` rows of a group, however sparse its keys are.
    """
    by = [group] if group else []
    celled = df.withColumn("rank_cell", F.floor(F.col(order) / cell))
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    span = 0 if ends["low"] is None else (ends["high"] - ends["low"]) // cell
    levels = [celled.groupBy(*by, "rank_cell").agg(F.count("*").alias("rank_n"))]
    while span >= CELL:
        span //= CELL
        levels.append(levels[-1].groupBy(*by, F.floor(F.col("rank_cell") / CELL).alias("rank_cell")).agg(F.sum("rank_n").alias("rank_n")))
    before = lambda w: F.coalesce(F.sum("rank_n").over(w.orderBy("rank_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = Window.partitionBy(*by)  # CELL + 1 rows of a group at most
    sums = levels[-1].withColumns({"rank_before": before(top), "size": F.sum("rank_n").over(top)})
    for counts in levels[-2::-1]:
        inner = counts.withColumn("rank_above", F.floor(F.col("rank_cell") / CELL)).withColumn("rank_in", before(Window.partitionBy(*by, "rank_above")))
        above = sums.select(*[F.col(b).alias(f"rank_{b}") for b in by], F.col("rank_cell").alias("rank_top"), F.col("rank_before").alias("rank_base"), "size")
        sums = inner.join(above, _same(by, "rank_above", "rank_top")).withColumn("rank_before", F.col("rank_base") + F.col("rank_in"))
    sums = sums.select(*[F.col(b).alias(f"rank_{b}") for b in by], F.col("rank_cell").alias("rank_at"), "rank_before", "size")
    inside = F.row_number().over(Window.partitionBy(*by, "rank_cell").orderBy(order))
    out = celled.withColumn("rank", inside).join(sums, _same(by, "rank_cell", "rank_at")).withColumn("rank", F.col("rank") + F.col("rank_before"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "rank", "size")


def _same(by: Sequence[str], cell: str, other: str) -> Column:
    same = F.col(cell) == F.col(other)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"rank_{b}"))
    return same


def equally_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """Up to ``n`` rows at ranks spaced evenly from the first to the last."""
    at, size = F.col("rank") - 1, F.col("size")
    k = F.ceil(at * (n - 1) / F.greatest(size - 1, F.lit(1)))
    taken = (F.floor(k * (size - 1) / (n - 1)) == at) & (k <= n - 1)
    return ranked(df, None, order).where(taken).drop("rank", "size")


def strided(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every ``max(1, size div n)``-th row, ``n`` at most."""
    at, stride = F.col("rank") - 1, F.greatest(F.lit(1), F.floor(F.col("size") / n))
    return ranked(df, None, order).where((at % stride == 0) & (F.floor(at / stride) < n)).drop("rank", "size")


def quota(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: Column | int) -> DataFrame:
    """The first ``n`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    name = X.free_name(df, "rank")
    return df.withColumn(name, rank).where(F.col(name) <= n).drop(name)


def quota_shortfall(df: DataFrame, quotas: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(group, quota, have, missing)`` of groups below their quota; groups without rows have none."""
    return quota_balance(df, quotas, group).where("missing > 0")


def quota_balance(df: DataFrame, quotas: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(group, quota, have, missing)`` of all groups: a surplus is a negative ``missing``, and unplanned groups have the quota 0."""
    have = df.groupBy(*group).agg(F.count("*").alias("have"))
    out = quotas.join(have, list(group), "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quota", "have")})
    return out.withColumn("missing", F.col("quota") - F.col("have"))


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``turn``: rows sorted by (turn, group) go round the groups. ``order`` is a whole number that doesn't repeat in a group."""
    return ranked(df, group, order).drop("size").withColumnRenamed("rank", "turn")


def evenly_spaced(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Up to ``n`` rows of each group at places ``floor(k * size / n)``."""
    at, size = F.col("rank") - 1, F.col("size")
    # place k is at floor(k*size/n): the row is taken if some k falls on it
    k = F.ceil(at * n / size)
    return ranked(df, group, order).where((k < n) & (F.floor(k * size / n) == at)).drop("rank", "size")


def hash_sample(df: DataFrame, key: Column, n: int, salt: str = "") -> DataFrame:
    name = X.free_name(df, "order")
    return df.withColumn(name, X.hash_order(key, salt)).orderBy(name).limit(n).drop(name)


def nearest_by(df: DataFrame, targets: Sequence[float], value: str, target: str, id_col: str, n: int, used: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows nearest to each of a few targets, ties to the smaller id, without those whose ids are ``used`` already.

    Adds ``target`` and ``rank``. Each task keeps ``n`` rows of a target before they are shuffled.
    """
    left = df if used is None else df.join(used.select(id_col), id_col, "left_anti")
    away = F.abs(F.col(value) - F.col(target))
    rank = F.row_number().over(Window.partitionBy(target).orderBy(away, id_col))
    return left.withColumn(target, F.explode(F.array(*[F.lit(t) for t in targets]))).withColumn("rank", rank).where(F.col("rank") <= n)


def claimed_nearest(df: DataFrame, targets: Sequence[float], value: str, target: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows nearest to each of a few targets, no row for two of them: earlier targets choose first, ties go to the smaller id.

    Adds ``target`` and ``rank``. Targets claim the nearest rows that haven't turned them down, and a row keeps its earliest claimant,
    until no claim is turned down (deferred acceptance). A target can lose at most ``n`` rows to each earlier one, so the
    ``n * len(targets)`` nearest rows of each, found by a top list a task, are all that the rounds need.
    """
    near = nearest_by(df, targets, value, target, id_col, n * len(targets)).drop("rank")
    place = F.create_map(*[x for i, t in enumerate(targets) for x in (F.lit(t), F.lit(i))])
    order = [F.abs(F.col(value) - F.col(target)), F.col(id_col)]
    left = durable(near.withColumn("claim_place", place[F.col(target)]))
    while True:
        claims = left.withColumn("rank", F.row_number().over(Window.partitionBy(target).orderBy(*order))).where(F.col("rank") <= n)
        kept = F.min("claim_place").over(Window.partitionBy(id_col))
        refused = durable(claims.withColumn("claim_kept", kept).where("claim_place > claim_kept").select(id_col, target))
        if not refused.limit(1).count():
            return claims.drop("claim_place")
        left = durable(left.join(refused, [id_col, target], "left_anti"))


def language_slots(df: DataFrame, group: str, order: str, slots: Sequence[str], fallback: str | None = None) -> DataFrame:
    """Adds ``slot``: a repeating plan of groups. ``order`` is a whole number that doesn't repeat in a group.

    A group without rows of its own gives its places to ``fallback``, if there is one; a group with fewer rows than places ends early.
    """
    present = df.select(group).distinct().where(F.col(group).isin(*dict.fromkeys(slots)))
    if fallback is not None:
        have = {r[0] for r in present.collect()}  # as many as the plan names, at most
        slots = [s if s in have else fallback for s in slots]
    plan = {g: [i for i, s in enumerate(slots) if s == g] for g in dict.fromkeys(slots)}
    at, slot = F.col("rank") - 1, F.lit(None).cast("long")
    for g, places in plan.items():
        own = F.floor(at / len(places)) * len(slots) + F.element_at(F.array(*[F.lit(p) for p in places]), (at % len(places) + 1).cast("int"))
        slot = F.when(F.col(group) == g, own).otherwise(slot)
    return ranked(df, group, order).withColumn("slot", slot).where(F.col("slot").isNotNull()).drop("rank", "size")


def recycled_slots(df: DataFrame, group: str, id_col: str, slots: Sequence[str], n: int, seed: str, fallback: str | None = None) -> DataFrame:
    """``n`` slots of a repeating plan of groups, all filled: ``(slot, cycle, group, id)``. A group that runs out begins anew.

    Each pass (``cycle``) through a group has an order of its own, by hash of seed, cycle and id, so that a group's rows come again only
    after all of them have come. A group without rows gives its places to ``fallback``. ``id_col`` is a whole number that doesn't repeat.
    """
    sizes = {r[group]: r["count"] for r in df.where(F.col(group).isin(*dict.fromkeys([*slots, *([fallback] if fallback is not None else [])]))).groupBy(group).count().collect()}
    plan = [s if s in sizes else fallback for s in slots]
    out = None
    for g in dict.fromkeys(x for x in plan if x in sizes):
        places, size = [i for i, s in enumerate(plan) if s == g], sizes[g]
        wanted = n // len(plan) * len(places) + sum(p < n % len(plan) for p in places)
        cycles = -(-wanted // size)
        own = df.where(F.col(group) == g).select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(0), F.lit(max(cycles - 1, 0)))).alias("cycle"))
        # ranks by 40 bits of a hash, then by id, level by level: a group may hold most rows
        key = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "cycle", "id"), 256), 1, 10), 16, 10).cast("long")
        hashed = own.withColumn("key", key)
        crowd = F.row_number().over(Window.partitionBy("cycle", "key").orderBy("id")) - 1  # equal hashes, which are rare
        place = ranked(hashed.withColumn("key", F.col("key") * 1024 + crowd), "cycle", "key", cell=2**30)
        at = F.col("cycle").cast("long") * size + F.col("rank") - 1
        slot = F.floor(at / len(places)) * len(plan) + F.element_at(F.array(*[F.lit(p).cast("long") for p in places]), (at % len(places) + 1).cast("int"))
        filled = place.where(at < wanted).select(slot.alias("slot"), "cycle", F.lit(g).alias(group), "id")
        out = filled if out is None else out.unionAll(filled)
    return out if out is not None else df.select(F.lit(0).cast("long").alias("slot"), F.lit(0).alias("cycle"), group, F.col(id_col).alias("id")).limit(0)
