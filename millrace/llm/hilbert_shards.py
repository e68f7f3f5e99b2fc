"""Shards along a Hilbert curve through several metadata dimensions, so that files can be pruned by any of them.

Each dimension is cut into up to 64 steps of about equal numbers of rows, rows get the index of their cell on the curve, and the
order of these indexes is cut into runs whose row counts are at most one apart. Only DataFrame functions are used. Texts are read
once; everything after that works on a table of short rows. Ranks are sums of counts of curve sections, cells, parts of cells and the rows
of one part, so that no cell, however many rows share it, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, durable
from .page_links import bound

#: Bits of each dimension, curve indexes of a section, and rows that a part of a cell should hold.
BITS, SECTION, PART_ROWS = 6, 512, 1_000


def number_bin(x: Column) -> Column:
    """Whole numbers to about 4,000 steps that keep their order: the six highest bits and how many are left out. Null comes first."""
    size = F.abs(x.cast("double")).cast("long")
    left_out = F.greatest(F.length(F.bin(size)) - 6, F.lit(0))
    step = left_out * 32 + F.call_function("shiftright", size, left_out)
    return F.coalesce(F.when(x < 0, -step).otherwise(step), F.lit(-1_000_000)).cast("long")


def string_bin(x: Column, skip: int) -> Column:
    """The two bytes after the first ``skip``, which all strings share, as a number. Null comes first."""
    two = F.hex(F.substring(F.encode(x, "UTF-8"), skip + 1, 2))
    return F.coalesce(F.conv(F.rpad(two, 4, "0"), 16, 10).cast("long"), F.lit(-1))


def row_keys(dims: Sequence[str]) -> list[Column]:
    """128 bits of a row's id, text and dimensions."""
    parts = [x for c in ("doc_id", "text", *dims) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit("row"), *parts).alias("row_key"), F.xxhash64(F.lit("second"), *parts).alias("row_key2")]


def shared_prefix(low: str | None, high: str | None) -> int:
    """Bytes that the least and the greatest string, and so all between them, begin with."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def steps(counts: list[tuple[int, int]], total: int) -> tuple[list[int], list[int]]:
    """First bins of the steps and the steps' numbers: a bin's step is the share of rows in the bins before it."""
    first, number, before = [], [], 0
    for at, n in sorted(counts):
        step = (before << BITS) // total
        if not number or step > number[-1]:
            first.append(at)
            number.append(step)
        before += n
    return first, number


def step_of(at: Column, first: Sequence[int], number: Sequence[int]) -> Column:
    """The step (64 at most) that a bin falls into."""
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    return F.element_at(longs(number), F.size(F.filter(longs(first), lambda x: x <= at)))


def hilbert_index(axes: Sequence[Column], bits: int) -> Column:
    """The place on a Hilbert curve of a point whose coordinates are whole numbers of ``bits`` bits.

    The public algorithm by J. Skilling, "Programming the Hilbert curve" (2004): undo the rotations from the highest bit down, then
    take the Gray code and interleave its bits.
    """
    names = [f"x{i}" for i in range(len(axes))]
    packed = lambda values: F.struct(*[v.cast("long").alias(n) for n, v in zip(names, values, strict=True)])
    is_set = lambda x, k: x.bitwiseAND(k) != 0

    def unrotated(point: Column, bit: Column) -> Column:
        below = bit - 1
        head, *rest = [point[n] for n in names]
        head = F.when(is_set(head, bit), head.bitwiseXOR(below)).otherwise(head)
        out = []
        for x in rest:
            swap = head.bitwiseXOR(x).bitwiseAND(below)
            out.append(F.when(is_set(x, bit), x).otherwise(x.bitwiseXOR(swap)))
            head = F.when(is_set(x, bit), head.bitwiseXOR(below)).otherwise(head.bitwiseXOR(swap))
        return packed([head, *out])

    def gray(point: Column) -> Column:
        own = [point[names[0]]]
        for n in names[1:]:
            own.append(point[n].bitwiseXOR(own[-1]))
        return packed(own)

    def interleaved(point: Column) -> Column:
        turn = F.lit(0).cast("long")
        for k in range(1, bits):
            turn = turn.bitwiseXOR(F.when(is_set(point[names[-1]], F.lit(1 << k)), (1 << k) - 1).otherwise(0))

        def code(turn: Column) -> Column:
            out = F.lit(0).cast("long")
            for k in range(bits):
                for i, n in enumerate(names):
                    out = out + F.shiftleft(F.shiftright(point[n].bitwiseXOR(turn), k).bitwiseAND(1), (k + 1) * len(names) - 1 - i)
            return out

        return bound(turn, code)

    highest_first = F.array(*[F.lit(1 << k).cast("long") for k in range(bits - 1, 0, -1)])
    return bound(F.aggregate(highest_first, packed(axes), unrotated, gray), interleaved)


def curve_rows(docs: DataFrame, dims: Sequence[str]) -> tuple[DataFrame, int]:
    """``(row_key, row_key2, doc_id, size, text_crc32, copies, curve)``, equal rows as one, and how many rows there are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    own = [F.col(f"`{d}`").cast("string" if isinstance(kinds[d], T.StringType) else "double").alias(f"dim{i}") for i, d in enumerate(dims)]
    read = docs.select(*row_keys(dims), "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *own)
    short = rows = durable(read.groupBy(*read.columns).agg(F.count("*").alias("copies")))
    names = [f"dim{i}" for i in range(len(dims))]
    strings = [n for n, d in zip(names, dims, strict=True) if isinstance(kinds[d], T.StringType)]
    ends = rows.agg(F.sum("copies").alias("total"), *[f(n).alias(f"{n}_{f.__name__}") for n in strings for f in (F.min, F.max)]).first()
    total = ends["total"] or 0
    bins = [string_bin(F.col(n), shared_prefix(ends[f"{n}_min"], ends[f"{n}_max"])) if n in strings else number_bin(F.col(n)) for n in names]
    bins.append(number_bin(F.col("size")))
    axes = [f"axis{i}" for i in range(len(bins))]
    rows = rows.withColumns(dict(zip(axes, bins, strict=True))).drop(*names)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(a).alias("bin")) for i, a in enumerate(axes)])).alias("at")
    counts: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(axes))}
    for r in rows.select(each, "copies").groupBy("at").agg(F.sum("copies").alias("n")).collect():  # 65,537 bins of a dimension at most
        counts[r.at.axis].append((r.at.bin, r.n))
    for i, a in enumerate(axes):
        first, number = steps(counts[i], max(total, 1))
        rows = rows.withColumn(a, step_of(F.col(a), first, number) if first else F.lit(0).cast("long"))
    curve = durable(rows.withColumn("curve", hilbert_index([F.col(a) for a in axes], BITS)).drop(*axes))
    discard(short)
    return curve, total


def before(*by: str, order: str) -> Column:
    """Rows in all groups that come earlier."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def ranked_rows(rows: DataFrame, n_axes: int) -> DataFrame:
    """Adds ``first``, the rank of a row's first copy from 0, by curve, then by row key."""
    cells = rows.groupBy("curve").agg(F.sum("copies").alias("n")).withColumn("section", F.floor(F.col("curve") / SECTION))
    sections = cells.groupBy("section").agg(F.sum("n").alias("n"))  # 512 for three dimensions
    sections = sections.select("section", before(order="section").alias("section_before"))
    cells = cells.withColumn("cell_before", before("section", order="curve")).join(F.broadcast(sections), "section")
    cells = cells.select("curve", (F.col("section_before") + F.col("cell_before")).alias("cell_first"), F.ceil(F.col("n") / PART_ROWS).alias("n_parts"))
    part = F.shiftright(F.shiftrightunsigned("row_key", 33) * F.col("n_parts"), 31)
    # three dimensions have 262,144 cells, whatever the number of rows; more may have too many to broadcast
    parted = rows.join(F.broadcast(cells) if n_axes <= 3 else cells, "curve").withColumn("part", part)
    parts = parted.groupBy("curve", "part").agg(F.sum("copies").alias("n")).withColumn("part_before", before("curve", order="part"))
    inside = Window.partitionBy("curve", "part").orderBy("row_key", "row_key2").rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.join(parts.select("curve", "part", "part_before"), ["curve", "part"])
    return placed.withColumn("first", F.col("cell_first") + F.col("part_before") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))


def copies_placed(docs: DataFrame, n_shards: int, dims: Sequence[str]) -> tuple[DataFrame, str, str]:
    """Ranked rows, and SQL for the shard of a ``rank`` and the rank where a ``shard`` begins."""
    rows, total = curve_rows(docs, dims)
    return ranked_rows(rows, len(dims) + 1), f"CAST(rank * {n_shards} DIV {max(total, 1)} AS int)", f"(shard * {total}L + {n_shards - 1}) DIV {n_shards}"


def hilbert_shards(docs: DataFrame, n_shards: int = 40, dims: Sequence[str] = ("lang", "source")) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``.

    Dimensions are the columns ``dims``, strings or numbers, and ``size``, the UTF-8 bytes of the text plus 16. The law is ``rows``: the
    row counts of shards are at most one apart, so some shards are empty where there are fewer rows than shards. ``slot`` counts a
    shard's rows from 0 in the order of the curve; inside a cell rows stand in the order of a hash of id and text, so the same table
    gives the same shards however its files are cut. Equal texts need not share a shard: a group of copies may be larger than one.

    A null text counts as empty, with size 16 and checksum 0. Null metadata come first in their dimension. Null and repeated ids are
    rows like any other; rows with equal id and text are interchangeable and take one slot each. Other columns are ignored, whatever their
    names. An empty table gives an empty result. ``grown_shard`` is null: it belongs to another law.
    """
    placed, shard, begins = copies_placed(docs, n_shards, dims)
    ranks = placed.select("doc_id", "size", "text_crc32", "curve", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("rank"))
    return ranks.withColumn("shard", F.expr(shard)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - F.expr(begins)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, dims: Sequence[str] = ("lang", "source")) -> None:
    """The documents themselves, all columns, in a Parquet folder ``shard=N`` for each shard, each in the order of the curve.

    ``docs`` may have no column ``shard``. Repeated rows are numbered among themselves, so they too are dealt by rank.
    """
    placed, shard, _ = copies_placed(docs, n_shards, dims)
    rows = docs.select(*row_keys(dims), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"))
    copy = F.row_number().over(Window.partitionBy("row_key", "row_key2").orderBy(F.lit(0))) - 1
    firsts = placed.groupBy("row_key", "row_key2").agg(F.min(F.struct("first", "curve")).alias("at"))
    ranks = rows.withColumn("copy", copy).join(firsts, ["row_key", "row_key2"]).withColumn("rank", F.col("at.first") + F.col("copy"))
    dealt = ranks.withColumn("shard", F.expr(shard)).repartition("shard").sortWithinPartitions("shard", "rank")
    dealt.select("rest.*", "shard").write.mode("errorifexists").partitionBy("shard").parquet(path)
