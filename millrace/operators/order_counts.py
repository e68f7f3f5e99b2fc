"""Counts over pairs in order: earlier rows that aren't greater, inversions, the next greater value; for keys of any size.

A row lies in a cell of positions and a cell of values, both ranges of equal size. Pairs in different cells of both kinds are counted from
a table of cell counts, pairs that share a cell inside it. No pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..storage import durable
from . import scans

#: Cells of either kind at most; the table of counts of one key has the square of that many entries.
MOST_CELLS = 1024
#: Rows of a cell, as far as the number of cells goes: a task holds one or a few.
CELL_ROWS = 50_000


def _cells(df: DataFrame, n_cells: int | None) -> int:
    """As many cells as the rows want, and no fewer than shuffles have partitions."""
    return n_cells or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // CELL_ROWS))


def earlier_counts(key: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each element the elements of its key with a smaller place and a value not greater.

    Places that differ first at some bit differ there in one block of that bit's size: at each bit, blocks are put in the order of
    values, and elements of their right halves count those of the left ones before them.
    """
    counts = np.zeros(len(key), np.int64)
    by_value = np.lexsort((place, value, key))
    for bit in range(int(place.max(initial=0)).bit_length()):
        block = np.stack([key[by_value], place[by_value] >> (bit + 1)])
        order = by_value[np.lexsort((block[1], block[0]))]  # stable: values stay in order
        left = (place[order] >> bit) & 1 == 0
        before = np.cumsum(left)
        k, b = key[order], place[order] >> (bit + 1)
        new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (b[1:] != b[:-1]))))
        base = np.repeat((before - left)[new], np.diff(np.append(new, len(order))))
        counts[order[~left]] += (before - base)[~left]
    return counts


def _codes(column: pd.Series) -> np.ndarray:
    return pd.factorize(column, use_na_sentinel=False)[0].astype(np.int64)


def _dense(values: pd.Series) -> np.ndarray:
    """Ranks from 0, equal for equal values."""
    return np.unique(values.to_numpy(), return_inverse=True)[1].astype(np.int64)


def earlier_not_greater(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "earlier", n_cells: int | None = None) -> DataFrame:
    """Adds how many earlier rows of a row's key have a value that isn't greater; ``df`` may have no null order or value.

    ``order`` is a number that doesn't repeat inside a key. A task holds one cell, a share of 1 / ``n_cells`` of all rows.
    """
    n_cells = min(MOST_CELLS, _cells(df, n_cells))
    key = X.free_name(df, "pair_key")
    keyed = df.withColumn(key, scans.key_text(by))
    placed, p = scans.in_cells(keyed, [key], [order], n_cells)
    rows, v = scans.in_cells(placed, [key], [value], n_cells)
    extra = [X.free_name(rows, c) for c in ("inside", "across", "smaller")]

    def counted(cell: str, place: str, out: str):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            own = earlier_counts(_codes(part[key]), _dense(part[place]), _dense(part[value]))
            return part.assign(**{out: own})

        return run

    schema = lambda at, out: T.StructType([*at.schema.fields, T.StructField(out, T.LongType())])
    # pairs of one cell of positions, by position; then pairs of one cell of values in different cells of positions
    inside = rows.groupBy(p).applyInPandas(counted(p, order, extra[0]), schema(rows, extra[0]))
    both = inside.groupBy(v).applyInPandas(counted(v, p, extra[1]), schema(inside, extra[1]))

    counts = rows.groupBy(key, p, v).agg(F.count("*").alias("n"))
    wide = counts.groupBy(key).agg(F.count_distinct(p).alias("np"), F.count_distinct(v).alias("nv")).where("np > 1 AND nv > 1").select(key)

    def before(part: pd.DataFrame) -> pd.DataFrame:
        """Rows in smaller cells of both kinds: sums over a table of at most MOST_CELLS squared counts."""
        ps, at_p = np.unique(part[p].to_numpy(), return_inverse=True)
        vs, at_v = np.unique(part[v].to_numpy(), return_inverse=True)
        table = np.zeros((len(ps) + 1, len(vs) + 1), np.int64)
        table[at_p + 1, at_v + 1] = part["n"].to_numpy()
        sums = table.cumsum(0).cumsum(1)
        return part[[key, p, v]].assign(**{extra[2]: sums[at_p, at_v]})

    smaller = counts.join(wide, key, "left_semi").groupBy(key).applyInPandas(before, T.StructType([f for f in counts.schema.fields if f.name != "n"] + [T.StructField(extra[2], T.LongType())]))
    total = F.col(extra[0]) + F.col(extra[1]) + F.coalesce(F.col(extra[2]), F.lit(0))
    return both.join(smaller, [key, p, v], "left").select(*[f"`{c}`" for c in df.columns], total.alias(name))


def inversions(df: DataFrame, by: Sequence[str], order: str, value: str, n_cells: int | None = None) -> DataFrame:
    """``(by, n, inversions)``: pairs of a key whose earlier row has the greater value."""
    own = earlier_not_greater(df.select(*by, order, value), by, order, value, "earlier", n_cells)
    n = F.count("*")
    return own.groupBy(*by).agg(n.alias("n"), (F.expr("count(*) * (count(*) - 1) DIV 2") - F.sum("earlier")).cast("long").alias("inversions"))


def next_greater(df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "next", n_cells: int | None = None) -> DataFrame:
    """Adds the value of the next row of the key that is greater, null if there is none; ``df`` may have no null order or value.

    Inside a cell a stack finds it; only numbers go there, and rows get their answers by a join. Rows that find none look for the first later cell of their key whose greatest value is greater, from
    one such value a cell; there the answer is the least of the cell's running maxima above their own value, which rows and maxima
    find by one ordered scan.
    """
    key = X.free_name(df, "next_key")
    row = X.free_name(df, "next_row")
    n_cells = _cells(df, n_cells)
    keyed = df.withColumn(key, scans.key_text(by)).withColumn(row, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    rows, cell = scans.in_cells(keyed.select(key, F.col(order).alias("at"), F.col(value).cast("double").alias("v"), row), [key], ["at"], n_cells)
    kind = dict(df.dtypes)[value]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([key, "at"], kind="stable").reset_index(drop=True)
        v, k = part["v"].to_numpy(), _codes(part[key])
        found = np.full(len(part), -1, np.int64)
        record = np.zeros(len(part), bool)
        stack: list[int] = []
        best, last = -np.inf, -1
        for i in range(len(part)):
            if k[i] != last:
                stack, best, last = [], -np.inf, k[i]
            while stack and v[stack[-1]] < v[i]:
                found[stack.pop()] = i
            stack.append(i)
            if v[i] > best:
                record[i], best = True, v[i]
        nexts = pd.Series(np.where(found >= 0, v[found], np.nan)).where(found >= 0)
        return part.assign(found=found >= 0, next=nexts, record=record)

    numbers = rows.select(key, "at", "v", cell)
    schema = T.StructType([*numbers.schema.fields, T.StructField("found", T.BooleanType()), T.StructField("next", T.DoubleType()), T.StructField("record", T.BooleanType())])
    own = durable(numbers.groupBy(cell).applyInPandas(run, schema))
    # the greatest value of each key that goes on in another cell: one or two a cell
    tops = own.groupBy(key, cell).agg(F.max("v").alias("top"))
    many = tops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(cell).alias("cell"), "top"))).alias("tops")).where(F.size("tops") > 1)
    open_rows = own.where("NOT found").join(F.broadcast(many), key)  # keys that cross the border of a cell: fewer than cells
    target = F.get(F.filter("tops", lambda t: (t["cell"] > F.col(cell)) & (t["top"] > F.col("v"))), F.lit(0))["cell"]
    asked = open_rows.withColumn("target", target).where("target IS NOT NULL").select(key, "target", (-F.col("v")).alias("down"), F.lit(1).alias("side"), "at", F.lit(None).cast("double").alias("max"), F.col(cell).alias("own_cell"))
    answers = own.where("record").join(many.select(key), key, "left_semi").select(key, F.col(cell).alias("target"), (-F.col("v")).alias("down"), F.lit(0).alias("side"), "at", F.col("v").alias("max"), F.lit(-1).alias("own_cell"))
    # a row asks for values strictly above its own: at equal values rows come before maxima
    both = answers.unionAll(asked).withColumn("side", 1 - F.col("side"))
    seen = scans.carried(both, [key, "target"], ["down", "side", "at", "own_cell"], "max", "above", T.DoubleType(), n_cells)
    late = seen.where("own_cell >= 0").select(key, "at", F.col("above").alias("next"))
    # an order doesn't repeat inside a key: each row has one answer at most
    told = own.where("found").select(key, "at", "next").unionAll(late).select(F.col(key).alias("_k"), F.col("at").alias("_at"), "next")
    out = rows.select(key, "at", row).join(told, (F.col(key) == F.col("_k")) & (F.col("at") == F.col("_at")), "left")
    return out.select(f"{row}.*", F.col("next").cast(kind).alias(name))
