"""Scans whose state runs through rows in order, over keys of any size.

Rows are cut into ranges of (key, order), a cell each, so that a key with many rows spans many cells and many small keys share one. A
cell streams through a task in order, whatever it holds. What passes from cell to cell is one state for the key at its border: the
driver sees one short row a cell, never a row of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..storage import durable

#: Takes a state and a row's values to the next state and the row's result.
Step = Callable[[Any, tuple], tuple[Any, Any]]
EDGE = "cell int, first_key string, last_key string, one_key boolean, state string"
BATCH = 5000


def in_cells(df: DataFrame, by: Sequence[str], order: Sequence[str], n_cells: int | None = None) -> tuple[DataFrame, str]:
    """``df`` as a table with the number of each row's range of (by, order), and the name of that column.

    Rows with equal ``by`` and ``order`` share a cell. The bounds of ranges are sampled, so the rows are written once: a second
    evaluation would cut elsewhere.
    """
    name = X.free_name(df, "cell")
    keys = [*by, *order]
    cut = df.repartitionByRange(n_cells, *keys) if n_cells else df.repartitionByRange(*keys)
    return durable(cut.withColumn(name, F.spark_partition_id())), name


def streamed(rows: DataFrame, cell: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of each cell one after the other, in order."""
    return rows.repartition(cell).sortWithinPartitions(cell, *by, *order)


def _values(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _edges(rows: DataFrame, cell: str, by: Sequence[str], order: Sequence[str], values: Sequence[str], begin: Callable[[int, str, dict], Any], step: Step, carry: dict[int, tuple[str, Any]]) -> dict[int, tuple]:
    """Of each cell ``(first key, last key, whether they are one, state after the last row)``; ``carry`` gives states that cells begin with.

    ``begin(cell, key, carry)`` is the state before a key's first row in a cell.
    """

    place, key_name = X.free_name(rows, "scan_cell"), X.free_name(rows, "scan_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, first, key, state, one = [], None, None, None, None, True
        for c, k, *row in _values(batches, [place, key_name, *values]):
            if c != at:
                if at is not None:
                    out.append((at, first, key, one, repr(state)))
                at, first, key, one = c, k, k, True
                state = begin(c, k, carry)
            elif k != key:
                key, one, state = k, False, begin(c, k, carry)
            state, _ = step(state, tuple(row))
        if at is not None:
            out.append((at, first, key, one, repr(state)))
        names = ["cell", "first_key", "last_key", "one_key", "state"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    keyed = streamed(rows, cell, by, order).select(F.col(cell).alias(place), key_text(by).alias(key_name), *[f"`{v}`" for v in values])
    return {r.cell: (r.first_key, r.last_key, r.one_key, _read(r.state)) for r in keyed.mapInArrow(run, EDGE).collect()}


def _read(state: str) -> Any:
    import ast

    return ast.literal_eval(state)


def key_text(by: Sequence[str]) -> Column:
    """A key as text, nulls told apart."""
    return F.to_json(F.struct(*[F.col(f"`{b}`").alias(f"k{i}") for i, b in enumerate(by)], F.lit(1).alias("k")))


def _final(rows: DataFrame, cell: str, by: Sequence[str], order: Sequence[str], values: Sequence[str], name: str, kind: T.DataType, begin: Callable[[int, str, dict], Any], step: Step, carry: dict[int, tuple[str, Any]]) -> DataFrame:
    kept = [c for c in rows.columns if c != cell]
    place, key_name = X.free_name(rows, "scan_cell"), X.free_name(rows, "scan_key")
    ordered = streamed(rows, cell, by, order).select(*[f"`{c}`" for c in kept], F.col(cell).alias(place), key_text(by).alias(key_name))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != cell], T.StructField(name, kind)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = key = state = None
        for b in batches:
            out = []
            for c, k, *row in _values([b], [place, key_name, *values]):
                if c != at or k != key:
                    at, key, state = c, k, begin(c, k, carry)
                state, result = step(state, tuple(row))
                out.append(result)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, target.field(name).type)], names=[*kept, name])

    return ordered.mapInArrow(run, schema)


def fold(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], start: Any, step: Step, name: str, kind: T.DataType, n_cells: int | None = None) -> DataFrame:
    """``df`` with ``name``: the results of ``step`` over the rows of each key in order.

    States are Python literals (numbers, strings, tuples, None); the first is ``start``. Cells of one key are run side by side, each as
    if its key began there; then those whose true beginning differs are run again from it, until no state at a border changes. A
    fold that soon forgets where it began (thinning, debouncing, runs) takes two or three rounds; in the worst case a round settles
    one more cell of each key. ``order`` shouldn't repeat inside a key. Null keys are a key. No rows give no rows.
    """
    rows, cell = in_cells(df, by, order, n_cells)

    def begin(c: int, key: str, carry: dict) -> Any:
        return carry[c][1] if c in carry and carry[c][0] == key else start

    carry: dict[int, tuple[str, Any]] = {}
    edges = _edges(rows, cell, by, order, values, begin, step, carry)
    numbers = sorted(edges)
    while True:
        wanted = {b: (edges[b][0], edges[a][3]) for a, b in zip(numbers, numbers[1:], strict=False) if edges[a][1] == edges[b][0]}
        changed = [c for c in wanted if carry.get(c, (None, start))[1] != wanted[c][1]]
        carry |= {c: wanted[c] for c in changed}
        # a cell that holds more than one key passes on what its last key's own rows gave
        again = [c for c in changed if edges[c][2]]
        if not again:
            break
        edges |= _edges(rows.where(F.col(cell).isin(again)), cell, by, order, values, begin, step, carry)
    return _final(rows, cell, by, order, values, name, kind, begin, step, carry)


def thinned(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, gap: float, name: str = "kept", n_cells: int | None = None) -> DataFrame:
    """Adds whether a row is kept: the first of its key, and each one at least ``gap`` away from the last that was kept. Nulls are not."""

    def step(last: float | None, row: tuple) -> tuple[float | None, bool]:
        keep = row[0] is not None and (last is None or abs(row[0] - last) >= gap)
        return (row[0] if keep else last), keep

    return fold(df, by, order, [value], None, step, name, T.BooleanType(), n_cells)


def composed(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], start: Any, unit: Any, absorb: Callable[[Any, tuple], Any], applied: Callable[[Any, Any], Any], step: Step, name: str, kind: T.DataType, n_cells: int | None = None) -> DataFrame:
    """``fold`` for steps that compose: whatever its beginning, a cell acts on a state as one short summary.

    ``absorb(summary, row)`` extends a summary, from ``unit``; ``applied(summary, state)`` is the state after the summarised rows. The
    first pass summarises cells, the driver applies one summary a cell, the second pass fills rows in. Nothing is run a third time.
    """
    rows, cell = in_cells(df, by, order, n_cells)
    edges = _edges(rows, cell, by, order, values, lambda c, key, carry: unit, lambda state, row: (absorb(state, row), None), {})
    carry: dict[int, tuple[str, Any]] = {}
    before, end = None, start
    for c in sorted(edges):
        first, last, one, summary = edges[c]
        carry[c] = (first, end if before == first else start)
        before, end = last, applied(summary, carry[c][1] if one else start)
    return _final(rows, cell, by, order, values, name, kind, lambda c, key, carry: carry[c][1] if carry[c][0] == key else start, step, carry)


#: A map of (x, y) modulo m: x -> p x + q y, y -> r y.
Map = tuple[int, int, int]


def recurrence(df: DataFrame, by: Sequence[str], order: Sequence[str], factor: Column, addend: Column, growth: Column, start: int, modulus: int, name: str, n_cells: int | None = None) -> DataFrame:
    """Adds ``x`` of ``x, y = (factor x + addend y) mod m, (growth y) mod m``, from ``x = start`` and ``y = 1``, over the rows of each key.

    A row whose factor, addend or growth is null leaves the state as it is.
    """
    row_map = F.array(*[F.pmod(c.cast("long"), F.lit(modulus)) for c in (factor, addend, growth)])
    same = F.array(F.lit(1), F.lit(0), F.lit(1)).cast("array<long>")
    column = X.free_name(df, "map")
    mapped = df.withColumn(column, F.when(F.forall(row_map, lambda x: x.isNotNull()), row_map).otherwise(same))

    def absorb(first: Map, row: tuple) -> Map:
        p, q, r = row[0]
        return p * first[0] % modulus, (p * first[1] + q * first[2]) % modulus, r * first[2] % modulus

    def applied(by_map: Map, state: tuple[int, int]) -> tuple[int, int]:
        (p, q, r), (x, y) = by_map, state
        return (p * x + q * y) % modulus, r * y % modulus

    def step(state: tuple[int, int], row: tuple) -> tuple[tuple[int, int], int]:
        state = applied(row[0], state)
        return state, state[0]

    return composed(mapped, by, order, [column], (start % modulus, 1 % modulus), (1, 0, 1), absorb, applied, step, name, T.LongType(), n_cells).drop(column)


def congruential(df: DataFrame, by: Sequence[str], order: Sequence[str], factor: int, value: Column, start: int, modulus: int, name: str = "x", n_cells: int | None = None) -> DataFrame:
    """``x = (factor x + value) mod m``."""
    return recurrence(df, by, order, F.lit(factor), value, F.lit(1), start, modulus, name, n_cells)


def polynomial(df: DataFrame, by: Sequence[str], order: Sequence[str], base: int, value: Column, modulus: int, name: str = "x", n_cells: int | None = None) -> DataFrame:
    """Prefix values of the polynomial with the rows' values as coefficients: ``sum(v_i base^i) mod m``, ``i`` from 0 over rows that aren't null."""
    return recurrence(df, by, order, F.lit(1), value, F.lit(base), 0, modulus, name, n_cells)


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str, kind: T.DataType, n_cells: int | None = None) -> DataFrame:
    """Adds the last ``value`` that isn't null among the rows up to this one."""
    latest = lambda held, row: held if row[0] is None else row[0]

    def step(held: Any, row: tuple) -> tuple[Any, Any]:
        held = latest(held, row)
        return held, held

    return composed(df, by, order, [value], None, None, latest, lambda summary, state: state if summary is None else summary, step, name, kind, n_cells)
