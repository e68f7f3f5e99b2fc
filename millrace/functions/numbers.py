"""Number theory, floor rules and progress arithmetic: Arrow batches where Spark has no function, else Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _longs(*arrays: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where any value is null, and the values with nulls as 1."""
    null = np.zeros(len(arrays[0]), bool)
    for a in arrays:
        null |= np.asarray(a.is_null())
    return null, [np.asarray(a.cast(pa.int64()).fill_null(1)) for a in arrays]


@F.arrow_udf(T.LongType())
def _gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    null, (x, y) = _longs(a, b)
    return pa.array(np.gcd(x, y), mask=null)


@F.arrow_udf(T.LongType())
def _modular_power(base: pa.Array, exponent: pa.Array, modulus: pa.Array) -> pa.Array:
    null, (b, e, m) = _longs(base, exponent, modulus)
    null |= (m <= 0) | (m >= 2**31) | (e < 0)
    m = np.where(null, 1, m)
    out, square, e = np.ones_like(m) % m, b % m, np.where(null, 0, e)
    while e.any():
        out = np.where(e & 1, out * square % m, out)
        square, e = square * square % m, e >> 1
    return pa.array(out, mask=null)


@F.arrow_udf(T.LongType())
def _choose(n: pa.Array, k: pa.Array) -> pa.Array:
    null, (x, y) = _longs(n, k)
    pairs, at = np.unique(np.stack([x, y]), axis=1, return_inverse=True)
    each = [math.comb(i, j) if 0 <= j <= i and min(j, i - j) <= 10_000 else 0 if i >= 0 and not 0 <= j <= i else None for i, j in pairs.T.tolist()]
    each = [c if c is not None and c < 2**63 else None for c in each]
    return pa.array([None if bad else each[i] for i, bad in zip(at.ravel().tolist(), null.tolist(), strict=True)], pa.int64())


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs above -2**63, never negative."""
    return _gcd(a.cast("long"), b.cast("long"))


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if one of them is."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long")) * F.abs(F.call_function("div", b.cast("long"), F.nullif(gcd(a, b), F.lit(0)))))


def modular_power(base: Column, exponent: Column, modulus: Column) -> Column:
    """``base ** exponent % modulus`` by squaring, for moduli from 1 to below 2**31 and exponents from 0; null for others."""
    return _modular_power(base.cast("long"), exponent.cast("long"), modulus.cast("long"))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a long, exact; 0 for ``k`` outside 0..n, null for a negative ``n`` and where a long is too small for it."""
    return _choose(n.cast("long"), k.cast("long"))


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null for a zero divisor."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def floor_div(a: Column, b: Column) -> Column:
    """The quotient rounded down, of integers exactly; null for a zero divisor."""
    return F.call_function("div", a - floor_mod(a, b), F.nullif(b, F.lit(0)))


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """``(total - done) * elapsed / done``; null when nothing is done yet."""
    return F.try_divide((total - done) * elapsed, done)


def progress_line(done: Column, total: Column, eta: Column) -> Column:
    return F.concat_ws(" ", F.concat(done.cast("string"), F.lit("/"), total.cast("string")), F.coalesce(F.format_string("eta %d s", F.round(eta).cast("long")), F.lit("eta unknown")))
