"""Array kernels as higher-order functions: quantising, transforms, packing, label masks, coarsened divergences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def mean_abs(x: Column) -> Column:
    return total(F.transform(x, F.abs)) / F.size(x)


def trits(x: Column, scale: Column) -> Column:
    """Half-even rounding of ``x / scale`` to -1, 0 or 1."""
    return let(scale, lambda s: F.transform(x, lambda v: F.least(F.greatest(F.rint(v / s), F.lit(-1.0)), F.lit(1.0)).cast("int")))


def refit_scale(x: Column, q: Column) -> Column:
    """The least-squares scale for given codes, at least 1e-8."""
    return F.greatest(dot(x, q) / F.greatest(dot(q, q), F.lit(1.0)), F.lit(1e-8))


def exact_scale(x: Column) -> Column:
    """The best scale of a ternary code: magnitudes in falling order, the prefix that maximises ``sum^2 / n``, and its mean.

    A prefix adds only if its last magnitude is above half the mean, so one pass suffices.
    """
    mags = F.sort_array(F.transform(x, F.abs), asc=False)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(-1.0).alias("gain"), F.lit(0.0).alias("scale"))

    def step(a: Column, m: Column) -> Column:
        s, n = a["s"] + m, a["n"] + 1
        better = s * s / n > a["gain"]
        return F.struct(s.alias("s"), n.alias("n"), F.when(better, s * s / n).otherwise(a["gain"]).alias("gain"), F.when(better, s / n).otherwise(a["scale"]).alias("scale"))

    return F.aggregate(mags, start, step, lambda a: a["scale"])


def lerp(x: Column, y: Column, alpha: float) -> Column:
    return F.zip_with(x, y, lambda a, b: a + alpha * (b - a))


def hadamard(x: Column, n: int) -> Column:
    """The normalised Walsh-Hadamard transform of ``n`` values by log2(n) butterfly stages; it is its own inverse."""
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def stage(x: Column, half: int) -> Column:
        if half == n:
            return F.transform(x, lambda v: v / F.lit(float(n) ** 0.5))
        sums = F.transform(places, lambda i: F.when(i.bitwiseAND(F.lit(half)) == 0, F.get(x, i) + F.get(x, i + half)).otherwise(F.get(x, i - half) - F.get(x, i)))
        return let(sums, lambda y: stage(y, 2 * half))

    return let(x, lambda y: stage(y, 1))


def signed(x: Column, signs: Column) -> Column:
    """Values by a vector of signs, as before a transform that spreads outliers."""
    return F.zip_with(x, signs, lambda v, s: v * s)


def hadamard_at(x: Column, n: int, i: int) -> Column:
    """One coordinate of the transform."""
    signs = F.array(*[F.lit(1.0 if bin(i & j).count("1") % 2 == 0 else -1.0) for j in range(n)])
    return dot(x, signs) / F.lit(float(n) ** 0.5)


def pack_trits(q: Column, per_byte: int = 5) -> Column:
    """Five codes -1, 0, 1 to a byte, the first one lowest; a short last group is filled with code 0 (digit 1)."""


    def packed(q: Column) -> Column:
        groups = F.sequence(F.lit(0), F.ceil(F.size(q) / per_byte).cast("int") - 1)
        digit = lambda g, i: F.coalesce(F.get(q, g * per_byte + i), F.lit(0)) + 1
        full = F.transform(groups, lambda g: sum((digit(g, i) * 3**i for i in range(1, per_byte)), digit(g, 0)))
        return F.when(F.size(q) > 0, full).otherwise(F.array().cast("array<int>"))

    return let(q, packed)


def unpack_trits(packed: Column, n: Column, per_byte: int = 5) -> Column:
    spread = F.flatten(F.transform(packed, lambda b: F.array(*[(F.floor(b / 3**i) % 3).cast("int") - 1 for i in range(per_byte)])))
    return F.slice(spread, 1, n)


def pack_pairs(codes: Column) -> Column:
    """Four 2-bit codes to a byte, the first one lowest."""

    def packed(codes: Column) -> Column:
        groups = F.sequence(F.lit(0), F.ceil(F.size(codes) / 4).cast("int") - 1)
        at = lambda g, i: F.shiftleft(F.coalesce(F.get(codes, g * 4 + i), F.lit(0)), 2 * i)
        return F.transform(groups, lambda g: at(g, 0).bitwiseOR(at(g, 1)).bitwiseOR(at(g, 2)).bitwiseOR(at(g, 3)))

    return let(codes, packed)


def unpack_pairs(packed: Column, n: Column) -> Column:
    spread = F.flatten(F.transform(packed, lambda b: F.array(*[F.shiftright(b, 2 * i).bitwiseAND(F.lit(3)) for i in range(4)])))
    return F.slice(spread, 1, n)


def relative_error(x: Column, y: Column) -> Column:
    """Energy of the difference over the energy of ``x``."""
    d = F.zip_with(x, y, lambda a, b: a - b)
    return F.try_divide(dot(d, d), dot(x, x))


def mask_labels(ids: Column, prompt: Column, ignore: int = -100) -> Column:
    """Ids as labels with the prompt's places ignored."""
    n = F.least(prompt, F.size(ids))
    return F.concat(F.array_repeat(F.lit(ignore), n), F.when(n < F.size(ids), F.slice(ids, n + 1, F.size(ids))).otherwise(F.array().cast("array<int>")))


def supervised(labels: Column, ignore: int = -100) -> Column:
    return F.size(F.filter(labels, lambda v: v != ignore))


def first_supervised(labels: Column, ignore: int = -100) -> Column:
    return F.array_position(F.transform(labels, lambda v: v != ignore), True)


def supervised_to_the_end(labels: Column, ignore: int = -100) -> Column:
    """Whether the places that count are one run that reaches the end; false if none counts."""
    return (supervised(labels, ignore) > 0) & (first_supervised(labels, ignore) + supervised(labels, ignore) - 1 == F.size(labels))


def sampled_places(key: Column, size: Column, n: int) -> Column:
    """``n`` places of an array, from 0, drawn with replacement by hashes of key and number: the same for every run and candidate."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (F.conv(F.substring(F.sha2(F.concat_ws(":", key.cast("string"), j.cast("string")), 256), 1, 8), 16, 10).cast("long") % size).cast("int"))


def movement(base: Column, value: Column, base_scale: Column, scale: Column, places: Column) -> Column:
    """What happened at sampled places between two rows of weights with their scales: a struct of ``n``, ``flips`` (codes that differ),
    ``near`` (values within 0.01 of the threshold of a code), ``moved`` and ``moved2`` (sums of differences over scale, and of squares)."""
    pick = lambda x, s: F.transform(places, lambda i: F.get(x, i) / s)
    pairs = F.zip_with(pick(base, base_scale), pick(value, scale), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    code = lambda v: F.greatest(F.least(F.rint(v), F.lit(1.0)), F.lit(-1.0))
    count = lambda keep: F.size(F.filter(pairs, keep))
    summed = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p["b"] - p["a"]))
    return F.struct(
        F.size(places).alias("n"), count(lambda p: code(p["a"]) != code(p["b"])).alias("flips"), count(lambda p: F.abs(F.abs(p["b"]) - 0.5) < 0.01).alias("near"),
        summed(F.abs).alias("moved"), summed(lambda d: d * d).alias("moved2"),
    )


def is_partition(masks: Column, wanted: Column) -> Column:
    """Every wanted place has exactly one mask set, every other none; ``masks`` is an array of 0/1 arrays."""
    sums = F.aggregate(masks, F.transform(wanted, lambda _: F.lit(0)), lambda a, m: F.zip_with(a, m, lambda x, y: x + y))
    return F.forall(F.zip_with(sums, wanted, lambda s, w: s == w.cast("int")), lambda ok: ok)


def first_difference(x: Column, y: Column) -> Column:
    """Where two sequences part, from 1; 0 if they don't."""
    return F.array_position(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), True)


def differences(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), lambda d: d))


def run_lengths_max(x: Column) -> Column:
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        n = F.when(a["v"].eqNullSafe(v.cast("string")), a["n"] + 1).otherwise(1)
        return F.struct(v.cast("string").alias("v"), n.alias("n"), F.greatest(n, a["best"]).alias("best"))

    return F.aggregate(x, start, step, lambda a: a["best"])


def thin(x: Column, gap: float) -> Column:
    """Values at least ``gap`` from the last one kept."""
    first = F.slice(x, 1, 1)
    return F.aggregate(x, first, lambda kept, v: F.when(F.abs(v - F.element_at(kept, -1)) >= gap, F.concat(kept, F.array(v))).otherwise(kept))


def softmax_log(x: Column) -> Column:
    log_sum = lambda y, high: F.log(total(F.transform(y, lambda v: F.exp(v - high)))) + high
    return let(x, lambda y: let(let(F.array_max(y), lambda high: log_sum(y, high)), lambda n: F.transform(y, lambda v: v - n)))


def divergence(p_log: Column, q_log: Column) -> Column:
    """KL(p || q) of aligned log-probabilities."""
    return total(F.zip_with(p_log, q_log, lambda p, q: F.exp(p) * (p - q)))


def coarse_divergence(p_log: Column, q_log: Column, k: int) -> Column:
    """KL over the k likeliest entries of p and one tail of all others; the tails are exact complements."""
    top = F.slice(F.sort_array(F.zip_with(p_log, q_log, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), asc=False), 1, k)

    def summed(pairs: Column) -> Column:
        head = total(F.transform(pairs, lambda x: F.exp(x["p"]) * (x["p"] - x["q"])))
        tail = lambda name: F.greatest(F.lit(1.0) - total(F.transform(pairs, lambda x: F.exp(x[name]))), F.lit(1e-12))
        return head + tail("p") * (F.log(tail("p")) - F.log(tail("q")))

    return let(top, summed)


def surrogate(ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    """The clipped importance-ratio objective."""
    return F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)


def shifted_pairs(x: Column, y: Column) -> Column:
    """``(x[i + 1], y[i])``: labels against the positions that predict them."""
    n = F.greatest(F.least(F.size(x), F.size(y)) - 1, F.lit(0))
    return F.arrays_zip(F.slice(x, 2, n).alias("label"), F.slice(y, 1, n).alias("source"))


def strictly_sorted(x: Column) -> Column:
    """Distinct and ascending."""
    return F.forall(F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a < b), lambda ok: F.coalesce(ok, F.lit(False)))


def mass_error(p: Column, tail: Column) -> Column:
    """How far listed probabilities and the tail are from one."""
    return F.abs(total(p) + tail - 1)


def remainder_histogram(x: Column, modulus: int) -> Column:
    """How many values have the remainder 0, 1, ..., each at its place."""
    return F.transform(F.sequence(F.lit(0), F.lit(modulus - 1)), lambda r: F.size(F.filter(x, lambda v: F.pmod(v, F.lit(modulus)) == r)))


def summaries(groups: Column, values: Column, keys: list[str]) -> Column:
    """A map of each key to the sum of its values; null where the key is absent."""
    pairs = F.arrays_zip(groups.alias("k"), values.alias("v"))
    own = lambda key: F.filter(pairs, lambda p: p["k"] == key)
    value = lambda key: F.when(F.size(own(key)) > 0, total(F.transform(own(key), lambda p: p["v"])))
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[value(k) for k in keys]))


def swap_heads(x: Column, a: int, b: int, size: int) -> Column:
    """An array of ``a * b`` heads of ``size`` values, reordered from (a, b) to (b, a)."""
    order = [(i * b + j) * size + k for j in range(b) for i in range(a) for k in range(size)]
    return F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.get(x, i))


def delimiter_once_before(x: Column, delimiter: Column, other: Column) -> Column:
    """The delimiter occurs once, before the first ``other`` (which must occur)."""
    once = F.size(F.filter(x, lambda v: v == delimiter)) == 1
    return once & (F.array_position(x, other) > F.array_position(x, delimiter))


def span_mask(tokens: Column, spans: Column) -> Column:
    """For each ``(start, stop)`` token 2 inside a span, 1 if it overlaps one, else 0; ends are exclusive."""
    inside = lambda t: F.exists(spans, lambda s: (s["start"] <= t["start"]) & (t["stop"] <= s["stop"]))
    overlap = lambda t: F.exists(spans, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"]))
    return F.transform(tokens, lambda t: F.when(inside(t), 2).when(overlap(t), 1).otherwise(0))


def earlier_not_larger(x: Column) -> Column:
    """At each place how many earlier values aren't larger."""
    return F.transform(x, lambda v, i: F.size(F.filter(F.slice(x, F.lit(1), i), lambda e: e <= v)))


def next_larger(x: Column) -> Column:
    """At each place the next value that is larger; null if none."""
    return F.transform(x, lambda v, i: F.get(F.filter(F.slice(x, i + 2, F.size(x)), lambda e: e > v), F.lit(0)))


def block_reversed(x: Column, size: int) -> Column:
    """Blocks of ``size`` in order, each reversed."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(size))
    return F.flatten(F.transform(starts, lambda i: F.reverse(F.slice(x, i, size))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-probability of a place, from 0."""
    return let(logits, lambda x: -F.get(softmax_log(x), label.cast("int")))


def top_margin(x: Column) -> Column:
    """How far the largest value is above the second."""
    return let(F.sort_array(x, asc=False), lambda s: F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def argmax(x: Column) -> Column:
    """The first place of the largest value, from 0."""
    return F.array_position(x, F.array_max(x)).cast("int") - 1


def ternary_bits(n: Column, group: int, scale_bits: int, per_byte: int = 5) -> Column:
    """Bits per parameter of packed ternary codes with a scale for each group."""
    return F.try_divide(F.ceil(n / per_byte) * 8 + F.ceil(n / group) * scale_bits, n)


def gained(scale: Column, gain: Column) -> Column:
    return scale * F.exp(gain)
