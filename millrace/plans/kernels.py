"""Array kernels over vectors, one vector a group of weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import table
from .registry import query

X = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
MEAN = "list_avg(list_transform(x, lambda v: abs(v)))"
Q = "list_transform(x, lambda v: CAST(least(greatest(round_even(v / ({s}), 0), -1), 1) AS INTEGER))"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("x"))


def coded(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("s", A.mean_abs(F.col("x"))).withColumn("q", A.trits(F.col("x"), F.col("s")))


CODED = f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings), m AS (SELECT vec_id, x, {MEAN} AS s FROM e), c AS (SELECT vec_id, x, s, {Q.format(s='s')} AS q FROM m) "
PACK = "list_transform(generate_series(0, (len(q) + 4) // 5 - 1), lambda g: CAST(list_sum(list_transform(generate_series(0, 4), lambda i: (coalesce(q[g * 5 + i + 1], 0) + 1) * CAST(pow(3, i) AS INTEGER))) AS INTEGER))"


@query(CODED + "SELECT vec_id, list_sum(list_transform(q, lambda v: abs(v)))::BIGINT AS nonzero, array_to_string(q, ',') AS codes FROM c")
def quantize_trits(spark, sf_dir):
    return coded(spark, sf_dir).select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + F.abs(v)).alias("nonzero"), F.array_join("q", ",").alias("codes"))


@query(f"""WITH e AS (SELECT vec_id, {X} AS x FROM embeddings), v AS (SELECT vec_id, unnest(list_reverse_sort(list_transform(x, lambda v: abs(v)))) AS m, generate_subscripts(x, 1) AS n FROM e),
p AS (SELECT vec_id, n, sum(m) OVER (PARTITION BY vec_id ORDER BY n) AS s FROM v) SELECT vec_id, round(arg_max(s / n, s * s / n), 9) AS scale FROM p GROUP BY 1""")
def exact_scale(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(A.exact_scale(F.col("x")), 9).alias("scale"))


def _iterations(n: int) -> str:
    steps = [f"e AS (SELECT vec_id, {X} AS x FROM embeddings)", f"s0 AS (SELECT vec_id, x, 1.3 * {MEAN} AS s FROM e)"]
    for i in range(n):
        steps.append(f"q{i} AS (SELECT vec_id, x, {Q.format(s='s')} AS q FROM s{i})")
        steps.append(f"s{i + 1} AS (SELECT vec_id, x, greatest(list_dot_product(x, q::DOUBLE[]) / greatest(list_dot_product(q::DOUBLE[], q::DOUBLE[]), 1), 1e-8) AS s FROM q{i})")
    return "WITH " + ", ".join(steps) + f" SELECT vec_id, round(s, 9) AS scale FROM s{n}"


@query(_iterations(8))
def iterative_scale(spark, sf_dir):
    df = vectors(spark, sf_dir).withColumn("s", 1.3 * A.mean_abs(F.col("x")))
    for _ in range(8):
        df = df.withColumn("q", A.doubles(A.trits(F.col("x"), F.col("s")))).withColumn("s", A.refit_scale(F.col("x"), F.col("q")))
    return df.select("vec_id", F.round("s", 9).alias("scale"))


@query(f"""WITH e AS (SELECT vec_id, {X} AS x FROM embeddings) SELECT vec_id, """ + ", ".join(f"round(list_sum(list_transform(generate_series(0, 63), lambda j: x[j + 1] * (CASE WHEN bit_count({i} & j) % 2 = 0 THEN 1 ELSE -1 END))) / 8, 9) AS y{i}" for i in (0, 7, 63)) + ", round(list_sum(list_transform(generate_series(0, 63), lambda i: (i + 1) * list_sum(list_transform(generate_series(0, 63), lambda j: x[j + 1] * (CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END))))) / 8, 6) AS weighted FROM e")
def hadamard64(spark, sf_dir):
    y = vectors(spark, sf_dir).select("vec_id", A.hadamard(F.col("x"), 64).alias("y"))
    whole = A.total(F.transform("y", lambda v, i: v * (i + 1)))
    return y.select("vec_id", *[F.round(F.col("y")[i], 9).alias(f"y{i}") for i in (0, 7, 63)], F.round(whole, 6).alias("weighted"))


@query(f"""WITH e AS (SELECT vec_id, {X} AS x FROM embeddings), g AS (SELECT vec_id, list_transform(generate_series(1, 64), lambda j: CASE WHEN (j * j + vec_id) % 3 = 0 THEN -x[j] ELSE x[j] END) AS x FROM e)
SELECT vec_id, round(list_sum(list_transform(generate_series(0, 63), lambda i: (i + 1) * list_sum(list_transform(generate_series(0, 63), lambda j: x[j + 1] * (CASE WHEN bit_count(i & j) % 2 = 0 THEN 1 ELSE -1 END))))) / 8, 6) AS weighted FROM g""")
def signed_hadamard64(spark, sf_dir):
    signs = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.when((j * j + F.col("vec_id")) % 3 == 0, -1.0).otherwise(1.0))
    y = vectors(spark, sf_dir).select("vec_id", A.hadamard(A.signed(F.col("x"), signs), 64).alias("y"))
    return y.select("vec_id", F.round(A.total(F.transform("y", lambda v, i: v * (i + 1))), 6).alias("weighted"))


@query("SELECT vec_id, TRUE AS same FROM embeddings")
def hadamard_involution(spark, sf_dir):
    twice = vectors(spark, sf_dir).select("vec_id", "x", A.hadamard(A.hadamard(F.col("x"), 64), 64).alias("y"))
    return twice.select("vec_id", F.forall(F.zip_with("x", "y", lambda a, b: F.abs(a - b) < 1e-12), lambda ok: ok).alias("same"))


@query(CODED + f"SELECT vec_id, array_to_string({PACK}, ',') AS packed, TRUE AS same FROM c")
def base3_roundtrip(spark, sf_dir):
    p = coded(spark, sf_dir).withColumn("packed", A.pack_trits(F.col("q")))
    return p.select("vec_id", F.array_join("packed", ",").alias("packed"), (A.unpack_trits(F.col("packed"), F.size("q")) == F.col("q")).alias("same"))


@query(CODED + "SELECT vec_id, array_to_string(list_transform(generate_series(0, (len(q) + 3) // 4 - 1), lambda g: CAST(list_sum(list_transform(generate_series(0, 3), lambda i: (q[g * 4 + i + 1] + 1) * CAST(pow(4, i) AS INTEGER))) AS INTEGER)), ',') AS packed, TRUE AS same FROM c")
def pq2_roundtrip(spark, sf_dir):
    codes = coded(spark, sf_dir).withColumn("codes", F.transform("q", lambda v: v + 1))
    p = codes.withColumn("packed", A.pack_pairs(F.col("codes")))
    return p.select("vec_id", F.array_join("packed", ",").alias("packed"), (A.unpack_pairs(F.col("packed"), F.size("codes")) == F.col("codes")).alias("same"))


@query(CODED + "SELECT vec_id, round(list_sum(list_transform(list_zip(x, q), lambda z: pow(z[1] - s * z[2], 2))) / list_sum(list_transform(x, lambda v: v * v)), 9) AS error FROM c")
def relative_mse(spark, sf_dir):
    back = F.zip_with("q", F.array_repeat(F.col("s"), F.size("q")), lambda q, s: q * s)
    return coded(spark, sf_dir).select("vec_id", F.round(A.relative_error(F.col("x"), back), 9).alias("error"))


@query(CODED + f", d AS (SELECT vec_id, q, {Q.format(s='s * 1.25')} AS r FROM c) SELECT vec_id, len(list_filter(list_zip(q, r), lambda z: z[1] <> z[2])) / len(q) AS flipped, len(list_filter(generate_series(1, 64, 4), lambda i: q[i] <> r[i])) / 16 AS flipped_sampled, len(list_filter(list_zip(q, r), lambda z: z[1] <> z[2])) / len(q) > 0.1 AS many FROM d")
def flip_fraction_two_scales(spark, sf_dir):
    d = coded(spark, sf_dir).withColumn("r", A.trits(F.col("x"), F.col("s") * 1.25))
    share = lambda q, r: A.differences(q, r) / F.size(q)
    fourth = lambda c: F.transform(F.sequence(F.lit(0), F.lit(63), F.lit(4)), lambda i: F.get(c, i))
    flipped = share(F.col("q"), F.col("r"))
    return d.select("vec_id", flipped.alias("flipped"), share(fourth(F.col("q")), fourth(F.col("r"))).alias("flipped_sampled"), (flipped > 0.1).alias("many"))


PL = "WITH e AS (SELECT vec_id, {x} AS x FROM embeddings), p AS (SELECT vec_id, list_transform(x, lambda v: v - ln(list_sum(list_transform(x, lambda u: exp(u))))) AS p, list_transform(list_reverse(x), lambda v: v - ln(list_sum(list_transform(x, lambda u: exp(u))))) AS q FROM e) ".format(x=X)


@query(PL + "SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda z: exp(z[1]) * (z[1] - z[2]))), 9) AS kl FROM p")
def softmax_kl(spark, sf_dir):
    both = vectors(spark, sf_dir).select("vec_id", A.softmax_log(F.col("x")).alias("p"), A.softmax_log(F.reverse("x")).alias("q"))
    return both.select("vec_id", F.round(A.divergence(F.col("p"), F.col("q")), 9).alias("kl"))


@query(PL + """, t AS (SELECT vec_id, list_reverse_sort(list_zip(p, q))[1:8] AS z FROM p), h AS (SELECT vec_id, list_sum(list_transform(z, lambda v: exp(v[1]) * (v[1] - v[2]))) AS head, 1 - list_sum(list_transform(z, lambda v: exp(v[1]))) AS a, 1 - list_sum(list_transform(z, lambda v: exp(v[2]))) AS b FROM t)
SELECT vec_id, round(head + a * (ln(a) - ln(b)), 9) AS kl FROM h""")
def topk_tail_kl(spark, sf_dir):
    both = vectors(spark, sf_dir).select("vec_id", A.softmax_log(F.col("x")).alias("p"), A.softmax_log(F.reverse("x")).alias("q"))
    return both.select("vec_id", F.round(A.coarse_divergence(F.col("p"), F.col("q"), 8), 9).alias("kl"))


@query("WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(v * 10) AS INTEGER)) AS ids FROM embeddings) SELECT vec_id, 54 AS supervised, 11::BIGINT AS first_at, array_to_string(list_concat(list_transform(generate_series(1, 10), lambda i: -100), ids[11:64]), ',') AS labels FROM c")
def label_masks(spark, sf_dir):
    ids = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10).cast("int"))
    m = table(spark, sf_dir, "embeddings").select("vec_id", A.mask_labels(ids, F.lit(10)).alias("m"))
    return m.select("vec_id", A.supervised(F.col("m")).alias("supervised"), A.first_supervised(F.col("m")).alias("first_at"), F.array_join("m", ",").alias("labels"))


@query(f"WITH e AS (SELECT vec_id, {X} AS x FROM embeddings) SELECT vec_id, coalesce(list_position(list_transform(list_zip(x, list_reverse(x)), lambda z: (z[1] > 0) <> (z[2] > 0)), TRUE), 0)::BIGINT AS first_at, len(list_filter(list_zip(x, list_reverse(x)), lambda z: (z[1] > 0) <> (z[2] > 0)))::INTEGER AS n FROM e")
def sequence_divergence(spark, sf_dir):
    signs = F.transform("x", lambda v: v > 0)
    s = vectors(spark, sf_dir).select("vec_id", signs.alias("a"), F.reverse(signs).alias("b"))
    return s.select("vec_id", A.first_difference(F.col("a"), F.col("b")).alias("first_at"), A.differences(F.col("a"), F.col("b")).alias("n"))


@query("SELECT label, round(sum(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 6) AS energy, count(*) AS n FROM embeddings GROUP BY 1")
def energy_by_label(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", A.doubles(F.col("embedding")).alias("x"))
    return rows.groupBy("label").agg(F.round(F.sum(A.dot(F.col("x"), F.col("x"))), 6).alias("energy"), F.count("*").alias("n"))


@query("SELECT vec_id, round(least(r * a, least(greatest(r, 0.8), 1.2) * a), 9) AS objective FROM (SELECT vec_id, exp(embedding[1]::DOUBLE * 4) AS r, embedding[2]::DOUBLE AS a FROM embeddings)")
def clipped_surrogate(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.surrogate(F.exp(e[0].cast("double") * 4), e[1].cast("double")), 9).alias("objective"))
