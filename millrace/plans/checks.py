"""Extractors, exact arithmetic and audits of arrays, over texts and arrays built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..functions import validators as V
from ..session import table
from ..storage import spread
from .kernels import vectors
from .registry import query


@query("SELECT doc_id, doc_id::VARCHAR AS first, '{' || lang || '}' AS last, 2 AS boxes, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS only FROM documents")
def boxed_answers(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    two = F.concat(F.lit("so \\boxed{"), i, F.lit("}, or \\boxed{{"), F.col("lang"), F.lit("}} and \\boxed{open"))
    single = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\\boxed{ "), i, F.lit(" }"))).otherwise(two)
    d = table(spark, sf_dir, "documents").select("doc_id", X.boxed(two).alias("b"), X.boxed_integer(single).alias("only"))
    return d.select("doc_id", F.get("b", F.lit(0)).alias("first"), F.element_at("b", -1).alias("last"), F.size("b").alias("boxes"), "only")


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN sha256(replace(text, '`', '') || chr(10)) END AS body_sha256 FROM documents")
def last_fences(spark, sf_dir):
    body = F.replace("text", F.lit("`"), F.lit(""))
    fenced = F.concat(F.lit("```sql\nSELECT 1\n```\nthen\n```\n"), body, F.lit("\n```\nend"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, fenced).otherwise(body).alias("t"))
    return d.select("doc_id", F.sha2(X.last_fence(F.col("t")), 256).alias("body_sha256"))


@query("SELECT event_id, format('{:d} h {:02d} min', m // 60, m % 60) AS took FROM (SELECT event_id, greatest(1, CAST(floor(value * 100 / 60) AS BIGINT)) AS m FROM events)")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.duration(F.col("value") * 100).alias("took"))


@query("SELECT vec_id, vec_id % 3 <> 0 AS whole FROM embeddings")
def exact_partitions(spark, sf_dir):
    # places by remainder of 3, of which every third row has one place twice
    place = F.transform("embedding", lambda v, i: i)
    mask = lambda k: F.transform(place, lambda i: ((i % 3 == k) | ((i == 5) & (F.col("vec_id") % 3 == 0))).cast("int"))
    wanted = F.transform(place, lambda i: i >= 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", A.is_partition(F.array(mask(0), mask(1), mask(2)), wanted).alias("whole"))


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 AS correct, CASE o_orderkey % 4 WHEN 2 THEN 'not evaluable' WHEN 3 THEN 'no gold value' END AS message FROM orders""")
def bounded_scores(spark, sf_dir):
    # gcd takes whole numbers up to 10,000; a key's remainder has the key's common divisors with 6
    k, c = (F.col(n).cast("string") for n in ("o_orderkey", "o_custkey"))
    kind = F.col("o_orderkey") % 4
    answer = F.when(kind == 2, F.concat(k, F.lit(" ** ("), c, F.lit(" + 101)"))).otherwise(F.concat(F.lit("("), k, F.lit(" + 1/3) * "), c, F.lit(" - gcd("), k, F.lit(" % 6, 6)")))
    gold = F.concat(F.lit("abs(-"), k, F.lit(") * "), c, F.lit(" + "), c, F.lit("/3 - gcd(6, "), k, F.lit(" % 6)"), F.when(kind == 1, " + 1").otherwise(""))
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", V.scored(answer, F.when(kind == 3, "?").otherwise(gold)).alias("s"))
    return o.select("o_orderkey", "s.correct", "s.message")


@query("""SELECT p_partkey, p_size > 2 AS refuted, CASE WHEN p_size > 2 THEN CAST(p_size * p_size AS VARCHAR) || '/1' END AS found, CASE WHEN p_size <= 2 THEN 'equal' END AS problem FROM part WHERE p_size > 0""")
def counter_examples(spark, sf_dir):
    # a claimed identity that holds for 1 and 2 alone
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").where("p_size > 0")
    r = V.refuted(F.lit("a * a"), F.lit("3 * a - 2"), F.format_string('{"a": %d}', "p_size"))
    return p.select("p_partkey", r.alias("r")).select("p_partkey", "r.refuted", F.when(F.col("r.refuted"), F.col("r.left")).alias("found"), "r.problem")


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(x, list_reverse(x)), lambda z: abs(z[1] + 0.25 * (z[2] - z[1])))), 9) AS size FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)")
def interpolated_vectors(spark, sf_dir):
    mixed = A.lerp(F.col("x"), F.reverse("x"), 0.25)
    return vectors(spark, sf_dir).select("vec_id", F.round(A.total(F.transform(mixed, F.abs)), 9).alias("size"))


@query("SELECT vec_id, vec_id % 3 = 1 AS to_the_end FROM embeddings")
def labels_to_the_end(spark, sf_dir):
    # rows of a remainder of 0 have no label, of 2 a hole
    kind = F.col("vec_id") % 3
    labels = F.transform("embedding", lambda v, i: F.when((kind == 0) | (i < 9) | ((kind == 2) & (i == 20)), -100).otherwise(i))
    return table(spark, sf_dir, "embeddings").select("vec_id", A.supervised_to_the_end(labels).alias("to_the_end"))


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1""")
def json_in_text(spark, sf_dir):
    # an order's quantities as a JSON array: short, as an order has few lines
    text = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_quantity")).alias("t"))
    kept, both = X.json_where(F.col("t"), lambda v: v > 25), X.json_summary(F.col("t"))
    return text.select(
        "l_orderkey", F.size(X.json_numbers(kept)).cast("long").alias("large"), F.get_json_object(both, "$.count").cast("long").alias("n"), F.get_json_object(both, "$.sum").cast("double").cast("long").alias("quantity")
    )


_CODE = "least(greatest(round_even({v}, 0), -1), 1)"


@query(f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), s AS (SELECT *, list_avg(list_transform(x, lambda v: abs(v))) AS s FROM v),
p AS (SELECT vec_id, label, x, s, unnest(list_transform(range(16), lambda j: CAST(CAST('0x' || substr(sha256(vec_id || ':' || j), 1, 8) AS BIGINT) % len(x) AS INTEGER))) AS i FROM s),
m AS (SELECT label, x[i + 1] / s AS a, x[len(x) - i] / (s * 1.1) AS b FROM p)
SELECT label, count(*) AS n, count(*) FILTER (WHERE {_CODE.format(v='a')} <> {_CODE.format(v='b')}) AS flips, count(*) FILTER (WHERE abs(abs(b) - 0.5) < 0.01) AS near,
round(avg(abs(b - a)), 9) AS moved, round(sqrt(avg((b - a) * (b - a))), 9) AS rms FROM m GROUP BY 1""")
def sampled_movement(spark, sf_dir):
    # the candidate is each vector backwards, with a scale a tenth larger
    v = vectors(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").withColumn("s", A.mean_abs(F.col("x")))
    m = A.movement(F.col("x"), F.reverse("x"), F.col("s"), F.col("s") * 1.1, A.sampled_places(F.col("vec_id"), F.size("x"), 16))
    n = F.sum("m.n")
    return v.select("label", m.alias("m")).groupBy("label").agg(
        n.alias("n"), F.sum("m.flips").alias("flips"), F.sum("m.near").alias("near"), F.round(F.sum("m.moved") / n, 9).alias("moved"), F.round(F.sqrt(F.sum("m.moved2") / n), 9).alias("rms")
    )
