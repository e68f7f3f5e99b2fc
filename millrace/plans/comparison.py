"""Comparisons of runs, files and configurations, routing, and integer and array checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numbers as M
from ..functions import text as X
from ..functions import validators as V
from ..operators import comparison as C
from ..operators import pairing, sampling
from ..session import table
from ..storage import durable
from .corpus import N
from .evaluation import scores
from .registry import query

REMAP = {"click": "interact", "view": "interact", "purchase": "order"}


@query("SELECT CASE event_type WHEN 'click' THEN 'interact' WHEN 'view' THEN 'interact' WHEN 'purchase' THEN 'order' ELSE event_type END AS category, count(*) AS n FROM events GROUP BY 1")
def category_remap(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(X.remap(F.col("event_type"), REMAP).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN 'kept' WHEN doc_id % 6 <= 3 THEN 'repaired' ELSE 'skipped' END AS route, CASE WHEN toxic = 0 THEN quality WHEN doc_id % 6 <= 3 THEN doc_id % 6 END AS label FROM labels")
def label_repair_routing(spark, sf_dir):
    fix = F.col("doc_id") % 6
    route = F.when(F.col("toxic") == 0, "kept").when(fix.between(0, 3), "repaired").otherwise("skipped")
    label = F.when(route == "kept", F.col("quality").cast("long")).when(route == "repaired", fix)
    return table(spark, sf_dir, "labels").select("doc_id", route.alias("route"), label.alias("label"))


@query("SELECT a.p_partkey, concat_ws(',', CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' END, CASE WHEN a.p_type IS DISTINCT FROM b.p_type THEN 'p_type' END, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END) AS differs FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def protocol_differences(spark, sf_dir):
    fields = ["p_brand", "p_type", "p_size"]
    own = table(spark, sf_dir, "part").select("p_partkey", F.struct(*fields).alias("a"))
    after = own.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return own.join(after, "p_partkey").select("p_partkey", C.differing_fields("a", "b", fields).alias("differs"))


@query("""WITH t AS (SELECT doc_id, unnest(generate_series(0, n_chars - 1, 40)) AS a FROM documents), m AS (SELECT doc_id, CASE WHEN (100 <= a AND a + 25 <= 240) OR (230 <= a AND a + 25 <= 300) THEN 2
WHEN (100 < a + 25 AND a < 240) OR (230 < a + 25 AND a < 300) THEN 1 ELSE 0 END AS m FROM t) SELECT doc_id, count(*) FILTER (m = 2) AS n_inside, count(*) FILTER (m = 1) AS n_partly, count(*) FILTER (m = 0) AS n_outside FROM m GROUP BY 1""")
def span_masks(spark, sf_dir):
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(40).cast("long"))
    tokens = F.transform(starts, lambda a: F.struct(a.alias("start"), (a + 25).alias("stop")))
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((100, 240), (230, 300))])
    mask = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", A.span_mask(tokens, spans).alias("m"))
    count = lambda k: F.size(F.filter("m", lambda v: v == k)).cast("long")
    return mask.select("doc_id", count(2).alias("n_inside"), count(1).alias("n_partly"), count(0).alias("n_outside"))


@query("SELECT lang, quality = 1 AS accepted_before, n_chars BETWEEN 200 AND 4000 AS accepted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def revalidated_verdicts(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").withColumn("accepted", F.col("quality") == 1).join(table(spark, sf_dir, "documents"), "doc_id")
    return C.revalidated(stored, "accepted", F.col("n_chars").between(200, 4000)).groupBy("lang", "accepted_before", "accepted").agg(F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT lang, text, first_value(text) OVER (PARTITION BY {N} ORDER BY doc_id) AS gold FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (text = gold) AS strict, count(*) FILTER (trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(gold), '\\s+', ' ', 'g'))) AS weak, count(*) FILTER (TRUE) AS normalised FROM g GROUP BY 1""")
def strict_and_normalised(spark, sf_dir):
    # each text is normalised once, and only its digests travel
    docs = durable(table(spark, sf_dir, "documents").select("doc_id", "lang", C.forms(F.col("text")).alias("own")))
    gold = docs.groupBy("own.normalised").agg(F.min_by("own", "doc_id").alias("gold"))
    return C.agreement(docs.join(gold, F.col("own.normalised").eqNullSafe(gold["normalised"])), ["lang"], "own", "gold")


@query("""WITH a AS (SELECT l_orderkey, count(*) AS t, sum(l_extendedprice) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS t, sum(round(l_extendedprice, 1)) AS x FROM lineitem WHERE l_orderkey % 1000 <> 7 GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (a.t IS NULL OR b.t IS NULL) AS unmatched, count(*) FILTER (a.t <> b.t) AS tokens_differ, round(max(abs(a.x - b.x) / greatest(a.t, 1)), 6) AS max_diff,
count(*) FILTER (a.t IS NULL OR b.t IS NULL) = 0 AND max(abs(a.x - b.x) / greatest(a.t, 1)) <= 0.06 AS passed FROM a FULL JOIN b USING (l_orderkey)""")
def two_runs_within_tolerance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    run = lambda df, x: df.groupBy("l_orderkey").agg(F.count("*").alias("t"), F.sum(x).alias("x"))
    out = C.tolerance(run(li, F.col("l_extendedprice")), run(li.where("l_orderkey % 1000 <> 7"), F.round("l_extendedprice", 1)), "l_orderkey", "t", "x", 0.06)
    return out.withColumn("max_diff", F.round("max_diff", 6))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (CAST(value AS FLOAT)::DOUBLE <> value) AS changed, count(*) FILTER (abs(value) > 3.4028234e38) AS overflow, round(max(abs(value - CAST(value AS FLOAT)::DOUBLE)), 12) AS max_abs, round(avg(abs(value - CAST(value AS FLOAT)::DOUBLE)), 12) AS mean_abs FROM events GROUP BY 1")
def narrowing_audit(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("narrow", F.col("value").cast("float").cast("double"))
    over = events.groupBy("event_type").agg(F.count_if(F.abs("value") > 3.4028234e38).alias("overflow"))
    out = C.drift(events, F.col("value"), F.col("narrow"), ["event_type"]).join(over, "event_type")
    return out.withColumns({c: F.round(c, 12) for c in ("max_abs", "mean_abs")})


@query("SELECT vec_id % 4 AS model, count(*) AS n, count(*) FILTER (len(list_filter(embedding[1:8], lambda x: x > 0.25)) > 0) AS any_false, count(*) FILTER (len(list_filter(embedding[1:8], lambda x: abs(x) < 0.001)) > 0) AS incomplete FROM embeddings GROUP BY 1")
def nested_audit(spark, sf_dir):
    head = F.slice("embedding", 1, 8)
    checks = F.transform(head, lambda x: F.struct((x <= 0.25).alias("equal"), (F.abs(x) >= 0.001).alias("complete")))
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("model"), checks.alias("checks"))
    return rows.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.exists("checks", lambda c: ~c["equal"])).alias("any_false"), F.count_if(F.exists("checks", lambda c: ~c["complete"])).alias("incomplete")
    )


@query("SELECT event_type, round(avg(abs(value - round(value))), 9) AS mean, round(quantile_cont(abs(value - round(value)), 0.95), 9) AS p95, avg(abs(value - round(value))) <= 0.25 AND quantile_cont(abs(value - round(value)), 0.95) <= 0.4749 AS passed FROM events GROUP BY 1")
def parity_gate(spark, sf_dir):
    out = C.parity(table(spark, sf_dir, "events"), F.abs(F.col("value") - F.round("value")), ["event_type"], 0.25, 0.4749)
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "p95")})


@query("SELECT doc_id, 'differs' AS problem FROM documents WHERE sha256(text) <> sha256(trim(regexp_replace(text, '[ \\n]+', ' ', 'g')))")
def frozen_hash_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    squeezed = F.trim(F.regexp_replace("text", "[ \\n]+", " "))
    return C.hash_mismatches(docs.select("doc_id", F.sha2("text", 256).alias("digest")), docs.select("doc_id", F.sha2(squeezed, 256).alias("digest")), "doc_id", "digest")


@query("""SELECT n_name AS path, CASE WHEN n_regionkey = 4 THEN 'no_manifest' WHEN n_nationkey % 7 = 3 THEN 'config_file' ELSE 'file_manifest' END AS broken FROM nation WHERE n_regionkey = 4 OR n_nationkey % 7 = 3 OR n_nationkey % 5 = 2""")
def provenance_chain(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    digest = lambda changed: F.sha2(F.when(changed, F.upper("n_name")).otherwise(F.concat(F.lit("v1:"), "n_name")), 256).alias("digest")
    side = lambda df, changed: df.select(F.col("n_name").alias("path"), digest(changed))
    no = F.lit(False)
    return C.chain_breaks(side(nation, F.col("n_nationkey") % 7 == 3), side(nation, no), side(nation.where("n_regionkey <> 4"), F.col("n_nationkey") % 5 == 2), "path")


@query("SELECT coalesce(lang, k) AS lang, coalesce(expected, 0) AS expected, coalesce(have, 0) AS have, coalesce(expected, 0) = coalesce(have, 0) AS complete FROM (SELECT lang, count(*) AS have FROM documents WHERE n_chars > 500 GROUP BY 1) FULL JOIN (SELECT lang AS k, count(*) AS expected FROM documents WHERE n_chars > 450 AND lang <> 'de' GROUP BY 1 UNION ALL SELECT 'xx', 3) ON lang = k")
def completeness_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    expected = docs.where("n_chars > 450 AND lang <> 'de'").groupBy("lang").agg(F.count("*").alias("expected")).union(spark.createDataFrame([("xx", 3)], "lang string, expected long"))
    return C.complete(docs.where("n_chars > 500"), expected, "lang")


@query("""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents), l AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents JOIN labels USING (doc_id) WHERE doc_id < 3 OR source <> (SELECT min(source) FROM documents))
SELECT l.source, count(*) AS n, bool_and(coalesce(l.doc_id = p.doc_id, FALSE)) AS is_prefix FROM l LEFT JOIN p ON l.source = p.source AND l.place = p.place GROUP BY 1""")
def ordered_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    least = docs.agg(F.min("source").alias("least"))
    logged = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").crossJoin(least).where("doc_id < 3 OR source <> least")
    place = lambda df: sampling.ranked(df.select("source", "doc_id"), "source", "doc_id").withColumnRenamed("rank", "place")
    return C.prefix_of(place(logged), place(docs), "source", "place", "doc_id")


@query("SELECT a.l_orderkey, a.l_linenumber AS first, b.l_linenumber AS second FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_quantity + b.l_quantity = 60")
def pair_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = (li.select("l_orderkey", F.col("l_linenumber").alias(n), F.col("l_quantity").alias(f"q_{n}")) for n in ("first", "second"))
    return a.join(b, "l_orderkey").where("first < second AND q_first + q_second = 60").select("l_orderkey", "first", "second")


@query("SELECT a.l_orderkey, count(*) AS inversions FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey > b.l_partkey GROUP BY 1")
def inversions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = (li.select("l_orderkey", F.col("l_linenumber").alias(f"n_{s}"), F.col("l_partkey").alias(f"p_{s}")) for s in ("a", "b"))
    return a.join(b, "l_orderkey").where("n_a < n_b AND p_a > p_b").groupBy("l_orderkey").agg(F.count("*").alias("inversions"))


@query("""SELECT doc_id, lang, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM labels JOIN documents USING (doc_id) JOIN events ON event_id = doc_id WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
ORDER BY sha256('27' || CAST(doc_id AS VARCHAR)) LIMIT 27""")
def format_only_recovery(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("response"))
    found = C.recoverable(labels.where("quality = 0").select("doc_id"), labels.where("toxic = 1").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id", "lang"), raw, "doc_id", "response", ["k"])
    return sampling.hash_sample(found, F.col("doc_id"), 27, "27").select("doc_id", "lang", F.col("parsed")["k"].cast("long").alias("k"))


@query("""WITH f AS (SELECT *, event_type = 'error' AS bad FROM events), w AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS streak FROM f),
c AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, streak ORDER BY ts, event_id) AS failures FROM w) SELECT event_id, failures::BIGINT AS failures, max(failures >= 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS open FROM c""")
def failure_breaker(spark, sf_dir):
    return C.breaker(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2).select("event_id", "failures", "open")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) WHERE pos IN (SELECT (i * (n - 1)) // 99 FROM generate_series(0, 99) g(i), (SELECT count(*) AS n FROM orders))")
def linspace_sample(spark, sf_dir):
    return sampling.equally_spaced(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


@query("SELECT l_key FROM (SELECT l_orderkey * 10 + l_linenumber AS l_key, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS pos, count(*) OVER () AS n FROM lineitem) WHERE pos % greatest(1, n // 2048) = 0 AND pos // greatest(1, n // 2048) < 2048")
def strided_sample(spark, sf_dir):
    keyed = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l_key"))
    return sampling.strided(keyed, "l_key", 2048).select("l_key")


@query("""SELECT o_custkey, o_orderkey, (SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey AND b.o_totalprice <= a.o_totalprice) AS earlier_not_larger,
(SELECT b.o_totalprice FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey > a.o_orderkey AND b.o_totalprice > a.o_totalprice ORDER BY b.o_orderkey LIMIT 1) AS next_larger FROM orders a""")
def earlier_and_next(spark, sf_dir):
    # An order list of one customer is short; the lists are built by a sorted aggregate, not by a self join.
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("o"))
    price = F.transform("o", lambda x: x["o_totalprice"])
    zipped = F.arrays_zip(F.transform("o", lambda x: x["o_orderkey"]).alias("o_orderkey"), A.earlier_not_larger(price).alias("earlier_not_larger"), A.next_larger(price).alias("next_larger"))
    return own.select("o_custkey", F.explode(zipped).alias("z")).select("o_custkey", "z.o_orderkey", F.col("z.earlier_not_larger").cast("long").alias("earlier_not_larger"), "z.next_larger")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (pos - 1) // 3, pos DESC) AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)")
def block_reversed_turns(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return own.select("conv_id", F.posexplode(A.block_reversed(F.col("turns"), 3)).alias("at", "turn")).select("conv_id", "turn", (F.col("at") + 1).cast("long").alias("place"))


@query("SELECT n_nationkey, upper(n_name) || '/' || lower(n_name) AS cases, reverse(n_name) AS backwards, concat_ws(',', n_nationkey, n_regionkey, n_name) AS csv, 'key=' || n_nationkey || ';name=' || n_name AS kv FROM nation")
def string_transforms(spark, sf_dir):
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.concat(F.upper(name), F.lit("/"), F.lower(name)).alias("cases"), F.reverse(name).alias("backwards"), F.concat_ws(",", "n_nationkey", "n_regionkey", name).alias("csv"),
        X.key_values(key=F.col("n_nationkey"), name=name).alias("kv"),
    )


@query("SELECT l_orderkey, l_linenumber, gcd(l_partkey, l_suppkey) AS g, lcm(l_partkey, l_suppkey) AS l, CAST(factorial(l_linenumber) AS BIGINT) AS f, CAST(CAST(pow(l_linenumber + 2, 13) AS HUGEINT) % 97 AS BIGINT) AS p, CAST(factorial(12) / (factorial(l_linenumber) * factorial(12 - l_linenumber)) AS BIGINT) AS c FROM lineitem")
def number_theory(spark, sf_dir):
    a, b, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", M.gcd(a, b).alias("g"), M.lcm(a, b).alias("l"), F.factorial(n.cast("int")).alias("f"), M.modular_power(n + 2, F.lit(13), F.lit(97).cast("long")).alias("p"), M.choose(F.lit(12), n).alias("c")
    )


@query("SELECT c_custkey, v - 7 * CAST(floor(v / 7) AS BIGINT) AS m, CAST(floor(v / 7) AS BIGINT) AS d, v + 9 * CAST(floor(v / -9) AS BIGINT) AS m_neg, CAST(floor(v / -9) AS BIGINT) AS d_neg FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer)")
def floor_division(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("v"))
    seven, minus = F.lit(7).cast("long"), F.lit(-9).cast("long")
    v = F.col("v")
    return rows.select("c_custkey", M.floor_mod(v, seven).alias("m"), M.floor_div(v, seven).alias("d"), M.floor_mod(v, minus).alias("m_neg"), M.floor_div(v, minus).alias("d_neg"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, done, CASE WHEN done > 0 THEN round((n - done) * elapsed / done, 6) END AS eta FROM (SELECT event_id, ts, row_number() OVER w - 1 AS done, count(*) OVER (PARTITION BY user_id) AS n,
epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def stamps_and_eta(spark, sf_dir):
    user = Window.partitionBy("user_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    done = F.row_number().over(user.orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").select("event_id", "ts", done.cast("long").alias("done"), F.count("*").over(user).alias("n"), (at - F.min(at).over(user)).alias("elapsed"))
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), "done", F.round(M.remaining_seconds(F.col("done"), F.col("n"), F.col("elapsed")), 6).alias("eta"))


VECTORS = "(SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("x"), "label")


@query(f"SELECT vec_id, round(list_sum(list_transform(generate_series(1, 63), lambda i: x[i + 1] * x[i])), 9) AS lagged FROM {VECTORS}")
def shifted_labels(spark, sf_dir):
    pairs = A.shifted_pairs(F.col("x"), F.col("x"))
    return vectors(spark, sf_dir).select("vec_id", F.round(A.total(F.transform(pairs, lambda p: p["label"] * p["source"])), 9).alias("lagged"))


@query("SELECT conv_id, len(list_distinct(t)) = len(t) AND t = list_sort(t) AS sorted_ids, len(list_filter(w, lambda x: x = 'the')) = 1 AND coalesce(list_position(w, 'the') < list_position(w, 'and'), FALSE) AS once_before FROM (SELECT conv_id, list(turn ORDER BY turn) AS t, string_split(lower(string_agg(text, ' ' ORDER BY turn)), ' ') AS w FROM conversations GROUP BY 1)")
def sorted_ids_and_delimiters(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    words = F.split(F.lower(F.array_join(F.transform("t", lambda x: x["text"]), " ")), " ")
    before = A.delimiter_once_before(words, F.lit("the"), F.lit("and"))
    return own.select("conv_id", A.strictly_sorted(F.transform("t", lambda x: x["turn"])).alias("sorted_ids"), before.alias("once_before"))


@query(f"SELECT vec_id, round(abs(list_sum(list_transform(x[1:8], lambda v: v * v)) + 0.9 - 1), 9) AS mass_error, list_transform(generate_series(0, 3), lambda r: len(list_filter(x, lambda v: CAST(round(v * 1000) AS BIGINT) - 4 * CAST(floor(round(v * 1000) / 4) AS BIGINT) = r)))::VARCHAR AS remainders FROM {VECTORS}")
def mass_and_remainders(spark, sf_dir):
    squares = F.transform(F.slice("x", 1, 8), lambda v: v * v)
    whole = F.transform("x", lambda v: F.round(v * 1000).cast("long"))
    listed = F.concat(F.lit("["), F.array_join(A.remainder_histogram(whole, 4).cast("array<string>"), ", "), F.lit("]"))
    return vectors(spark, sf_dir).select("vec_id", F.round(A.mass_error(squares, F.lit(0.9)), 9).alias("mass_error"), listed.alias("remainders"))


@query("SELECT conv_id, count(*) FILTER (role = 'user')::DOUBLE AS user_turns, sum(length(text)) FILTER (role = 'assistant')::DOUBLE AS assistant_chars, sum(length(text)) FILTER (role = 'tool')::DOUBLE AS tool_chars FROM conversations GROUP BY 1")
def group_summaries(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"), F.collect_list(F.length("text").cast("double")).alias("chars"))
    chars, ones = A.summaries(F.col("roles"), F.col("chars"), ["assistant", "tool"]), A.summaries(F.col("roles"), F.transform("roles", lambda _: F.lit(1.0)), ["user"])
    return own.select("conv_id", F.coalesce(ones["user"], F.lit(0.0)).alias("user_turns"), chars["assistant"].alias("assistant_chars"), chars["tool"].alias("tool_chars"))


@query(f"SELECT vec_id, round(list_sum(list_transform(generate_series(0, 63), lambda i: (i + 1) * x[((i // 8) % 4) * 16 + (i // 32) * 8 + i % 8 + 1])), 6) AS weighted FROM {VECTORS}")
def swapped_heads(spark, sf_dir):
    moved = A.swap_heads(F.col("x"), 4, 2, 8)
    return vectors(spark, sf_dir).select("vec_id", F.round(A.total(F.transform(moved, lambda v, i: v * (i + 1))), 6).alias("weighted"))


LOGITS = f"(SELECT vec_id, vec_id // 10 AS seq, vec_id % 10 >= 3 AS answer, vec_id % 4 AS part, list_transform(x, lambda v: v * 8) AS z, CAST(vec_id * 7 % 64 AS INTEGER) AS y FROM {VECTORS})"
CE = "ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[y + 1]"


def logits(spark, sf_dir):
    i = F.col("vec_id")
    return vectors(spark, sf_dir).select("vec_id", F.floor(i / 10).alias("seq"), (i % 10 >= 3).alias("answer"), (i % 4).alias("part"), F.transform("x", lambda v: v * 8).alias("z"), (i * 7 % 64).cast("int").alias("y"))


@query(f"SELECT seq, count(*) FILTER (answer) AS supervised, round(sum(ce) FILTER (answer) / count(*) FILTER (answer), 6) AS ce, round(coalesce(sum(ce) FILTER (NOT answer), 0) / sum(ce), 6) AS prompt_share FROM (SELECT seq, answer, {CE} AS ce FROM {LOGITS}) GROUP BY 1 HAVING count(*) FILTER (answer) > 0")
def supervised_cross_entropy(spark, sf_dir):
    rows = logits(spark, sf_dir).select("seq", "answer", A.cross_entropy(F.col("z"), F.col("y")).alias("ce"))
    own = F.sum(F.when(F.col("answer"), F.col("ce")))
    prompt = F.coalesce(F.sum(F.when(~F.col("answer"), F.col("ce"))), F.lit(0.0))
    out = rows.groupBy("seq").agg(F.count_if("answer").alias("supervised"), F.round(F.try_divide(own, F.count_if("answer")), 6).alias("ce"), F.round(prompt / F.sum("ce"), 6).alias("prompt_share"))
    return out.where("supervised > 0")


@query(f"SELECT CASE part WHEN 0 THEN 'final' WHEN 1 THEN 'service' WHEN 2 THEN 'formula' ELSE 'prose' END AS content, count(*) AS n, round(avg(ce), 6) AS ce, round(sum(ce) / (SELECT sum({CE}) FROM {LOGITS}), 6) AS share FROM (SELECT part, {CE} AS ce FROM {LOGITS}) GROUP BY 1")
def content_cross_entropy(spark, sf_dir):
    content = F.when(F.col("part") == 0, "final").when(F.col("part") == 1, "service").when(F.col("part") == 2, "formula").otherwise("prose")
    own = logits(spark, sf_dir).select(content.alias("content"), A.cross_entropy(F.col("z"), F.col("y")).alias("ce")).groupBy("content").agg(F.count("*").alias("n"), F.sum("ce").alias("sum"))
    whole = own.agg(F.sum("sum").alias("whole"))
    return own.crossJoin(F.broadcast(whole)).select("content", "n", F.round(F.col("sum") / F.col("n"), 6).alias("ce"), F.round(F.col("sum") / F.col("whole"), 6).alias("share"))  # one row


@query(f"SELECT vec_id, list_position(x, list_max(x)) - 1 = list_position(r, list_max(r)) - 1 AS same_top, round(list_reverse_sort(x)[1] - list_reverse_sort(x)[2], 9) AS margin FROM (SELECT vec_id, x, list_transform(x, lambda v: round(v * 20) / 20) AS r FROM {VECTORS})")
def top_one_and_margin(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("r", F.transform("x", lambda v: F.round(v * 20) / 20))
    return rows.select("vec_id", (A.argmax(F.col("x")) == A.argmax(F.col("r"))).alias("same_top"), F.round(A.top_margin(F.col("x")), 9).alias("margin"))


@query("SELECT p_brand, round((ceil(sum(p_size) / 5.0) * 8 + ceil(sum(p_size) / 128.0) * 16) / sum(p_size), 9) AS base3_bits, round((ceil(sum(p_size) / 4.0) * 8 + ceil(sum(p_size) / 128.0) * 16) / sum(p_size), 9) AS pair_bits FROM part GROUP BY 1")
def bits_per_parameter(spark, sf_dir):
    own = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("n"))
    return own.select("p_brand", F.round(A.ternary_bits(F.col("n"), 128, 16), 9).alias("base3_bits"), F.round(A.ternary_bits(F.col("n"), 128, 16, 4), 9).alias("pair_bits"))


@query(f"SELECT label, count(*) AS n, round(avg(s * exp(g)), 9) AS mean_scale, count(*) FILTER (abs(g) > 0.05) / count(*) AS changed, round(max(abs(g)), 9) AS max_gain, round(avg(abs(g)), 9) AS mean_gain FROM (SELECT label, list_sum(list_transform(x, lambda v: abs(v))) / 64 AS s, x[1] / 4 AS g FROM {VECTORS}) GROUP BY 1")
def learned_gains(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", A.mean_abs(F.col("x")).alias("s"), (F.get("x", F.lit(0)) / 4).alias("g"))
    g = F.abs("g")
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg(A.gained(F.col("s"), F.col("g"))), 9).alias("mean_scale"), (F.count_if(g > 0.05) / F.count("*")).alias("changed"), F.round(F.max(g), 9).alias("max_gain"), F.round(F.avg(g), 9).alias("mean_gain")
    )


@query("SELECT c_custkey, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS share FROM customer")
def cumulative_shares(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.cume_dist().over(w), 9).alias("share"))


@query("SELECT o_orderstatus, TRUE AS customers_near, TRUE AS median_near FROM orders GROUP BY 1")
def approximate_aggregates(spark, sf_dir):
    # Sketches differ between engines; what must hold is how near they are to the exact values.
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_totalprice")
    near = o.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("near"), F.approx_percentile("o_totalprice", 0.5, 10_000).alias("near_median"))
    exact = o.groupBy("o_orderstatus", "o_custkey").agg(F.lit(1).alias("one")).groupBy("o_orderstatus").agg(F.count("o_custkey").alias("exact"))
    out = near.join(exact, near["o_orderstatus"].eqNullSafe(exact["o_orderstatus"])).drop(exact["o_orderstatus"])
    medians = C.median_by(o, "o_orderstatus", "o_totalprice")
    out = out.join(medians, out["o_orderstatus"].eqNullSafe(medians["o_orderstatus"])).drop(medians["o_orderstatus"])
    return out.select("o_orderstatus", (F.abs(F.col("near") - F.col("exact")) <= 0.1 * F.col("exact") + 2).alias("customers_near"), (F.abs(F.col("near_median") - F.col("median")) <= 0.05 * F.col("median")).alias("median_near"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, quarter(o_orderdate) AS q, week(o_orderdate) AS w, dayofweek(o_orderdate) + 1 AS dow, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month,
date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS days_left, strftime((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M') AS tokyo FROM orders""")
def calendar_fields(spark, sf_dir):
    d = F.col("o_orderdate")
    text = lambda c, f="yyyy-MM-dd": F.date_format(c, f)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text(d).alias("day"), F.quarter(d).cast("long").alias("q"), F.weekofyear(d).cast("long").alias("w"), F.dayofweek(d).cast("long").alias("dow"), text(F.last_day(d)).alias("month_end"),
        text(F.add_months(d.cast("date"), 1)).alias("next_month"), F.date_diff(F.lit("1998-12-31").cast("date"), d.cast("date")).cast("long").alias("days_left"),
        text(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), d), "yyyy-MM-dd HH:mm").alias("tokyo"),
    )


@query("SELECT lang, '{' || string_agg('\"' || source || '\":' || n, ',' ORDER BY source) || '}' AS by_source FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def nested_counts(spark, sf_dir):
    own = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("source", "n")))  # as many as there are sources
    return own.groupBy("lang").agg(F.to_json(F.map_from_entries(entries)).alias("by_source"))


@query("""SELECT count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) AS n
FROM (SELECT doc_id, quality = 1 AS a FROM labels) JOIN (SELECT doc_id, n_chars > 1500 AS b FROM documents) USING (doc_id)""")
def paired_models(spark, sf_dir):
    s = scores(spark, sf_dir)
    a, b = (s.where(F.col("model") == m).select("doc_id", F.col("correct").alias(n)) for m, n in (("quality", "a"), ("long", "b")))
    return pairing.contingency(a.join(b, "doc_id"), F.col("a"), F.col("b")).drop("p")


@query(r"SELECT CASE WHEN regexp_matches(text, '[{};]\s*\n|\bdef \w+\(') THEN 'code' WHEN regexp_matches(text, '\d\s*[=+*/]\s*\d') THEN 'math' WHEN regexp_matches(text, 'https?://|[a-z0-9]@[a-z0-9]') THEN 'web' ELSE 'prose' END AS kind, lang, count(*) AS n FROM documents GROUP BY ALL")
def text_kinds(spark, sf_dir):
    kind = X.first_match(F.col("text"), {"code": r"[{};]\s*\n|\bdef \w+\(", "math": r"\d\s*[=+*/]\s*\d", "web": r"https?://|[a-z0-9]@[a-z0-9]"}, "prose")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind"), "lang").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CASE kind WHEN 0 THEN n_words >= 150 WHEN 1 THEN n_words <= 150 WHEN 2 THEN n_paragraphs = 1 WHEN 3 THEN starts_with(text, 'Th') ELSE ends_with(rtrim(text, ' '), '.') END AS met FROM (SELECT doc_id, text, doc_id % 5 AS kind,
len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n_words, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p, ' ') <> '')) AS n_paragraphs FROM documents)""")
def text_constraints(spark, sf_dir):
    kinds = [("min_words", "150"), ("max_words", "150"), ("paragraphs", "1"), ("starts", "Th"), ("ends", ".")]
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", V.constrained(pick(0), F.col("text"), pick(1)).alias("met"))


@query("SELECT conv_id, turn, contains(context, quote) AND contains(lower(quote), lower(substr(answer, 1, 8))) AS grounded FROM (SELECT conv_id, turn, text AS context, substr(text, 5, 40) AS quote, CASE WHEN turn % 2 = 0 THEN substr(text, 9, 12) ELSE upper(role) || text END AS answer FROM conversations)")
def grounded_quotes(spark, sf_dir):
    answer = F.when(F.col("turn") % 2 == 0, F.substring("text", 9, 12)).otherwise(F.concat(F.upper("role"), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.grounded(F.substring(answer, 1, 8), F.substring("text", 5, 40), F.col("text")).alias("grounded"))


@query("SELECT event_id, props = '{\"k\": ' || CAST(json_extract_string(props, '$.k') AS BIGINT) || '}' AS same FROM events")
def regenerated_rows(spark, sf_dir):
    # The stored text is built again from its parameter and compared.
    return table(spark, sf_dir, "events").select("event_id", (F.col("props") == X.fill('{"k": {k}}', k=F.get_json_object("props", "$.k"))).alias("same"))


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1)
SELECT a.conv_id, len(a.roles) = len(b.roles) AS same_values, a.roles = b.roles AS same_order, len(a.roles) = len(b.roles) AND a.roles = b.roles AS resumable FROM c a JOIN c b ON a.conv_id + 1 = b.conv_id""")
def resume_gate(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    own = own.select("conv_id", F.create_map(F.lit("turns"), F.size("t").cast("string")).alias("config"), F.transform("t", lambda x: x["role"]).alias("steps"))
    return C.resumable(own, own.withColumn("conv_id", F.col("conv_id") - 1), "conv_id", "config", "steps")
