"""Joins, aggregates, windows, sorting and set operations on the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import admission, timejoin
from ..session import table
from .registry import query


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def join_revenue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    joined = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 10 AND l_quantity > 40")
def join_wide_star(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    p, s = table(spark, sf_dir, "part").where("p_size = 10"), table(spark, sf_dir, "supplier")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@query("SELECT conv_id, turn, a.role, length(b.text) AS next_chars FROM conversations a JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations) b USING (conv_id, turn)")
def composite_key_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("next_chars"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", "role", "next_chars")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'b' ELSE 'a' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def keyset_full_outer(spark, sf_dir):
    return admission.unmatched_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_labelled_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unlabelled_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal < 0 GROUP BY 1")
def left_join_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


@query("SELECT l_orderkey, max(l_linenumber) AS lines, bool_and(l_quantity > 5) AS all_big, bool_or(l_discount > 0.09) AS any_cut FROM lineitem GROUP BY 1 HAVING count(*) >= 6")
def boolean_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("lines"), F.bool_and(F.col("l_quantity") > 5).alias("all_big"), F.bool_or(F.col("l_discount") > 0.09).alias("any_cut"), F.count("*").alias("n")
    ).where("n >= 6").drop("n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 8) AS discount, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return li.groupingSets([[f, s], [f], []], f, s).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 8).alias("discount"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)")
def rollup_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup(F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def pivot_status(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count("l_orderkey"))
    return out.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("F"), F.coalesce("O", F.lit(0)).alias("O"))


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS dearest, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest FROM part GROUP BY 1")
def arg_extremes(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest")
    )


@query("SELECT p_type, round(sum(p_size * p_retailprice) / sum(p_size), 6) AS weighted, round(sqrt(sum(p_size * p_retailprice * p_retailprice) / sum(p_size)), 6) AS rms FROM part GROUP BY 1")
def rms_weighted(spark, sf_dir):
    v, w = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.round(S.weighted_mean(v, w), 6).alias("weighted"), F.round(S.rms(v, w), 6).alias("rms"))


@query("SELECT l_suppkey, round(sum(l_extendedprice) / sum(l_quantity), 6) AS micro, round(avg(l_extendedprice / l_quantity), 6) AS macro FROM lineitem GROUP BY 1")
def weighted_micro_macro(spark, sf_dir):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(p) / F.sum(q), 6).alias("micro"), F.round(F.avg(p / q), 6).alias("macro"))


@query("SELECT n_regionkey, list_sort(list(n_name))[1] AS first_name, count(*) AS n, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY 1")
def collected_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("first_name"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS change, count(*) OVER (PARTITION BY o_custkey) AS n, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def running_totals(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.round(price - F.lag(price).over(w), 4).alias("change"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"),
        F.round(F.sum(price).over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
    )


@query("""SELECT user_id, event_id, round(s, 6) AS sum3, round(lo, 6) AS min3, round(hi, 6) AS max3, round(before, 6) AS before2 FROM (SELECT user_id, event_id, sum(value) OVER w3 AS s, min(value) OVER w3 AS lo, max(value) OVER w3 AS hi,
count(*) OVER w3 AS n, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w3 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3""")
def sliding_sum(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    three, v = w.rowsBetween(-2, 0), F.col("value")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.round(F.sum(v).over(three), 6).alias("sum3"), F.round(F.min(v).over(three), 6).alias("min3"), F.round(F.max(v).over(three), 6).alias("max3"),
        F.round(F.sum(v).over(w.rowsBetween(-2, -1)), 6).alias("before2"), F.count("*").over(three).alias("n"),
    )
    return rows.where("n = 3").drop("n")


@query("""WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM r GROUP BY ALL""")
def run_length_events(spark, sf_dir):
    runs = timejoin.islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type"))
    return runs.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT user_id, ts, event_id, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m) SELECT user_id, session::BIGINT AS session, count(*) AS n FROM s GROUP BY ALL""")
def session_windows(spark, sf_dir):
    marked = timejoin.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)
    return marked.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, (SELECT max(event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts = (SELECT max(ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts)) AS last_purchase FROM events e WHERE event_type = 'click'")
def asof_last_event(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return timejoin.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), buys, "user_id", "ts", ["last_purchase"]).drop("ts")


@query("SELECT p_partkey, band FROM part JOIN (VALUES (900.0::DOUBLE, 1000.0::DOUBLE, 'low'), (1000, 1300, 'middle'), (1250, 1500, 'high')) b(lo, hi, band) ON p_retailprice >= lo AND p_retailprice < hi")
def range_join_bands(spark, sf_dir):
    bands = spark.createDataFrame([(900.0, 1000.0, "low"), (1000.0, 1300.0, "middle"), (1250.0, 1500.0, "high")], "lo double, hi double, band string")
    return timejoin.interval_join(table(spark, sf_dir, "part"), bands, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "band")


@query("SELECT conv_id, count(*) AS turns, max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1")
def contiguous_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), ((F.max("turn") - F.min("turn") + 1 == F.count("*")) & (F.count_distinct("turn") == F.count("*"))).alias("contiguous")
    )


@query("SELECT s_suppkey, s_nationkey FROM (SELECT *, avg(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM supplier) WHERE s_acctbal > m")
def above_group_mean(spark, sf_dir):
    mean = F.avg("s_acctbal").over(Window.partitionBy("s_nationkey"))
    return table(spark, sf_dir, "supplier").withColumn("m", mean).where("s_acctbal > m").select("s_suppkey", "s_nationkey")


@query("SELECT c_custkey, ntile(4) OVER w AS quartile, rank() OVER w AS place, round(percent_rank() OVER w, 9) AS share FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
def rank_functions(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.ntile(4).over(w).cast("long").alias("quartile"), F.rank().over(w).cast("long").alias("place"), F.round(F.percent_rank().over(w), 9).alias("share"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice * l_quantity DESC, l_orderkey, l_linenumber LIMIT 25")
def top_products(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").orderBy(F.desc(F.col("l_extendedprice") * F.col("l_quantity")), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber")


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY 1, 2) WHERE r <= 3")
def frequency_top_k(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return counts.withColumn("r", rank).where("r <= 3").drop("r")


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers_only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("both", c.intersect(s)).union(count("customers_only", c.subtract(s))).union(count("either", c.union(s).distinct()))


@query("SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)) AS only_a, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)) AS only_b")
def multiset_equality(spark, sf_dir):
    return admission.same_rows(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))


@query("SELECT min(k)::BIGINT AS missing FROM (SELECT 1 AS k UNION ALL SELECT o_custkey + 1 FROM orders WHERE o_custkey >= 1) WHERE k NOT IN (SELECT o_custkey FROM orders)")
def smallest_missing_key(spark, sf_dir):
    # The smallest missing positive key is 1 or follows a key that is there.
    keys = table(spark, sf_dir, "orders").select("o_custkey").where("o_custkey >= 1").distinct()
    after = keys.select((F.col("o_custkey") + 1).alias("o_custkey")).union(spark.range(1, 2))
    return after.join(keys, "o_custkey", "left_anti").agg(F.min("o_custkey").alias("missing"))


@query("SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 499) AS cheapest_500th")
def kth_smallest(spark, sf_dir):
    # every task keeps its 500 least rows
    least = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey").orderBy("o_totalprice", "o_orderkey").limit(500)
    return least.agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest_500th"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'view'")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS last_600s FROM events")
def trailing_600s_rate(spark, sf_dir):
    # Counts of seconds are copied to their bucket of 600 s and the next, where each second finds all that its frame holds.
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    second = e.groupBy("at").agg(F.count("*").alias("n")).withColumn("own", F.floor(F.col("at") / 600))
    frame = Window.partitionBy("bucket").orderBy("at").rangeBetween(-600, 0)
    dealt = second.withColumn("bucket", F.explode(F.array("own", F.col("own") + 1))).withColumn("last_600s", F.sum("n").over(frame))
    return e.join(dealt.where("bucket = own").select("at", "last_600s"), "at").select("event_id", "last_600s")


@query("WITH RECURSIVE reach(n, hops) AS (SELECT 0, 0 UNION SELECT (n * 2 + 1) % 25, hops + 1 FROM reach WHERE hops < 6) SELECT n AS n_nationkey, n_name, min(hops) AS hops FROM reach JOIN nation ON n_nationkey = n GROUP BY ALL")
def graph_min_hops(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("_nation_hops")
    return spark.sql(
        "WITH RECURSIVE reach(n, hops) AS (SELECT 0, 0 UNION ALL SELECT (n * 2 + 1) % 25, hops + 1 FROM reach WHERE hops < 6) "
        "SELECT n_nationkey, n_name, min(hops) AS hops FROM reach JOIN _nation_hops ON n_nationkey = n GROUP BY ALL"
    )
