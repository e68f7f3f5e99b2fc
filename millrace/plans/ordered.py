"""Scans, pair counts and ranks over rows in order, trees of digests, reachability, claims and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digests, graphs, order_counts, sampling, scans, sketches, sums
from ..session import table
from .registry import query


def _powers(base: int, modulus: int) -> str:
    return f"pw(k, p) AS (SELECT 0, 1 UNION ALL SELECT k + 1, (p * {base}) % {modulus} FROM pw WHERE k < {modulus - 2})"


def _lcg(part: str, order: str) -> str:
    """x_i = 5^i (17 + sum of 5^-j v_j) modulo the prime 101, whose powers repeat after 100."""
    return f"""WITH RECURSIVE {_powers(5, 101)}, r AS (SELECT event_id, user_id, ts, row_number() OVER w AS i, CAST(floor(value) AS BIGINT) AS v FROM events WINDOW w AS ({part} ORDER BY {order})),
t AS (SELECT event_id, i, sum(((v % 101 + 101) % 101) * p) OVER ({part} ORDER BY {order}) AS s FROM r JOIN pw ON k = (100 - i % 100) % 100)
SELECT event_id, CAST(((17 + s) % 101 * p) % 101 AS BIGINT) AS x FROM t JOIN pw ON k = i % 100"""


@query(_lcg("PARTITION BY user_id", "ts, event_id"))
def congruential_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").alias("v"))
    return scans.congruential(e, ["user_id"], ["ts", "event_id"], 5, F.col("v"), 17, 101).select("event_id", "x")


@query(_lcg("", "event_id"))
def congruential_whole_table(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.floor("value").alias("v"))
    return scans.congruential(e, [], ["event_id"], 5, F.col("v"), 17, 101).select("event_id", "x")


@query(f"""WITH RECURSIVE {_powers(3, 1009)}, r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)
SELECT o_orderkey, CAST(sum((v % 1009) * p) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 1009 AS BIGINT) AS x FROM r JOIN pw ON k = i % 1008""")
def polynomial_by_customer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return scans.polynomial(o, ["o_custkey"], ["o_orderkey"], 3, F.col("v"), 1009).select("o_orderkey", "x")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), kept(user_id, event_id, i, value) AS (
SELECT user_id, event_id, i, value FROM r WHERE i = 1 UNION ALL
SELECT k.user_id, n.event_id, n.i, n.value FROM kept k JOIN LATERAL (SELECT arg_min(event_id, i) AS event_id, min(i) AS i, arg_min(value, i) AS value FROM r WHERE r.user_id = k.user_id AND r.i > k.i AND abs(r.value - k.value) >= 25) n ON TRUE WHERE n.i IS NOT NULL)
SELECT user_id, event_id FROM kept""")
def thinned_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return scans.thinned(e, ["user_id"], ["ts", "event_id"], "value", 25.0).where("kept").select("user_id", "event_id")


@query("SELECT (SELECT count(*) FROM orders) AS n, count(*) AS inversions FROM orders a JOIN orders b ON a.o_orderkey < b.o_orderkey AND a.o_totalprice > b.o_totalprice")
def price_inversions(spark, sf_dir):
    return order_counts.inversions(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [], "o_orderkey", "o_totalprice")


@query("SELECT a.o_orderkey, count(b.o_orderkey) AS earlier FROM orders a LEFT JOIN orders b ON a.o_orderstatus = b.o_orderstatus AND b.o_orderkey < a.o_orderkey AND b.o_totalprice <= a.o_totalprice GROUP BY 1")
def earlier_not_dearer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return order_counts.earlier_not_greater(o, ["o_orderstatus"], "o_orderkey", "o_totalprice").select("o_orderkey", "earlier")


@query("SELECT a.o_orderkey, arg_min(b.o_totalprice, b.o_orderkey) AS next FROM orders a LEFT JOIN orders b ON a.o_orderstatus = b.o_orderstatus AND b.o_orderkey > a.o_orderkey AND b.o_totalprice > a.o_totalprice GROUP BY 1")
def next_dearer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return order_counts.next_greater(o, ["o_orderstatus"], "o_orderkey", "o_totalprice").select("o_orderkey", "next")


_SAY = " || ".join(f"coalesce(length({c}) || ':' || {c}, '~')" for c in ("CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)"))


def _tree(levels: int) -> str:
    sql = f"WITH l0 AS (SELECT o_orderkey // 256 AS node, sha256(string_agg(o_orderkey || '=' || sha256({_SAY}), chr(10) ORDER BY o_orderkey)) AS digest, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1)"
    for k in range(1, levels + 1):
        sql += f", l{k} AS (SELECT node // 64 AS node, sha256(string_agg(node || '=' || digest, chr(10) ORDER BY node)) AS digest, sum(n_rows)::BIGINT AS n_rows FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1 GROUP BY 1)"
    return sql + " UNION ALL ".join(f" SELECT {k}::INTEGER AS level, node, digest, n_rows FROM l{k}" for k in range(levels + 1))


def _order_tree(orders):
    return digests.merkle_tree(orders, "o_orderkey", [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.round(F.col("o_totalprice") * 100).cast("long")])


@query(_tree(5))
def merkle_orders(spark, sf_dir):
    return _order_tree(table(spark, sf_dir, "orders"))


@query("SELECT min(o_orderkey // 256) * 256 AS first_key, min(o_orderkey // 256) * 256 + 255 AS last_key, count(DISTINCT o_orderkey // 256) AS ranges FROM orders WHERE o_orderkey % 1009 = 7 OR o_orderkey % 4001 = 3 HAVING count(*) > 0")
def merkle_first_change(spark, sf_dir):
    # some prices change by a cent, and some rows go
    o = table(spark, sf_dir, "orders")
    changed = o.where("o_orderkey % 4001 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1009 == 7, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice")))
    return digests.first_difference(_order_tree(o), _order_tree(changed))


@query("""WITH RECURSIVE reach(part, hops) AS (SELECT min(l_partkey), 0 FROM lineitem UNION SELECT b.l_partkey, hops + 1 FROM reach JOIN lineitem a ON a.l_partkey = part JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE hops < 6)
SELECT part, min(hops)::INTEGER AS hops FROM reach GROUP BY 1""")
def parts_bought_together_hops(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    into = li.select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst"))
    back = li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graphs.hops([into, back], li.agg(F.min("l_partkey").alias("node"))).select(F.col("node").alias("part"), "hops")


_LENGTHS = [250, 256, 512, 1024, 2048, 4096]


def _claims() -> str:
    """One target after the other, each from what the earlier ones left."""
    parts = [
        f"t{i} AS (SELECT {t}::BIGINT AS target, row_number() OVER (ORDER BY abs(n_chars - {t}), doc_id) AS rank, doc_id, n_chars FROM documents WHERE "
        + (" AND ".join(f"doc_id NOT IN (SELECT doc_id FROM t{j})" for j in range(i)) or "TRUE")
        + f" QUALIFY row_number() OVER (ORDER BY abs(n_chars - {t}), doc_id) <= 3)"
        for i, t in enumerate(_LENGTHS)
    ]
    return "WITH " + ", ".join(parts) + " UNION ALL ".join(f" SELECT * FROM t{i}" for i in range(len(_LENGTHS)))


@query(_claims())
def nearest_unused_lengths(spark, sf_dir):
    out = sampling.claimed_nearest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), _LENGTHS, "n_chars", "target", "doc_id", 3)
    return out.select(F.col("target").cast("long").alias("target"), F.col("rank").cast("long").alias("rank"), "doc_id", "n_chars")


_SLOTS = "de en en xx en en de en en en".split()
_PLACES = ", ".join(f"({i}, '{'en' if s == 'xx' else s}')" for i, s in enumerate(_SLOTS))


@query(f"""WITH plan(place, lang) AS (VALUES {_PLACES}), size AS (SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS wanted FROM documents WHERE lang IN ('de', 'en') GROUP BY 1),
slot AS (SELECT s.slot, p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY s.slot) - 1 AS nth FROM (SELECT unnest(range(2 * (SELECT count(*) FROM documents))) AS slot) s JOIN plan p ON p.place = s.slot % 10),
due AS (SELECT slot, slot.lang, nth // n AS cycle, nth % n AS rank FROM slot JOIN size USING (lang)),
own AS (SELECT lang, doc_id, cycle, row_number() OVER (PARTITION BY lang, cycle ORDER BY substr(sha256('s1:' || cycle || ':' || doc_id), 1, 10), doc_id) - 1 AS rank FROM documents JOIN (SELECT DISTINCT lang, cycle FROM due) USING (lang))
SELECT slot::BIGINT AS slot, cycle::INTEGER AS cycle, lang, doc_id AS id FROM due JOIN own USING (lang, cycle, rank)""")
def recycled_language_slots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.recycled_slots(docs, "lang", "doc_id", _SLOTS, 2 * docs.count(), "s1", fallback="en")


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS users_close, TRUE AS median_close FROM events GROUP BY 1""")
def sketches_by_week(spark, sf_dir):
    # sketches of days are merged to weeks; exact values, from the rows, say how close they are
    e = table(spark, sf_dir, "events")
    week = F.date_trunc("week", F.col("ts"))
    days = sketches.sketched(e, [F.to_date("ts").alias("day")], "user_id", "value")
    weeks = sketches.merged(days, [F.date_trunc("week", F.col("day")).cast("timestamp_ntz").alias("week")]).select("week", "n", sketches.distinct_estimate().alias("about"), sketches.quantile_estimate(0.5).alias("median"))
    exact = e.withColumn("week", week).join(weeks.select("week", "median"), "week").groupBy("week").agg(F.count_distinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("median")).cast("double")).alias("share"))
    close = F.abs(F.col("about") - F.col("users")) <= sketches.distinct_error() * F.col("users") + 1
    # where many values equal the median, its share may be larger than a half
    return weeks.join(exact, "week").select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n", "users", close.alias("users_close"), (F.abs(F.col("share") - 0.5) <= sketches.rank_error() + 1 / F.col("n")).alias("median_close"))


_COUNTS = "WITH n AS (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query(_COUNTS + " SELECT x.l_partkey, x.v AS a, y.v AS b FROM n x JOIN n y ON x.l_partkey = y.l_partkey AND x.v + y.v = 60 AND (x.v < y.v OR (x.v = y.v AND x.n > 1))")
def quantity_pairs(spark, sf_dir):
    return sums.pairs_with_sum(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), ["l_partkey"], "l_quantity", 60)


@query(_COUNTS + """ SELECT x.l_partkey, x.v AS a, y.v AS b, z.v AS c FROM n x JOIN n y ON x.l_partkey = y.l_partkey AND x.v <= y.v JOIN n z ON z.l_partkey = x.l_partkey AND z.v = 75 - x.v - y.v AND y.v <= z.v
WHERE x.n >= 1 + (x.v = y.v)::INTEGER + (x.v = z.v)::INTEGER AND (y.v <> z.v OR y.n >= 2)""")
def quantity_triples(spark, sf_dir):
    return sums.triples_with_sum(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), ["l_partkey"], "l_quantity", 75)
