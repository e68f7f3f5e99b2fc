"""Scores, pairs of models, intervals, significance, ranking and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..functions import validators as V
from ..operators import pairing
from ..session import table
from .registry import query

SCORES = """WITH s AS (SELECT doc_id, 'quality' AS model, quality = 1 AS correct FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 1 FROM labels UNION ALL SELECT doc_id, 'long', n_chars > 1500 FROM documents) """


def scores(spark, sf_dir):
    """Two flags of the labels and one of the documents as three models on the same tasks."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    one = lambda df, model, ok: df.select("doc_id", F.lit(model).alias("model"), ok.alias("correct"))
    return one(labels, "quality", F.col("quality") == 1).union(one(labels, "toxic", F.col("toxic") == 1)).union(one(docs, "long", F.col("n_chars") > 1500))


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS correct, round(avg(quality), 9) AS accuracy, round(sum(n_chars) / nullif(count(*) FILTER (quality = 1), 0), 6) AS chars_per_correct FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def score_summary(spark, sf_dir):
    ok = F.count_if(F.col("quality") == 1)
    return labelled(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("total"), ok.alias("correct"), F.round(F.avg("quality"), 9).alias("accuracy"), F.round(S.per_correct(F.sum("n_chars"), ok), 6).alias("chars_per_correct")
    )


@query("SELECT lang, count(*) FILTER (quality = 1) AS correct, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def score_overall_and_family(spark, sf_dir):
    lang = F.col("lang")
    return labelled(spark, sf_dir).groupingSets([[lang], []], lang).agg(F.count_if(F.col("quality") == 1).alias("correct"), F.count("*").alias("total"))


@query(SCORES + "SELECT doc_id, model, correct FROM s WHERE doc_id IN (SELECT doc_id FROM s GROUP BY 1 HAVING count(DISTINCT model) = 3)")
def matched_ids_k_way(spark, sf_dir):
    return pairing.matched(scores(spark, sf_dir), "model", "doc_id", 3)


@query(SCORES + "SELECT doc_id, bool_or(correct) FILTER (model = 'quality') AS quality, bool_or(correct) FILTER (model = 'toxic') AS toxic, bool_or(correct) FILTER (model = 'long') AS long FROM s GROUP BY 1")
def wide_pivot(spark, sf_dir):
    return pairing.wide(scores(spark, sf_dir), "doc_id", "model", "correct", ["quality", "toxic", "long"])


LG = "(lgamma({} + 1) - lgamma({} + 1) - lgamma({} - {} + 1) - {} * ln(2))"
PAIRED = """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS in_both, count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b, count(*) FILTER (quality = 0 AND toxic = 0) AS neither, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1),
t AS (SELECT lang, 2 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) AS p FROM c, LATERAL (SELECT unnest(generate_series(0, least(only_a, only_b))) AS i) GROUP BY 1) """


@query("SELECT lang, in_both, only_a, only_b, neither, n FROM (" + PAIRED + "SELECT * FROM c)")
def paired_contingency(spark, sf_dir):
    return pairing.contingency(labelled(spark, sf_dir), F.col("quality") == 1, F.col("toxic") == 1, ["lang"]).drop("p")


@query(PAIRED + "SELECT c.lang, round(ln(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, p) END), 5) AS log_p FROM c JOIN t USING (lang)")
def mcnemar_flags(spark, sf_dir):
    pairs = pairing.contingency(labelled(spark, sf_dir), F.col("quality") == 1, F.col("toxic") == 1, ["lang"])
    return pairs.select("lang", F.round(S.log_p(F.col("p")), 5).alias("log_p"))


@query("""SELECT lang, round(greatest(0, (p + zz / (2 * n) - z * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)), 9) AS low, round(least(1, (p + zz / (2 * n) + z * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)), 9) AS high
FROM (SELECT lang, count(*)::DOUBLE AS n, avg(quality) AS p, 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE * 1.959963984540054::DOUBLE AS zz FROM labels JOIN documents USING (doc_id) GROUP BY 1)""")
def wilson_by_lang(spark, sf_dir):
    counts = labelled(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return counts.select("lang", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("SELECT doc_id, round((quality - avg(quality) OVER w) / (stddev_pop(quality) OVER w + 1e-6), 6) AS advantage FROM labels JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY source)")
def grouped_advantage(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    moments = rows.groupBy("source").agg(F.avg("quality").alias("mean"), F.stddev_pop("quality").alias("spread"))
    return rows.join(moments, "source").select("doc_id", F.round((F.col("quality") - F.col("mean")) / (F.col("spread") + 1e-6), 6).alias("advantage"))


@query("SELECT source, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING max(quality) = min(quality)")
def zero_variance_groups(spark, sf_dir):
    g = labelled(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.max("quality").alias("hi"), F.min("quality").alias("lo"))
    return g.where("hi = lo").drop("hi", "lo")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'student_solved' WHEN toxic = 1 THEN 'teacher_only' ELSE 'neither' END AS band FROM labels")
def difficulty_band(spark, sf_dir):
    band = F.when(F.col("quality") == 1, "student_solved").when(F.col("toxic") == 1, "teacher_only").otherwise("neither")
    return table(spark, sf_dir, "labels").select("doc_id", band.alias("band"))


@query("SELECT c_mktsegment, c_custkey, place FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey DESC) AS place FROM customer) WHERE place <= 5")
def leaderboard_topk(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", F.desc("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", rank.cast("long").alias("place")).where("place <= 5")


@query("""WITH b AS (SELECT user_id, ts, event_id, value, min(value) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, CASE WHEN best IS DISTINCT FROM lag(best) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS better FROM b), g AS (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM m)
SELECT user_id, event_id, round(best, 9) AS best, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) - 1 AS stale FROM g""")
def running_best_patience(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = table(spark, sf_dir, "events").withColumn("best", F.min("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = b.withColumn("better", F.coalesce((F.col("best") != F.lag("best").over(w)).cast("int"), F.lit(1))).withColumn("grp", F.sum("better").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stale = F.row_number().over(Window.partitionBy("user_id", "grp").orderBy("ts", "event_id")) - 1
    return g.select("user_id", "event_id", F.round("best", 9).alias("best"), stale.cast("long").alias("stale"))


@query("SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_retailprice) <= 1.01 * (SELECT avg(p_retailprice) FROM part) AND avg(p_size) <= 1.01 * (SELECT avg(p_size) FROM part)")
def selection_gate(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    means = [F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size")]
    return pairing.eligible(part.groupBy("p_brand").agg(*means), ["price", "size"], part.agg(*means)).select("p_brand")


KINDS = ("integer", "fraction", "json", "number", "letter")


@query("SELECT event_id, user_id % 2 = 0 AS correct FROM events")
def validator_registry(spark, sf_dir):
    # Answers of five kinds made from the events; the gold answer of every second user is another one.
    k, off = F.get_json_object("props", "$.k").cast("long"), F.col("user_id") % 2
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    answers = [text("ANSWER: ", k), text(k, "/7"), text("```json\n", F.col("props"), "\n```"), text("x #### ", k, ".50"), text("ANSWER: B\nANSWER: ", F.char(k % 26 + 65))]
    golds = [text(k + off), text(2 * k + off, "/14"), text('{"k": ', k + off, "}"), text(k + off, ".5"), text((k + off) % 26)]
    pick = lambda x: F.element_at(F.array(*x), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick([F.lit(x) for x in KINDS]).alias("kind"), pick(answers).alias("answer"), pick(golds).alias("gold"))
    return rows.select("event_id", V.validate(F.col("kind"), F.col("answer"), F.col("gold")).alias("correct"))


@query(r"SELECT page_id, CASE WHEN len(n) > 0 THEN n[len(n)] END AS last_integer FROM (SELECT page_id, regexp_extract_all(url, '/([0-9]+)', 1) AS n FROM pages)")
def extract_numeric_final(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X._last(F.regexp_extract_all("url", F.lit(r"/([0-9]+)"), F.lit(1))).alias("last_integer"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'done: ' || trim(text) WHEN 1 THEN '<think> ' || trim(text) WHEN 2 THEN 'a <|im_end|> ' || trim(text) ELSE trim(text) END AS final, turn % 4 <> 1 AS finished FROM conversations")
def final_text_split(spark, sf_dir):
    t = F.trim("text")
    around = lambda before, after: F.concat(F.lit(before), t, F.lit(after))
    response = (
        F.when(F.col("turn") % 4 == 0, around("<think>a</think>b</think> done: ", " <|im_end|><|eot|>\n")).when(F.col("turn") % 4 == 1, around("<think> ", "  <|eot|>"))
        .when(F.col("turn") % 4 == 2, around("</think>a <|im_end|> ", " ")).otherwise(around("<|start|></think>", "<|eot|> <|eot|>"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.final_text(response).alias("final"), X.finished(response).alias("finished"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS users, bool_and(role IS DISTINCT FROM prev) AS alternates FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1")
def role_alternation(spark, sf_dir):
    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", prev.alias("prev"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("users"), F.bool_and(~F.col("role").eqNullSafe(F.col("prev"))).alias("alternates"))
