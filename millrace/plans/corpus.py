"""Corpus queries: normal forms, deduplication, overlap with held-out items, sampling, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import admission, dedup, overlap, sampling, similarity
from ..session import table
from .registry import query

_FOLDED = "translate(lower({})" + f", '{''.join(X.SAME)}', '{''.join(X.SAME.values())}')"
for _letter, _spelled in X.FOLDS.items():
    _FOLDED = f"replace({_FOLDED}, '{_letter}', '{_spelled}')"
NORM = "array_to_string(regexp_extract_all(" + _FOLDED + r", '[\p{{L}}\p{{N}}_]+'), ' ')"
N = NORM.format("text")
WORDS = f"CASE WHEN {N} = '' THEN [] ELSE string_split({N}, ' ') END"
GRAMS = """SELECT DISTINCT {id}, array_to_string(w[i:i+7], ' ') AS gram FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 7)) AS i FROM (SELECT {id}, {words} AS w FROM {table}) WHERE len(w) >= 8)"""
DG, IG = GRAMS.format(id="doc_id", words=WORDS, table="documents"), GRAMS.format(id="item_id", words=WORDS, table="benchmark")
PAIRS = f"""
WITH d AS ({DG}), i AS ({IG}), nd AS (SELECT doc_id, count(*) n FROM d GROUP BY 1), ni AS (SELECT item_id, count(*) m FROM i GROUP BY 1),
pairs AS (
  SELECT doc_id, item_id, hits, round(hits / greatest(1, least(n, m)), 9) AS share
  FROM (SELECT doc_id, item_id, count(*) hits FROM d JOIN i USING (gram) GROUP BY 1, 2) JOIN nd USING (doc_id) JOIN ni USING (item_id)
  WHERE hits >= 3 AND hits / greatest(1, least(n, m)) >= 0.55)
"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_pairs(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(PAIRS + "SELECT doc_id, item_id, hits, share FROM pairs")
def decontam_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("share", F.round("share", 9))


@query(PAIRS + "SELECT doc_id, item_id, hits, share FROM pairs")
def similar_pairs_by_prefix(spark, sf_dir):
    out = similarity.similar_pairs(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return out.withColumn("share", F.round("share", 9))


@query(PAIRS + "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pairs)")
def decontam_clean_docs(spark, sf_dir):
    return overlap.clean(docs(spark, sf_dir), _pairs(spark, sf_dir), "doc_id").select("doc_id", "lang", "n_chars")


@query(f"""WITH d AS ({DG}), k AS (SELECT DISTINCT gram FROM ({IG})), n AS (SELECT doc_id, count(*) n FROM d GROUP BY 1)
SELECT doc_id, n, hits FROM (SELECT doc_id, count(*) hits FROM d WHERE gram IN (SELECT gram FROM k) GROUP BY 1) JOIN n USING (doc_id) WHERE hits >= greatest(3, 0.02 * n)""")
def decontam_global_grams(spark, sf_dir):
    return overlap.global_overlap(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", min_share=0.02)


@query(f"""SELECT DISTINCT doc_id FROM (SELECT doc_id, {N} AS f FROM (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) UNION ALL SELECT doc_id, {N} FROM (SELECT doc_id, 'Question: ' || text AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)))
WHERE f <> '' AND f IN (SELECT {N} FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)))""")
def exposure_exact(spark, sf_dir):
    all_docs = docs(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    lines = all_docs.join(labels, "doc_id", "left_anti").select(F.explode(F.split("text", "\n")).alias("line"))
    t = F.col("text")
    return overlap.exposed(all_docs.join(labels, "doc_id", "left_semi"), "doc_id", [F.element_at(F.split(t, "\n"), 1), F.concat(F.lit("Question: "), t)], lines, F.col("line"))


@query(f"SELECT doc_id, sha256({N}) AS norm_sha256, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS weak_sha256 FROM documents")
def norm_text(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.norm(t), 256).alias("norm_sha256"), F.sha2(X.weak_norm(t), 256).alias("weak_sha256"))


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY {N} ORDER BY doc_id) = 1")
def first_wins_dedup(spark, sf_dir):
    return dedup.first_wins(docs(spark, sf_dir), X.norm(F.col("text")), ["doc_id"]).select("doc_id", "lang")


@query(f"SELECT sha256({N}) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(docs(spark, sf_dir), F.sha2(X.norm(F.col("text")), 256), "doc_id")


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents), f AS (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY 1, 2)
SELECT doc_id, count(*)::INTEGER AS n_distinct, sha256(string_agg(word, ' ' ORDER BY pos)) AS in_order FROM f GROUP BY 1""")
def ordered_distinct(spark, sf_dir):
    own = F.array_distinct(F.split("text", " "))
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.size(own).alias("n_distinct"), F.sha2(F.array_join(own, " "), 256).alias("in_order"))


@query(f"SELECT doc_id, count(*) AS n FROM ({DG}) GROUP BY 1")
def shingle_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(X.shingles(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("""SELECT lang, CASE WHEN CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 20 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL""")
def hash_split_counts(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang", X.hash_split(F.col("text")).alias("split")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY sha256('seed7' || CAST(doc_id AS VARCHAR)) LIMIT 100")
def hash_order_sample(spark, sf_dir):
    return sampling.hash_sample(docs(spark, sf_dir).select("doc_id"), F.col("doc_id"), 100, "seed7")


@query("SELECT source, CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 = 9 THEN 'validation' ELSE 'train' END AS split, doc_id FROM documents")
def stride_split(spark, sf_dir):
    turned = sampling.round_robin(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")
    return turned.select("source", F.when((F.col("turn") - 1) % 10 == 9, "validation").otherwise("train").alias("split"), "doc_id")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= 13")
def quota_per_source(spark, sf_dir):
    return sampling.quota(docs(spark, sf_dir), ["source"], [X.hash_order(F.col("doc_id"))], 13).select("source", "doc_id")


@query("SELECT lang, quota, coalesce(have, 0) AS have, quota - coalesce(have, 0) AS missing FROM (VALUES ('en', 1::BIGINT), ('de', 1000000), ('xx', 5)) q(lang, quota) LEFT JOIN (SELECT lang, count(*) have FROM documents GROUP BY 1) USING (lang) WHERE quota > coalesce(have, 0)")
def quota_shortfall(spark, sf_dir):
    quotas = spark.createDataFrame([("en", 1), ("de", 1000000), ("xx", 5)], "lang string, quota long")
    return sampling.quota_shortfall(docs(spark, sf_dir), quotas, ["lang"])


@query("SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, source, doc_id FROM documents")
def round_robin_interleave(spark, sf_dir):
    turned = sampling.round_robin(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id")
    return turned.select("turn", "source", "doc_id")


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM documents)
SELECT source, doc_id FROM r WHERE len(list_filter([0,1,2,3,4,5,6,7,8,9,10,11,12], lambda k: (k * size) // 13 = pos)) > 0""")
def stratified_13(spark, sf_dir):
    return sampling.evenly_spaced(docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 13)


@query("SELECT target, rank, doc_id, n_chars FROM (SELECT t.target, doc_id, n_chars, row_number() OVER (PARTITION BY t.target ORDER BY abs(n_chars - t.target), doc_id) AS rank FROM documents, (VALUES (500::BIGINT), (2000), (8000)) t(target)) WHERE rank <= 2")
def nearest_length(spark, sf_dir):
    targets = [500, 2000, 8000]
    out = sampling.nearest_by(docs(spark, sf_dir).select("doc_id", "n_chars"), targets, "n_chars", "target", "doc_id", 2)
    return out.select(F.col("target").cast("long").alias("target"), F.col("rank").cast("long").alias("rank"), "doc_id", "n_chars")


@query(PAIRS + f""", r AS (SELECT d.doc_id, CASE WHEN row_number() OVER (PARTITION BY {N} ORDER BY d.doc_id) > 1 THEN 'duplicate' WHEN d.doc_id IN (SELECT doc_id FROM pairs) THEN 'overlap' WHEN length(text) > 8000 THEN 'long' END AS reason FROM documents d)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def reject_reason_histogram(spark, sf_dir):
    hit = _pairs(spark, sf_dir).select("doc_id", F.lit(True).alias("hit")).distinct()
    rank = F.row_number().over(Window.partitionBy(X.norm(F.col("text"))).orderBy("doc_id"))
    rows = docs(spark, sf_dir).withColumn("rank", rank).join(hit, "doc_id", "left")
    reason = admission.first_reason([("duplicate", F.col("rank") > 1), ("overlap", F.col("hit")), ("long", F.length("text") > 8000)])
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, max(n) AS repeats FROM (SELECT doc_id, line, count(*) n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 45 GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 4")
def repetition_lines(spark, sf_dir):
    return dedup.repeated_lines(docs(spark, sf_dir), "doc_id", "text")


@query(f"""SELECT doc_id, max(n) AS repeats FROM (SELECT doc_id, c, count(*) n FROM (SELECT doc_id, array_to_string(w[i:i+31], ' ') AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 31, 16)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 32)) GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 4""")
def repetition_chunks(spark, sf_dir):
    return dedup.repeated_chunks(docs(spark, sf_dir), "doc_id", "text")


@query("""SELECT mixture_source, count(*) AS n, count(lang) AS with_lang, sum(length(text))::BIGINT AS chars FROM (
SELECT 'documents' AS mixture_source, text, lang FROM documents UNION ALL SELECT 'benchmark', text, NULL FROM benchmark UNION ALL SELECT 'conversations', text, NULL FROM conversations) GROUP BY 1""")
def mixture_union_provenance(spark, sf_dir):
    parts = {"documents": docs(spark, sf_dir).select("text", "lang"), "benchmark": table(spark, sf_dir, "benchmark").select("text"), "conversations": table(spark, sf_dir, "conversations").select("text")}
    mixed = admission.mixture(parts)
    return mixed.groupBy("mixture_source").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH s AS (SELECT doc_id, {N} AS k, CASE WHEN CAST('0x' || substr(sha256({N}), 1, 8) AS BIGINT) % 20 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents)
SELECT count(*) AS shared FROM (SELECT k FROM s WHERE split = 'train' INTERSECT SELECT k FROM s WHERE split = 'validation')""")
def split_disjointness(spark, sf_dir):
    keyed = docs(spark, sf_dir).select(X.norm(F.col("text")).alias("k")).withColumn("split", X.hash_split(F.col("k")))
    side = lambda s: keyed.where(F.col("split") == s).select("k")
    return side("train").intersect(side("validation")).agg(F.count("*").alias("shared"))


@query("""SELECT CASE WHEN CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 20 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n, sum(n_chars)::BIGINT AS tokens,
CAST(sum(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(31) || text), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM documents GROUP BY 1""")
def manifest_stats(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("split", X.hash_split(F.col("text")))
    return admission.manifest(rows, "split", "doc_id", F.col("n_chars"), F.col("text"))


@query("""SELECT lang, avg(n_chars) AS mean, median(n_chars) AS median, max(n_chars) AS longest, list_sort(list(n_chars))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95,
list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, quantile_cont(n_chars, 0.95) AS p95_linear FROM documents GROUP BY 1""")
def length_stats(spark, sf_dir):
    by_length = Window.partitionBy("lang").orderBy("n_chars")
    counts = docs(spark, sf_dir).groupBy("lang", "n_chars").agg(F.count("n_chars").alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(by_length)).withColumn("n", F.sum("c").over(Window.partitionBy("lang")))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("n_chars")))
    return counts.groupBy("lang").agg(
        F.try_divide(F.sum(F.col("n_chars") * F.col("c")), F.sum("c")).alias("mean"), F.percentile("n_chars", 0.5, F.col("c")).alias("median"), F.max("n_chars").alias("longest"),
        at(F.floor(0.95 * (F.col("n") - 1))).alias("p95"), at(F.expr("n div 2")).alias("upper_median"), F.percentile("n_chars", 0.95, F.col("c")).alias("p95_linear"),
    )


@query("SELECT lang, count(*) FILTER (n_chars > 2048) AS over_2048, count(*) FILTER (n_chars > 4096) AS over_4096, count(*) FILTER (n_chars > 8192) AS over_8192 FROM documents GROUP BY 1")
def length_over_thresholds(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(*[F.count_if(F.col("n_chars") > k).alias(f"over_{k}") for k in (2048, 4096, 8192)])


@query("SELECT least(2, n_chars // 2000) AS bucket, lang, count(*) AS n FROM documents GROUP BY ALL")
def length_buckets(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.least(F.lit(2).cast("long"), F.expr("n_chars div 2000")).alias("bucket"), "lang").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND contains(text, 'the') AND n_chars <= 4000 AND NOT regexp_matches(text, '(?i)\b(prove|proof|show that)\b')")
def conjunction_filter(spark, sf_dir):
    t = F.col("text")
    keep = F.col("lang").isin("en", "de") & F.contains(t, F.lit("the")) & (F.col("n_chars") <= 4000) & ~t.rlike(r"(?i)\b(prove|proof|show that)\b")
    return docs(spark, sf_dir).where(keep).select("doc_id")


@query("SELECT doc_id, CAST(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS INTEGER) AS n_words, " + f"len(list_filter({WORDS}, lambda w: w = 'the')) AS n_the FROM documents")
def word_counts(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", X.word_count(t).alias("n_words"), X.occurrences(t, "the").cast("long").alias("n_the"))


@query("SELECT rule, failed FROM (SELECT 'short' AS rule, count(*) FILTER (NOT n_chars <= 20000) AS failed FROM documents UNION ALL SELECT 'english', count(*) FILTER (NOT lang = 'en') FROM documents UNION ALL SELECT 'counted', count(*) FILTER (NOT n_chars = length(text)) FROM documents) WHERE failed > 0")
def expectation_violations(spark, sf_dir):
    return admission.violations(docs(spark, sf_dir), {"short": F.col("n_chars") <= 20000, "english": F.col("lang") == "en", "counted": F.col("n_chars") == F.length("text")})


@query("SELECT '| ' || lang || ' | ' || CAST(n AS VARCHAR) || ' |' AS line FROM (SELECT lang, count(*) n FROM documents GROUP BY 1)")
def markdown_report(spark, sf_dir):
    from ..sources.files import report_rows

    return report_rows(docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n")), ["lang", "n"])


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '(?:/[A-Za-z0-9_.-]+)+/([A-Za-z0-9_.-]+)', 'LOCAL/\1', 'g') AS scrubbed FROM pages")
def scrub_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.scrub_paths(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)).alias("scrubbed"))


@query("SELECT doc_id, 'Answer in ' || lang || ' (' || CAST(n_chars AS VARCHAR) || '): ' || source AS prompt, hex(encode(source)) AS source_hex FROM documents")
def templated_prompts(spark, sf_dir):
    filled = X.fill("Answer in {lang} ({n}): {source}", lang=F.col("lang"), n=F.col("n_chars"), source=F.col("source"))
    return docs(spark, sf_dir).select("doc_id", filled.alias("prompt"), F.hex("source").alias("source_hex"))
