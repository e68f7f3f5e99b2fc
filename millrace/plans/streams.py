"""Streaming queries run over what is there and read back; their rows equal those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from ..sources import tail
from ..storage import durable, new_path
from ..streaming import breaker, jobs, stateful
from .registry import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return jobs.with_event_time(jobs.follow(spark, f"{sf_dir}/events.parquet*", schema), "ts", "3650 days")


def published(df: DataFrame, mode: str) -> DataFrame:
    """Drain into Parquet in the folder that driver and executors share, and read it back; in complete mode the last batch is the result."""
    spark = df.sparkSession
    folder = new_path(spark, "stream")
    if mode != "complete":
        jobs.drain(df, f"{folder}/checkpoint", f"{folder}/rows", mode)
        return spark.read.schema(df.schema).parquet(f"{folder}/rows")
    written: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows-{number}")
        written.append(f"{folder}/rows-{number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(written[-1]) if written else spark.createDataFrame([], df.schema)


def in_batches(rows: DataFrame, time: str, n: int, delay: str) -> DataFrame:
    """A table as a stream of about ``n`` batches in the order of ``time``: ranges of time, written one after the other."""
    spark, folder = rows.sparkSession, new_path(rows.sparkSession, "arriving")
    at = F.col(time).cast("timestamp")
    ends = rows.agg(F.min(at.cast("double")).alias("low"), F.max(at.cast("double")).alias("high")).first()
    low, high = ends["low"] or 0.0, ends["high"] or 0.0
    part = F.least(F.floor((at.cast("double") - low) * n / max(high - low, 1e-9)), F.lit(n - 1))
    cut = durable(rows.withColumn("_part", part))
    for k in range(n):  # each is a file that arrives after the one before; the reader takes them by their times
        cut.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return jobs.with_event_time(jobs.follow(spark, folder, rows.schema, files_per_trigger=1), time, delay)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    counts = jobs.tumbling(events(spark, sf_dir), "ts", "1 day", ["event_type"], F.count("*").alias("n"))
    return published(counts, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS correct FROM events GROUP BY 1")
def stream_follow_score(spark, sf_dir):
    return published(jobs.score(events(spark, sf_dir), F.col("value") > 50, ["event_type"]), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    once = jobs.once_per_key(events(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"])
    return published(once.select("user_id", "event_type"), "append")


@query("SELECT strftime(window_end, '%Y-%m-%d %H:%M') AS window_end, n, round(n / 600.0, 9) AS per_second FROM (SELECT time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end, count(*) AS n FROM events GROUP BY 1)")
def stream_rate(spark, sf_dir):
    rate = jobs.sliding_rate(events(spark, sf_dir), "ts", "10 minutes", "10 minutes")
    return published(rate, "complete").select(F.date_format("at", "yyyy-MM-dd HH:mm").alias("window_end"), "n", F.round("per_second", 9).alias("per_second"))


#: A user without events for 5 hours is idle; the watermark is 10 minutes behind.
_IDLE = """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS after_ms, min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS first, (SELECT max(epoch_us(ts) // 1000) FROM events) - 600000 AS mark FROM events),
idle AS (SELECT * FROM e WHERE coalesce(after_ms - ms > 18000000, ms + 18000000 <= mark)),
told AS (SELECT i.user_id, i.ms, i.ms - greatest(i.first, i.ms - 86400000) AS elapsed, (SELECT count(*) FROM e WHERE e.user_id = i.user_id AND e.ms > i.ms - 86400000 AND e.ms <= i.ms) AS n FROM idle i)
SELECT CAST(user_id AS VARCHAR) AS user_id, ms AS last_ms, n, round(elapsed / 1000, 3) AS elapsed, CASE WHEN n >= 3 AND elapsed >= 60000 THEN round(1000.0 * n / elapsed, 12) END AS rate FROM told"""


@query(_IDLE)
def stream_idle_users(spark, sf_dir):
    rows = in_batches(table(spark, sf_dir, "events").select("user_id", "ts"), "ts", 6, "10 minutes")
    told = published(stateful.idle_keys(rows, "user_id", "ts", 5 * 3600, 86400, 60, 3), "append")
    return told.select(F.col("key").alias("user_id"), "last_ms", "n", F.round("elapsed", 3).alias("elapsed"), F.round("rate", 12).alias("rate"))


#: One event in 23 never arrives: rows of its user wait for it, for two days. What waits behind a gap that isn't given up yet stays inside.
_RELEASE = """WITH r AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (SELECT max(epoch_us(ts) // 1000) FROM events WHERE event_id % 23 <> 5) - 600000 AS mark FROM events),
here AS (SELECT *, seq - coalesce(lag(seq) OVER (PARTITION BY user_id ORDER BY seq), 0) > 1 AS after_gap FROM r WHERE event_id % 23 <> 5),
held AS (SELECT *, bool_or(after_gap AND ms + 172800000 > mark) OVER (PARTITION BY user_id ORDER BY seq) AS waits FROM here)
SELECT user_id, seq, event_id FROM held WHERE NOT waits"""


@query(_RELEASE)
def stream_release_in_order(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = in_batches(table(spark, sf_dir, "events").withColumn("seq", seq).where("event_id % 23 <> 5").select("user_id", "seq", "event_id", "ts"), "ts", 6, "10 minutes")
    out = published(stateful.release_in_order(rows, "user_id", "seq", "event_id", "ts", 2 * 86400, 600), "append")
    return out.select(F.col("key").alias("user_id"), "seq", F.col("value").cast("long").alias("event_id"))


#: Documents ask for admission in their language's pool, by source; five places are free, and each verdict frees one.
_ADMIT = """WITH q AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents),
o AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY turn, source_at, source) AS place FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS source_at FROM q) WHERE turn <= 4)
SELECT lang AS pool, place, source AS key, doc_id AS id FROM o"""


@query(_ADMIT)
def stream_admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    begin = F.lit("2024-01-01").cast("timestamp")
    asked = docs.select("lang", "source", "doc_id", F.lit(None).cast("boolean").alias("verdict"), begin.alias("ts"))
    # all ask first; then the admitted ones end one after the other, each accepted
    turn = F.row_number().over(Window.partitionBy("lang", "source").orderBy("doc_id"))
    number = F.substring("source", 4, 10).cast("int")
    ended = docs.withColumn("turn", turn).where("turn <= 4").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("turn", number, "source")))
    ended = ended.select("lang", "source", "doc_id", F.lit(True).alias("verdict"), F.timestamp_seconds(begin.cast("long") + 60 * F.col("place")).alias("ts"))
    keys = {f"src{i}": 4 for i in range(20)}
    out = published(stateful.admit_in_turn(in_batches(asked.unionAll(ended), "ts", 3, "1 minute"), "lang", "source", "doc_id", "verdict", "ts", keys, 5), "append")
    return out.select("pool", "place", "key", "id")


def _log(rows: DataFrame) -> str:
    """The rows as files of JSON lines, in a new folder."""
    folder = new_path(rows.sparkSession, "log")
    rows.select(F.to_json(F.struct(*rows.columns))).write.text(folder)
    return folder


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_byte_tail(spark, sf_dir):
    folder = _log(table(spark, sf_dir, "events").select("event_id", "event_type"))
    lines = tail.follow_tail(spark, folder, pattern="*.txt", bytesPerPartition=200_000)
    rows = published(lines.select("file", "start", "line"), "append").select(F.from_json("line", "event_id long, event_type string").alias("e"))
    return rows.groupBy("e.event_type").agg(F.count("*").alias("n"), F.sum("e.event_id").alias("ids"))


@query("""SELECT kind, doc_id AS id, len(ids)::BIGINT AS total, list_sum(ids)::BIGINT AS id_sum, CASE WHEN kind = 'T' THEN sha256(text) END AS prompt_sha256
FROM (SELECT doc_id, text, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents), (VALUES ('T'), ('G')) k(kind)""")
def evaluator_requests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    folder = new_path(spark, "requests")
    tail.request_lines(docs, "doc_id", "ids", "text").write.text(folder)
    rows = tail.request_records(tail.read_tail(spark, folder, pattern="*.txt"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("kind", "id", "total", total.alias("id_sum"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query("""SELECT lang, count(*) AS answers, sum(n_chars)::BIGINT AS tokens, round(sum(n_chars * 0.5) / sum(n_chars), 9) AS loss FROM documents GROUP BY 1""")
def evaluator_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    folder = new_path(spark, "answers")
    answer = F.to_json(F.struct(F.lit("ce").alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("tokens"), (F.col("n_chars") * 0.5).alias("nll")))
    docs.select(answer).write.text(folder)
    rows = tail.answer_records(tail.read_tail(spark, folder, pattern="*.txt")).where("kind = 'ce'")
    by = docs.join(rows, docs["doc_id"] == rows["id"]).groupBy("lang")
    return by.agg(F.count("*").alias("answers"), F.sum("n_tokens").alias("tokens"), F.round(F.sum("nll") / F.sum("n_tokens"), 9).alias("loss"))


#: Twelve batches by time; a batch fails if a fifth of its events are errors, and two in a row open the breaker.
_BREAKER = """WITH t AS (SELECT event_type, epoch_us(ts) / 1e6 AS at_s FROM events), e AS (SELECT min(at_s) AS low, max(at_s) AS high FROM t),
b AS (SELECT CAST(least(floor((at_s - low) * 12 / (high - low)), 11) AS BIGINT) AS batch, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM t, e GROUP BY 1),
r AS (SELECT batch, n, bad, sum((bad >= 0.2 * n)::INTEGER) OVER (ORDER BY batch ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run FROM b)
SELECT min(batch) AS opened FROM r WHERE run = 2 HAVING min(batch) IS NOT NULL"""


@query(_BREAKER)
def stream_breaker(spark, sf_dir):
    rows = in_batches(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "ts", 12, "1 day")
    watch = breaker.Breaker(spark, 2, 0.2)
    spark.streams.addListener(watch)
    try:
        folder = new_path(spark, "guarded")
        guarded = breaker.watched(rows, F.col("event_type") == "error")
        breaker.run_guarded(guarded.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(), watch)
    finally:
        spark.streams.removeListener(watch)
    return spark.createDataFrame([(watch.opened,)] if watch.opened is not None else [], "opened long")
