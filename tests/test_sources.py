"""Record files, sinks, expectations and streams."""

import gzip
import json

import pyarrow as pa
import pytest
from millrace.operators import admission, sampling
from millrace.sources import files
from millrace.streaming import jobs
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def test_partial_tail_is_quarantined(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1, "text": "a"}\n{"id": 2, "text": "b"}\n{"id": 3, "te')
    good, bad = files.read_jsonl(spark, str(tmp_path / "log.jsonl"), SCHEMA)
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert [r.record for r in bad.collect()] == ['{"id": 3, "te']
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        files.read_jsonl(spark, str(tmp_path / "log.jsonl"), SCHEMA, strict=True)[0].collect()


def test_unfinished_last_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1, "text": "a"}\n{"id": 2, "text": "b"}')
    good, bad = files.read_jsonl(spark, str(tmp_path / "log.jsonl"), SCHEMA, complete_only=True)
    assert [r.id for r in good.collect()] == [1] and [r.record for r in bad.collect()] == ['{"id": 2, "text": "b"}']
    files.write_quarantine(bad, str(tmp_path / "bad"))
    assert [r.record for r in spark.read.json(str(tmp_path / "bad")).collect()] == ['{"id": 2, "text": "b"}']
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"id": 7, "text": "z"}\n')
    assert [r.id for r in files.read_jsonl(spark, str(tmp_path / "z.jsonl.gz"), SCHEMA)[0].collect()] == [7]


def test_arrow_losses_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = pa.table({"extra": [0, 0], "id": [1, 2], "text": ["a", None]})
    with pa.ipc.new_file(str(tmp_path / "in/a.arrow"), table.schema) as w:
        w.write_table(table)
    with pa.ipc.new_stream(str(tmp_path / "in/b.arrow"), table.schema) as w:
        w.write_table(table)
    assert sorted(r.id for r in files.read_arrow(spark, str(tmp_path / "in"), SCHEMA).collect()) == [1, 1, 2, 2]
    (tmp_path / "out.txt").write_text("E a 10 20.0\nE b 30 30\nG c 1 x\nnoise\n")
    losses = files.read_losses(spark, str(tmp_path / "out.txt"))
    assert [tuple(r) for r in files.per_token(losses, ["kind"]).collect()] == [("E", 40, 1.25)]
    path = str(tmp_path / "t")
    files.write_replacing(spark.range(3), path)
    files.write_replacing(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    files.write_csv(spark.createDataFrame([(1, 'a "b", c')], SCHEMA), str(tmp_path / "csv"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "csv"), SCHEMA).collect()] == [(1, 'a "b", c')]
    files.write_manifest(spark.range(2), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    files.write_matrix(spark.createDataFrame([(1, [1.0, 2.0]), (0, [3.0, 4.0])], "k long, v array<float>"), "k", "v", str(tmp_path / "x"))
    assert [list(r["values"]) for r in spark.read.parquet(str(tmp_path / "x")).orderBy("row").collect()] == [[3.0, 4.0], [1.0, 2.0]]
    files.write_once(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), str(tmp_path / "split"), partition_by="text")
    assert sorted(p.name for p in (tmp_path / "split").glob("text=*")) == ["text=a", "text=b"]


def test_copies_of_files(spark, tmp_path):
    for side, names in (("a", {"x": "1", "y": "2", "only": "3"}), ("b", {"x": "1", "y": "other", "more": "4"})):
        (tmp_path / side).mkdir()
        for name, text in names.items():
            (tmp_path / side / name).write_text(text)
    a, b = (files.file_hashes(spark, str(tmp_path / s)) for s in "ab")
    assert sorted(map(tuple, files.same_files(a, b).collect())) == [("more", "only_b"), ("only", "only_a"), ("y", "differs")]
    assert {r.problem for r in files.same_files(a, a).collect()} == {"same_file"}


def test_documents_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "text": "x"}, {"id": 2, "text": None}]))
    assert files.read_json_array(spark, str(tmp_path / "a.json"), SCHEMA).count() == 2
    (tmp_path / "o.json").write_text('{"files": {"train": {"n": 3}}}')
    assert files.read_open_object(spark, str(tmp_path / "o.json")).select(F.variant_get("value", "$.files.train.n", "int")).first()[0] == 3
    (tmp_path / "c.csv").write_text("id,text\n1,\"['a', 'b']\"\n")
    got = files.read_csv(spark, str(tmp_path / "c.csv"), SCHEMA).select(files.literal_list(F.col("text")).alias("x")).first().x
    assert got == ["a", "b"]
    lists = spark.createDataFrame([("""["it's", 'say "x"', '']""",), ("[1]",), ("os.system('x')",), (None,)], "t string").select(files.literal_list(F.col("t"))).collect()
    assert [r[0] for r in lists] == [["it's", 'say "x"', ""], None, None, None]


def test_hashes_and_write_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("abc")
    assert files.file_hashes(spark, str(tmp_path / "in")).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    files.write_once(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(spark.range(3), str(tmp_path / "out"))


def test_strings_under(spark):
    spark.udtf.register("strings_under", files.StringsUnder)
    text = json.dumps({"a": [{"question": "q1", "x": 1}, {"deep": {"prompt": "p1", "question": ["q2", "q3"]}}]})
    rows = spark.createDataFrame([(text,), ("not json",)], "t string")
    rows.createOrReplaceTempView("_texts")
    got = spark.sql("SELECT key, value FROM _texts, LATERAL strings_under(t, 'question,prompt')").collect()
    assert sorted(map(tuple, got)) == [("prompt", "p1"), ("question", "q1"), ("question", "q2"), ("question", "q3")]


def test_expectations(spark):
    df = spark.range(5)
    assert [tuple(r) for r in admission.violations(df, {"small": F.col("id") < 3, "fine": F.col("id") >= 0}).collect()] == [("small", 2)]
    assert admission.require(df, {"fine": F.col("id") >= 0}).count() == 5
    with pytest.raises(Exception, match="expectation failed: small"):
        admission.require(df, {"small": F.col("id") < 3}).collect()


def test_language_slots(spark):
    df = spark.createDataFrame([("ru", i) for i in range(4)] + [("en", i) for i in range(4)], "lang string, n int")
    rows = sampling.language_slots(df, "lang", "n", ["ru", "en", "en"]).orderBy("slot").collect()
    assert [r.lang for r in rows[:6]] == ["ru", "en", "en", "ru", "en", "en"]
    rows = sampling.language_slots(df, "lang", "n", ["ru", "fr", "en"], fallback="en").orderBy("slot").collect()
    assert [r.lang for r in rows[:4]] == ["ru", "en", "en", "ru"]


def test_ranks_across_cells(spark):
    df = spark.createDataFrame([(g, i * 7 - 50) for g, n in (("a", 40), ("b", 3), (None, 5)) for i in range(n)], "g string, k long")
    rows = sampling.ranked(df, "g", "k", cell=16).collect()
    for g, n in (("a", 40), ("b", 3), (None, 5)):
        own = sorted((r.k, r["rank"], r["size"]) for r in rows if r.g == g)
        assert [x[1:] for x in own] == [(i + 1, n) for i in range(n)]
    used = df.where("k = -50")
    assert [(r.target, r.k) for r in sampling.nearest_by(df.where("g = 'a'"), [-49], "k", "target", "k", 2, used=used).orderBy("rank").collect()] == [(-49, -43), (-49, -36)]
    quotas = spark.createDataFrame([("a", 50), ("b", 3), ("c", 1)], "g string, quota long")
    got = {r.g: (r.quota, r.have, r.missing) for r in sampling.quota_balance(df.where("g IS NOT NULL"), quotas, ["g"]).collect()}
    assert got == {"a": (50, 40, 10), "b": (3, 3, 0), "c": (1, 0, 1)}


def test_stream_release_in_order(spark, tmp_path):
    batches = [[(1, 2, "b"), (1, 3, "c"), (2, 1, "x")], [(1, 1, "a"), (1, 5, "e")], [(1, 4, "d"), (1, 2, "again")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, n long, v string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.StringType())])
    stream = jobs.in_order(jobs.follow(spark, str(tmp_path / "in/*"), schema, files_per_trigger=1), "k", "n", "v")
    jobs.drain(stream, str(tmp_path / "check"), str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.n, r.v) for r in out.where("k = 1").collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_stream_gives_up_on_gaps(spark, tmp_path):
    spark.createDataFrame([(1, n, str(n)) for n in (2, 3, 5)], "k long, n long, v string").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.StringType())])
    stream = jobs.in_order(jobs.follow(spark, str(tmp_path / "in/*"), schema), "k", "n", "v", most_waiting=2)
    jobs.drain(stream, str(tmp_path / "check"), str(tmp_path / "out"))
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()] == [2, 3]


def test_stream_admits_up_to_a_quota(spark, tmp_path):
    none = None
    batches = [[("a", 1, none), ("a", 2, none), ("a", 3, none), ("b", 1, none)], [("a", 4, False), ("a", 5, none), ("a", 6, none)], [("a", 7, True), ("a", 8, none)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "g string, n long, ok boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ok", T.BooleanType())])
    stream = jobs.admit(jobs.follow(spark, str(tmp_path / "in/*"), schema, files_per_trigger=1), "g", "n", "ok", 2)
    jobs.drain(stream, str(tmp_path / "check"), str(tmp_path / "out"))
    got = {(r.g, r.n): r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True, ("a", 5): True, ("a", 6): False, ("a", 8): False}


def test_stop_file_and_stalls(spark, tmp_path):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = rate.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    (tmp_path / "STOP").touch()
    assert jobs.run_until(query, (tmp_path / "STOP").exists, 0.2) and not query.isActive
    rates = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00'), ('b', TIMESTAMP '2024-01-01 00:09:00') t(k, at)")
    got = jobs.stalled(rates, F.lit("2024-01-01 00:10:00").cast("timestamp"), 300).orderBy("k").collect()
    assert [(r.idle_seconds, r.stalled) for r in got] == [(600.0, True), (60.0, False)]


def test_streams_pair_within_a_delay(spark, tmp_path):
    for side, rows in (("l", [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")]), ("r", [(1, "2024-01-01 00:03:00"), (2, "2024-01-01 00:20:00")])):
        spark.createDataFrame(rows, "k long, t string").selectExpr("k", "timestamp(t) AS t").coalesce(1).write.parquet(str(tmp_path / side))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.TimestampType())])
    left, right = (jobs.with_event_time(jobs.follow(spark, str(tmp_path / s), schema), "t", "1 hour") for s in "lr")
    jobs.drain(jobs.paired(left, right, "k", "t", "5 minutes"), str(tmp_path / "check"), str(tmp_path / "out"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_stream_restart_goes_on(spark, tmp_path):
    write = lambda i, rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    run = lambda: jobs.drain(jobs.follow(spark, str(tmp_path / "in/*"), SCHEMA), str(tmp_path / "check"), str(tmp_path / "out"))
    write(0, [(1, "a")])
    run()
    write(1, [(2, "b")])
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_a_replaced_table_is_whole_at_every_step(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_replacing(spark.range(5), path)
    files.write_replacing(spark.read.parquet(path).where("id > 1"), path)  # reads what it replaces
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]
    # cut off before the swap: the old table; between the renames: the new one
    spark.range(9).write.parquet(path + ".new")
    files.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    spark.range(9).write.parquet(path + ".new")
    (tmp_path / "t").rename(tmp_path / "t.old")
    files.recover(spark, path)
    assert spark.read.parquet(path).count() == 9 and not (tmp_path / "t.old").exists()


def test_superseded_steps_are_archived(spark, tmp_path):
    path, archive = str(tmp_path / "log"), str(tmp_path / "archive")
    rows = [(i, i * i) for i in range(10)] + [(None, 0)]
    spark.createDataFrame(rows, "step long, loss long").write.parquet(path)
    assert files.truncate_log(spark, path, "step", 6, archive) == {"restored_step": 6, "last_logged_step": 9, "kept": 7, "superseded": 4}
    assert sorted(r.step for r in spark.read.parquet(path).collect()) == list(range(7))
    assert spark.read.parquet(archive).count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        files.truncate_log(spark, path, "step", 3, archive)
    assert spark.read.parquet(path).count() == 7
