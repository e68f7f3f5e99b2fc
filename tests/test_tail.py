"""Byte-range reading of growing files: no half line, no line twice, restarts at the byte."""

import random

import pytest
from millrace.sources import tail
from millrace.streaming import jobs


@pytest.mark.parametrize("width", [1, 7, 64, 10**6])
@pytest.mark.parametrize("text", [b"", b"no line feed", b"\n", b"\n\n\n", b"a\nbb\n\nccc\nlast without end", "é\nßß\n日本\n".encode(), b"x" * 200_000 + b"\nshort\n"])
def test_ranges_give_each_complete_line_once(tmp_path, text, width):
    if width == 1 and len(text) > 1000:
        width = 999
    file = tmp_path / "log"
    file.write_bytes(text)
    end = tail.complete_end(str(file), 0, len(text))
    assert end == text.rfind(b"\n") + 1
    got = [x for r in tail.ranges(str(file), 0, end, width) for x in tail.lines_of(r)]
    assert [line for _, line in got] == text[:end].split(b"\n")[:-1]
    assert all(text[p : p + len(line)] == line for p, line in got)


def test_ends_are_looked_for_block_by_block(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 4)
    file = tmp_path / "log"
    file.write_bytes(b"abc\ndefghijklmnop")
    assert tail.complete_end(str(file), 0, 17) == 4 and tail.complete_end(str(file), 4, 17) == 4


def test_batch_reader(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"part{n}.log").write_text("".join(f"line {n} {i}\n" for i in range(50)) + "unfinished")
    (tmp_path / "other.txt").write_text("not this\n")
    (tmp_path / ".hidden.log").write_text("nor this\n")
    df = tail.read_tail(spark, str(tmp_path), pattern="*.log", bytesPerPartition=100)
    assert sorted(r.line for r in df.collect()) == sorted(f"line {n} {i}" for n in range(3) for i in range(50))
    assert df.rdd.getNumPartitions() > 10
    assert tail.read_tail(spark, str(tmp_path / "missing")).collect() == []
    assert tail.read_tail(spark, f"file:{tmp_path}/part0.log").count() == 50


def test_a_stream_restarts_at_the_byte_and_waits_for_the_end_of_a_line(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()

    def take():
        jobs.drain(tail.follow_tail(spark, str(log), bytesPerPartition=16), str(tmp_path / "checkpoint"), folder)
        return sorted((r.file.rsplit("/", 1)[1], r.start, r.line) for r in spark.read.parquet(folder).collect())

    (log / "a").write_bytes(b"one\ntwo\nthr")
    assert take() == [("a", 0, "one"), ("a", 4, "two")]
    assert len(take()) == 2  # nothing new
    with (log / "a").open("ab") as f:
        f.write(b"ee\nfour")
    (log / "b").write_bytes("größer\n".encode())
    assert take() == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "three"), ("b", 0, "größer")]
    with (log / "a").open("ab") as f:
        f.write(b"\n")
    assert ("a", 14, "four") in take()
    (log / "a").write_bytes(b"cut\n")
    with pytest.raises(Exception, match="were read before"):
        take()


def test_request_and_answer_records(spark):
    jobs_ = spark.createDataFrame([(7, [1, 20, 300], "Grüße\n"), (8, [], "")], "id long, ids array<long>, prompt string")
    lines = tail.request_lines(jobs_, "id", "ids", "prompt")
    assert {r.line for r in lines.collect()} >= {"T 7 3 3 1 20 300 4772c3bcc39f650a", "G 7 3 3 1 20 300"}
    got = {(r.kind, r.id): (r.prompt_tokens, r.total, r.ids, r.prompt) for r in tail.request_records(lines).where("id = 7").collect()}
    assert got == {("T", 7): (3, 3, [1, 20, 300], "Grüße\n"), ("G", 7): (3, 3, [1, 20, 300], None)}
    more = spark.createDataFrame([(x,) for x in ["E 1 2 4 9 8 7 6", "L 2 1 1 5", "E 1 2 4 9 8 7", "E 1 5 4 9 8 7 6", "X 1 1 1 1", "", "E a 1 1 1", "T 1 1 1 5 zz", "E 1 1 2 5 x"]], "line string")
    assert [(r.kind, r.prompt_tokens, r.ids) for r in tail.request_records(more).collect()][:2] == [("E", 2, [9, 8, 7, 6]), ("L", 1, [5])]
    assert [r.kind for r in tail.request_records(more).collect()][2:] == [None] * 5 + ["T", None]  # hex that isn't any has no text
    answers = ['{"kind":"ce","id":3,"tokens":10,"nll":2.5}', '{"kind":"generation","id":4,"tokens":[5,6],"seconds":1.5,"prefill_seconds":0.5,"finish_reason":"eos"}', '{"kind":"logits","id":5,"logits":[0.5,-1]}', "load: 3 tensors", '{"kind":"ce"', '{"kind":"other","id":1}']
    rows = tail.answer_records(spark.createDataFrame([(x,) for x in answers], "line string")).collect()
    assert [(r.kind, r.id) for r in rows] == [("ce", 3), ("generation", 4), ("logits", 5), (None, None), (None, None), (None, None)]
    assert rows[0].n_tokens == 10 and rows[0].nll == 2.5 and rows[1].generated == [5, 6] and rows[1].finish_reason == "eos" and rows[2].logits == [0.5, -1.0]


def test_random_growth(tmp_path):
    """Any sequence of appends and reads gives every complete line once."""
    rng = random.Random(5)
    file, stream = tmp_path / "log", tail.TailStream({"path": str(tmp_path / "log"), "bytesperpartition": "9"})
    written, got, at = b"", [], stream.initialOffset()
    for _ in range(60):
        more = bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(12)))
        written += more
        with file.open("ab") as f:
            f.write(more)
        end = stream.latestOffset()
        got += [r for p in stream.partitions(at, end) for b in stream.read(p) for r in b.column("line").to_pylist()]
        at = end
    assert got == [x.decode() for x in written[: written.rfind(b"\n") + 1].split(b"\n")[:-1]]
