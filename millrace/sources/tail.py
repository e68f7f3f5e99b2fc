"""Line files that are still being written: a Python data source whose offsets are bytes, for batches and streams.

A file is cut into byte ranges, a partition each; a range holds the lines that begin in it. The last line of a file counts once its line
feed is there, so no reader ever sees half a line. A stream's offset is the number of bytes taken of each file: a restart goes on at
that byte, and a file that has become shorter than what was taken of it is an error.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK, ROWS = 1 << 16, 5000
SCHEMA = pa.schema([("file", pa.string()), ("start", pa.int64()), ("line", pa.string())])


@dataclass
class ByteRange(InputPartition):
    """Lines of ``file`` that begin in ``[start, end)``; ``first`` is a place where a line begins, at or before ``start``."""

    file: str
    first: int
    start: int
    end: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and its path there."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def files_below(path: str, pattern: str) -> list[tuple[str, int]]:
    """``(path, bytes)`` of one file, or of a folder's files whose names match and don't begin with ``.`` or ``_``."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    base = path.rstrip("/")
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    names = [(base + f.path[len(at.rstrip("/")) :], f) for f in found if f.type == pafs.FileType.File]
    return sorted((p, f.size) for p, f in names if fnmatch(posixpath.basename(p), pattern) and posixpath.basename(p)[0] not in "._")


def complete_end(path: str, begin: int, size: int) -> int:
    """The place after the last line feed in ``[begin, size)``, or ``begin``; looks backwards, a block at a time."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        stop = size
        while stop > begin:
            start = max(begin, stop - BLOCK)
            f.seek(start)
            feed = f.read(stop - start).rfind(b"\n")
            if feed >= 0:
                return start + feed + 1
            stop = start
    return begin


def ranges(file: str, begin: int, end: int, width: int) -> list[ByteRange]:
    return [ByteRange(file, begin, start, min(end, start + width)) for start in range(begin, end, width)]


def lines_of(part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """``(place, line)`` without line feeds."""
    fs, at = opened(part.file)
    with fs.open_input_file(at) as f:
        place = part.start
        f.seek(place)
        held = b""
        if place > part.first:  # the line that covers the byte before belongs to the range before
            f.seek(place - 1)
            place, skipping = place - 1, True
        else:
            skipping = False
        while place < part.end:
            block = f.read(max(BLOCK, len(held)))  # doubling, for very long lines
            if not block:
                return
            held += block
            cut = held.split(b"\n")
            held = cut.pop()
            for line in cut:
                if place >= part.end:
                    return
                if not skipping:
                    yield place, line
                skipping = False
                place += len(line) + 1


def batches(part: ByteRange) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.file] * len(rows)), pa.array([p for p, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], schema=SCHEMA)

    for place, line in lines_of(part):
        rows.append((place, line.decode("utf-8", "replace")))
        if len(rows) == ROWS:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


class TailReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern, self.width = options["path"], options.get("pattern", "*"), int(options.get("bytesperpartition", 16 << 20))

    def partitions(self) -> Sequence[InputPartition]:
        return [r for p, size in files_below(self.path, self.pattern) for r in ranges(p, 0, complete_end(p, 0, size), self.width)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.end:
            yield from batches(partition)


class TailStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.width = int(options.get("bytesperpartition", 16 << 20))
        self.taken: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in files_below(self.path, self.pattern):
            begin = self.taken.get(path, 0)
            if size < begin:
                raise ValueError(f"{path} has {size} bytes, of which {begin} were read before")
            self.taken[path] = complete_end(path, begin, size)
        return dict(self.taken)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        for path, at in start.items():  # after a restart, what was taken before
            self.taken[path] = max(self.taken.get(path, 0), at)
        return [r for p, stop in sorted(end.items()) for r in ranges(p, start.get(p, 0), stop, self.width)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        yield from batches(partition)


class TailSource(DataSource):
    """Options: ``path`` (a file or folder), ``pattern`` of file names, ``bytesPerPartition``. Columns: ``file, start, line``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, start long, line string"

    def reader(self, schema: T.StructType) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: T.StructType) -> TailStream:
        return TailStream({k.lower(): v for k, v in self.options.items()})


def read_tail(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.read.format("tail").options(**options).load(path)


def follow_tail(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").options(**options).load(path)


def request_lines(jobs: DataFrame, id_col: str, ids_col: str, prompt_col: str) -> DataFrame:
    """``line``: for each job a ``T`` record (id, number of ids twice, ids, prompt in hex) and a ``G`` record without the prompt."""
    n = F.size(ids_col).cast("string")
    base = F.concat_ws(" ", F.col(id_col).cast("string"), n, n, F.array_join(F.transform(ids_col, lambda x: x.cast("string")), " "))
    pair = F.array(F.concat_ws(" ", F.lit("T"), base, F.lower(F.hex(F.encode(prompt_col, "UTF-8")))), F.concat(F.lit("G "), base))
    return jobs.select(F.explode(pair).alias("line"))


def request_records(lines: DataFrame) -> DataFrame:
    """``(kind, id, prompt_tokens, total, ids, prompt)`` of T, E, G and L records; null ``kind`` where a line isn't one.

    A record is ``KIND id p n`` and ``n`` token ids; a T record ends with its prompt in hex.
    """
    f = F.split("line", " ")
    number = lambda i: F.get(f, F.lit(i)).try_cast("long")
    n = number(3)
    ids = F.transform(F.slice(f, 5, F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("int")), lambda x: x.try_cast("long"))
    kind = F.get(f, F.lit(0))
    rest = F.size(f) - 4 - n
    fits = kind.isin("T", "E", "G", "L") & number(1).isNotNull() & (number(2) >= 0) & (number(2) <= n) & (rest == F.when(kind == "T", 1).otherwise(0)) & F.forall(ids, lambda x: x.isNotNull())
    fits = F.coalesce(fits, F.lit(False))
    prompt = F.when(kind == "T", F.decode(F.unhex(F.element_at(f, -1)), "UTF-8"))
    only = lambda c: F.when(fits, c)
    return lines.select("line", only(kind).alias("kind"), only(number(1)).alias("id"), only(number(2)).alias("prompt_tokens"), only(n).alias("total"), only(ids).alias("ids"), only(prompt).alias("prompt"))


ANSWER = "kind string, id long, tokens string, nll double, seconds double, prefill_seconds double, finish_reason string, logits array<double>"


def answer_records(lines: DataFrame) -> DataFrame:
    """What an evaluator answers, one JSON object a line: losses (``ce``: ``tokens, nll``), ``generation`` (``generated``, seconds, finish
    reason), ``logits``. Null ``kind`` where a line is none of them."""
    row = F.from_json("line", ANSWER, {"mode": "PERMISSIVE"})
    known = lines.withColumn("row", row).withColumn("kind", F.when(F.col("row.kind").isin("ce", "generation", "logits", "tokens"), F.col("row.kind")))
    return known.select(
        "line", "kind", F.when(F.col("kind").isNotNull(), F.col("row.id")).alias("id"), F.when(F.col("kind") == "ce", F.col("row.tokens").try_cast("long")).alias("n_tokens"), "row.nll",
        F.when(F.col("kind") == "generation", F.from_json("row.tokens", "array<long>")).alias("generated"), "row.seconds", "row.prefill_seconds", "row.finish_reason", "row.logits",
    )

