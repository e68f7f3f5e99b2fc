"""Record files: JSONL with partial tails, JSON documents, CSV, hashes of files, and write-once sinks with manifests."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import file_system

BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = False, complete_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows and ``(file, record)`` of bad ones, a partial last line among them. ``strict`` fails on the first bad one.

    ``complete_only`` takes a last line without a line feed for unfinished, even if it can be parsed: it counts as bad. Files are then
    read whole by one task each, so they should be moderate. Compressed files are read by their extension.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), spark.createDataFrame([], "file string, record string")
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path, wholetext=complete_only).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    if complete_only:
        cut = F.split("value", "\n")
        lines = lines.select("file", F.posexplode(cut).alias("at", "value"), (F.size(cut) - 1).alias("last"))
        lines = lines.select(F.col("value"), "file", (F.col("at") == F.col("last")).alias("partial"))
        parsed = F.when(F.col("partial"), F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.col("value").alias(BAD))).otherwise(parsed)
    rows = lines.where(F.length(F.trim("value")) > 0).withColumn("row", parsed)
    good = rows.where(F.col(f"row.{BAD}").isNull()).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])
    return good, rows.where(F.col(f"row.{BAD}").isNotNull()).select("file", F.col("value").alias("record"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_open_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object with any keys, as one variant."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("value"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(texts: pd.Series) -> pd.Series:
    """A list of strings written as ``['a', "it's"]``; null for anything else."""

    def parsed(text: str | None) -> list[str] | None:
        try:
            got = ast.literal_eval(text) if text is not None else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return got if isinstance(got, list) and all(isinstance(x, str) for x in got) else None

    return pd.Series([parsed(t) for t in texts], dtype=object)


def read_arrow(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.arrow") -> DataFrame:
    """Rows of Arrow IPC files, streams or file format, as Spark lists them; each file is read by one task, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for b in batches:
            for raw in b.column(0):
                source = pa.py_buffer(raw.as_py())
                try:
                    reader = pa.ipc.open_file(source)
                    parts = (reader.get_batch(i) for i in range(reader.num_record_batches))
                except pa.ArrowInvalid:
                    parts = pa.ipc.open_stream(source)
                for part in parts:
                    yield from pa.Table.from_batches([part]).select(target.names).cast(target).to_batches()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("content").mapInArrow(run, schema)


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, id, tokens, nll)`` from the tab- or blank-separated lines that an evaluator writes; other lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == 4)
    out = rows.select(F.get("p", F.lit(0)).alias("kind"), F.get("p", F.lit(1)).alias("id"), F.get("p", F.lit(2)).try_cast("long").alias("tokens"), F.get("p", F.lit(3)).try_cast("double").alias("nll"))
    return out.where("kind RLIKE '^[A-Z]$' AND tokens IS NOT NULL AND nll IS NOT NULL")


def per_token(losses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tokens and loss a token of each group, weighted by tokens."""
    return losses.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.try_divide(F.sum("nll"), F.sum("tokens")).alias("loss"))


def same_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(name, problem)`` of two folders' ``file_hashes``: names that one side lacks, and files that differ in digest or checksum."""
    own = lambda df, s: df.select(F.element_at(F.split("file", "/"), -1).alias("name"), *[F.col(c).alias(f"{c}_{s}") for c in ("file", "sha256", "crc32")])
    both = own(a, "a").join(own(b, "b"), "name", "full_outer")
    problem = (
        F.when(F.col("file_b").isNull(), "only_a").when(F.col("file_a").isNull(), "only_b").when(F.col("file_a") == F.col("file_b"), "same_file")
        .when((F.col("sha256_a") != F.col("sha256_b")) | (F.col("crc32_a") != F.col("crc32_b")), "differs")
    )
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(file, bytes, sha256, crc32)`` of all files below a folder; each file is read whole by one task, so files should be moderate."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))


@F.udtf(returnType="key: string, value: string")
class StringsUnder:
    """Every string below the named keys (comma-separated) of a JSON text, at any depth."""

    def eval(self, text: str, keys: str):
        import json

        wanted = set(keys.split(","))
        try:
            todo = [("", json.loads(text))]
        except (TypeError, ValueError):
            return
        while todo:
            key, v = todo.pop()
            if isinstance(v, dict):
                todo.extend(reversed([(k, x) for k, x in v.items()]))
            elif isinstance(v, list):
                todo.extend(reversed([(key, x) for x in v]))
            elif isinstance(v, str) and key in wanted:
                yield key, v


def write_once(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet that never replaces an existing table."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_replacing(df: DataFrame, path: str) -> None:
    """Parquet that takes an old table's place once it is all written: ``df`` may read the table it replaces.

    The new table is written beside the old one, and two renames swap them. A job that dies leaves the old table, or, between the renames,
    both under other names, from which ``recover`` puts back a whole one.
    """
    spark = df.sparkSession
    recover(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs, at = file_system(spark, path)
    old, new = (at.suffix(s) for s in (".old", ".new"))
    if fs.exists(at):
        _rename(fs, at, old)
    _rename(fs, new, at)
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a ``write_replacing`` that was cut off: a table that isn't there is the new one, which was whole by then."""
    fs, at = file_system(spark, path)
    old, new = (at.suffix(s) for s in (".old", ".new"))
    if not fs.exists(at) and fs.exists(old):
        _rename(fs, new if fs.exists(new) else old, at)
    for left in (old, new):
        if fs.exists(left):
            fs.delete(left, True)


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"{a.toString()} can't be renamed to {b.toString()}")


def truncate_log(spark: SparkSession, path: str, step: str, last: int, archive: str) -> dict[str, int]:
    """Go back to ``last`` in a log of steps: later rows move to ``archive``, which must be new, and the log keeps the rest.

    The archive is whole before the log is replaced, so a job that dies loses nothing. Rows without a step are superseded too. Returns the
    step restored, the last one logged before, and how many rows each side has.
    """
    log = spark.read.parquet(path)
    keep = F.coalesce(F.col(step) <= last, F.lit(False))
    ends = log.agg(F.max(step).alias("last"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("superseded")).first()
    log.where(~keep).write.mode("errorifexists").parquet(archive)
    write_replacing(log.where(keep), path)
    return {"restored_step": last, "last_logged_step": ends["last"], "kept": ends["kept"], "superseded": ends["superseded"]}


def write_quarantine(bad: DataFrame, path: str) -> None:
    """Bad records of ``read_jsonl`` appended as JSON lines, with the time they were found."""
    bad.withColumn("found_at", F.current_timestamp()).write.mode("append").json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A small table as JSON lines in one file."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def write_matrix(df: DataFrame, key: str, vector: str, path: str) -> None:
    """Rows of a matrix as Parquet arrays of doubles in the order of their keys."""
    df.select(F.col(key).alias("row"), F.col(vector).cast("array<double>").alias("values")).sort("row").write.mode("errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def report_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Markdown table rows, one ``line`` per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
