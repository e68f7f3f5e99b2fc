"""Exact duplicates by a tree-merge of sorted digest runs.

Every input task turns its rows into sorted runs of ``(sha256, check, best id, count)``. Runs are exchanged in binomial
rounds: in a round each run splits at the next digit of its digests, and ``FAN`` partners merge the pieces of one digit, so
that after R rounds each of ``FAN ** R`` cells holds the only run of its digest range. A group of copies is one entry per run
from the first round on, however large it is. Only groups of two or more travel back, by a join on the digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs merged at once, and entries that a final cell should hold at most.
FAN, CELL_ROWS = 8, 100_000
RUN = "grp long, digits long, digest binary, check binary, best binary, ids binary, count binary"


def _merge(digest: np.ndarray, check: np.ndarray, best: np.ndarray, ids: np.ndarray, count: np.ndarray, largest: bool) -> tuple[np.ndarray, ...]:
    """Entries, in any order, to one sorted run with an entry per digest; ``digest`` is n x 4 big-endian words, ``ids`` counts rows that have an id."""
    order = np.lexsort((check, digest[:, 3], digest[:, 2], digest[:, 1], digest[:, 0]))
    digest, check, best, ids, count = digest[order], check[order], best[order], ids[order], count[order]
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]).any(axis=1) | (check[1:] != check[:-1])
    at = np.flatnonzero(new)
    pick = np.maximum if largest else np.minimum
    if not len(at):
        return digest, check, best, ids, count
    return digest[at], check[at], pick.reduceat(best, at), np.add.reduceat(ids, at), np.add.reduceat(count, at)


def _pieces(run: tuple[np.ndarray, ...], grp: int, digits: int, level: int) -> pd.DataFrame:
    """The run cut at digit ``level`` of its digests; a run is sorted, so its pieces are too."""
    digest, check, best, ids, count = run
    digit = (digest[:, 0] >> np.uint64(61 - 3 * level)) & np.uint64(FAN - 1)
    rows = []
    for d in np.unique(digit):
        m = digit == d
        rows.append((grp // FAN, digits * FAN + int(d), digest[m].astype(">u8").tobytes(), check[m].tobytes(), best[m].tobytes(), ids[m].tobytes(), count[m].tobytes()))
    return pd.DataFrame(rows, columns=["grp", "digits", "digest", "check", "best", "ids", "count"])


def _unpack(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    words = lambda name, kind: np.frombuffer(b"".join(part[name]), kind)
    return words("digest", ">u8").astype(np.uint64).reshape(-1, 4), words("check", "i8"), words("best", "i8"), words("ids", "i8"), words("count", "i8")


def digest_groups(rows: DataFrame, largest: bool = True) -> DataFrame:
    """``(id, digest, check)`` rows to ``(digest, check, keep_id, group_size)``, one row for each digest.

    ``check`` is a second, independent hash and is part of an entry's identity on every level, which verifies it. Null ids
    lose against every other id.
    """
    spark = rows.sparkSession
    # As many rounds as make one run of all tasks' runs, and cells of CELL_ROWS at most.
    total, n_tasks = rows.count(), rows.rdd.getNumPartitions()
    rounds = 1
    while (FAN**rounds < n_tasks or FAN**rounds * CELL_ROWS < total) and rounds < 20:
        rounds += 1

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grp = TaskContext.get().partitionId() % FAN**rounds
        for b in batches:
            if len(b):
                digest = np.frombuffer(b"".join(b["digest"]), ">u8").astype(np.uint64).reshape(-1, 4)
                run = digest, b["check"].to_numpy(np.int64), b["id"].to_numpy(np.int64), b["has_id"].to_numpy(np.int64), np.ones(len(b), np.int64)
                yield _pieces(_merge(*run, largest), grp, 0, 0)

    def level(k: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            merged = _merge(*_unpack(part), largest)
            grp, digits = int(part["grp"].iloc[0]), int(part["digits"].iloc[0])
            if k < rounds:
                return _pieces(merged, grp, digits, k)
            digest, check, best, ids, count = merged
            whole = digest.astype(">u8").tobytes()
            return pd.DataFrame({"digest": [whole[i : i + 32] for i in range(0, len(whole), 32)], "check": check, "best": best, "ids": ids, "group_size": count})

        return run

    # no nulls reach pandas, where numbers beside them lose digits: a row without an id has the one that loses against all others
    worst = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max
    entries = rows.select(F.coalesce("id", F.lit(int(worst))).alias("id"), F.col("id").isNotNull().cast("long").alias("has_id"), "digest", "check")
    runs = entries.mapInPandas(leaf, RUN)
    for k in range(1, rounds + 1):
        out = RUN if k < rounds else "digest binary, check long, best long, ids long, group_size long"
        runs = runs.groupBy("grp", "digits").applyInPandas(level(k), out)
    return runs.select("digest", "check", F.when(F.col("ids") > 0, F.col("best")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical. A null text counts as empty, and empty texts form a group like any other. Of a group the
    row with the largest id stays (``largest=False``: the smallest). Rows that share both id and text are all marked alike. A
    null id never wins over another id; if all ids of a group are null, ``keep_id`` is null and its rows are kept. Other
    columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("hex"), F.xxhash64(text).alias("check"))
    keyed = rows.withColumn("digest", F.unhex("hex"))
    copies = digest_groups(keyed, largest).where("group_size > 1")
    return keyed.join(copies, ["digest", "check"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())).alias("kept"),
        F.col("hex").alias("text_sha256"),
    )
