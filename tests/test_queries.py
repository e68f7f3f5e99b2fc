"""Every registered query of the plans gives the rows of its SQL."""

import os

import duckdb
import pytest
from millrace import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    return "null" if value is None else f"{value:.9g}" if isinstance(value, float) else str(value)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def gathered(plan):
    """What goes into one partition and is neither the partial result of an aggregate, nor a list cut by a limit, nor one row a group."""
    lines = [x.lstrip(" :+-").split(") ", 1)[-1] if x.lstrip(" :+-").startswith("*") else x.lstrip(" :+-") for x in plan.splitlines()]
    return [b for a, b in zip(lines, lines[1:], strict=False) if "Exchange SinglePartition" in a and not b.startswith(("HashAggregate", "SortAggregate", "ObjectHashAggregate", "LocalLimit", "Limit", "Sort [rank"))]


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    assert gathered(plan_of(df)) == []
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
    assert sorted(names) == cols
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_of_streams_stay_out_of_the_driver(spark):
    for name in ("stream_dedup", "stream_rate"):
        plan = plan_of(plans.QUERIES[name](spark, SF))
        assert "parquet" in plan and "LocalTableScan" not in plan and "MemoryPlan" not in plan


def test_no_array_holds_a_whole_language(spark):
    assert "collect_list" not in plan_of(plans.QUERIES["length_stats"](spark, SF))


def test_a_window_without_a_key_is_found(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SF}/orders.parquet")
    assert gathered(plan_of(rows.withColumn("n", F.row_number().over(Window.orderBy("o_orderkey"))))) != []
    assert gathered(plan_of(rows.agg(F.max("o_orderkey")))) == []


def test_scores_of_large_keys(spark, duck, tmp_path):
    spark.range(9_990, 10_030).selectExpr("id AS o_orderkey", "id % 7 + 1 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: (r.correct, r.message) for r in plans.QUERIES["bounded_scores"](spark, str(tmp_path)).collect()}
    assert got == {k: (k % 4 == 0, {2: "not evaluable", 3: "no gold value"}.get(k % 4)) for k in range(9_990, 10_030)}


def test_a_small_file_is_more_than_one_task(spark, tmp_path):
    spark.range(60_000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = plans.QUERIES["counter_examples"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 3 and out.where("refuted").count() == 57_600


def test_texts_are_normalised_once(spark, tmp_path):
    rows = [(1, "en", "A  b!"), (2, "en", "a b!"), (3, "de", "a b"), (4, "de", "A  b!"), (5, "en", None), (6, "en", "")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = plans.QUERIES["strict_and_normalised"](spark, str(tmp_path))
    assert {r.lang: (r.n, r.strict, r.weak, r.normalised) for r in df.collect()} == {"en": (4, 2, 3, 3), "de": (2, 1, 1, 2)}
    assert "regexp_extract_all" not in plan_of(df)
