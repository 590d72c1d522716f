"""Sizes, hot keys and bucketed tables."""

import pytest
from pyspark.sql import functions as F

from loomfeed import runtime


def test_sizes_in_bytes():
    assert [runtime._bytes(x) for x in ("16m", "128MB", "134217728b", "4194304", "1g", "2KB")] == [16 << 20, 128 << 20, 134217728, 4194304, 1 << 30, 2048]


def test_spread_runs_nothing(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert runtime.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    joined = df.join(df.withColumnRenamed("id", "k"), F.col("id") == F.col("k"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    runtime.spread(joined)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(before)


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    t = runtime.Bucketed(spark, str(tmp_path / "b"), ["k"], 4)
    assert not t.exists()
    t.append(spark.range(100).selectExpr("id % 7 AS k", "id"))
    t.append(spark.range(100, 150).selectExpr("id % 7 AS k", "id"))
    new = spark.range(20).selectExpr("id % 9 AS k", "id AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = t.read().join(new, "k")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and got.count() == sum(1 for i in range(150) for x in range(20) if i % 7 == x % 9)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.catalog.clearCache()
    spark.sql(f"DROP TABLE {t.name}")
    t.open("k long, id long")
    assert t.read().count() == 150
    t.drop()
    assert not t.exists() and not (tmp_path / "b").exists()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_looked_up_by_broadcast(spark, how):
    rows = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN null WHEN id % 3 = 1 THEN 'hot' ELSE concat('k', id % 5000) END AS k", "id")
    lookup = rows.where("k IS NOT NULL AND k <> 'k2'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"))
    got = runtime.join_hot(rows, lookup, "k", how=how)
    want = rows.join(lookup, "k", how)
    cols = ["id", "k", "n", "a"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_hot_keys_are_dealt_to_shares(spark, monkeypatch):
    monkeypatch.setattr(runtime, "LEAST_HOT", 100)
    rows = spark.range(4000).selectExpr("CASE WHEN id % 10 = 0 THEN null WHEN id % 2 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "id")
    lookup = rows.where("k IS NOT NULL AND k <> 'k3'").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("wide", F.concat("k", F.lit("!")))
    got = runtime.join_salted(rows, lookup, "k", "id")
    cols = ["id", "k", "n", "wide"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, rows.join(lookup, "k", "left").select(cols).collect()))
    spread_out = runtime.join_salted(rows, lookup, "k", "id").where("k = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(16))).count()
    assert spread_out.count() > 8 and "_share" not in got.columns


def test_two_column_keys(spark):
    rows = spark.range(30_000).selectExpr("'a' AS s", "CASE WHEN id % 2 = 0 THEN 1 WHEN id % 7 = 0 THEN null ELSE id END AS l", "id")
    lookup = rows.groupBy("s", "l").agg(F.count(F.lit(1)).alias("n")).where("l < 9")
    got = runtime.join_hot(rows, lookup, ["s", "l"])
    assert got.count() == rows.where("l < 9").count() and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
