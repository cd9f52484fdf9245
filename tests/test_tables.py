"""Histories by month and snapshots by bucket: what is read, what is written, what a repeated batch does."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickloom.operators import dimensions as dims
from tickloom.operators import prices
from tickloom.sources import history
from tickloom.sources.snapshots import Snapshot

DAY = 86400


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Two years of three products, a row a day each, and one without a time."""
    path = str(tmp_path_factory.mktemp("history"))
    rows = spark.range(730 * 3).select((F.col("id") % 3).alias("product_id"), F.col("id").cast("double").alias("buy"), F.col("id").cast("double").alias("sell"), (1640995200 + F.floor(F.col("id") / 3) * DAY).alias("ts"), "id")
    history.land(rows.union(rows.limit(1).withColumn("ts", F.lit(None).cast("long"))), path)
    return path


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_read_their_months(spark, landed):
    rows = history.read(spark, landed)
    got = history.between(rows, 1643673600, 1643673600 + 40 * DAY)
    text = plan(got)
    assert "PartitionFilters: [isnotnull(month" in text and ">= 202202" in text and "<= 202203" in text and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert got.count() == 41 * 3 and got.columns == ["product_id", "buy", "sell", "ts", "id"]
    assert sorted(r.month for r in rows.select("month").distinct().where("month is not null").collect()) == [y * 100 + m for y in (2022, 2023) for m in range(1, 13)]
    assert rows.count() == 730 * 3 + 1
    star = prices.history_star(rows, spark.createDataFrame([(1, 0, 7)], "product_id long, scope int, symbol_id long"), [0], 1643673600, 1643673600 + DAY)
    assert ">= 202202" in plan(star) and star.count() == 2


def test_requests_prune_months_when_they_run(spark, landed):
    asked = spark.createDataFrame([(1, 0, 1643673600, 1643673600 + 2 * DAY), (2, 0, 1643673600, 1643673600), (3, 2, 1672531200 - DAY, 1672531200 + DAY), (4, 9, 0, 1 << 31), (5, 1, 10, 5)], "id long, product_id long, start long, end long")
    rows = history.read(spark, landed).withColumnRenamed("id", "row_id")
    got = history.asked(rows, asked, "product_id")
    assert "dynamicpruningexpression(month" in plan(got)
    assert {(r.id, r.n) for r in got.groupBy("id").agg(F.count("*").alias("n")).collect()} == {(1, 3), (2, 1), (3, 3)}


def test_a_large_month_is_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(60_000).select(F.xxhash64("id").alias("x"), F.when(F.col("id") < 50_000, 1704067200).otherwise(1704067200 + 40 * DAY).cast("long").alias("ts"))
        history.land(rows.repartition(8), str(tmp_path / "h"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [len(list((tmp_path / f"h/month={m}").glob("*.parquet"))) for m in (202401, 202402)]
    assert files[0] >= 4 and files[0] > files[1]
    assert spark.read.parquet(str(tmp_path / "h")).count() == 60_000


def test_a_batch_rewrites_its_buckets(spark, tmp_path):
    merge = lambda held, batch: dims.upsert(held, batch, ["id"], ["name"], "seq")
    table = Snapshot(spark, str(tmp_path / "t"), "id long, name string", ["id"], buckets=32)
    assert table.read().count() == 0
    assert table.rewrite(spark.range(1000).select("id", F.lit("a").alias("name")), lambda _, batch: batch, 1) == 32
    batch = spark.createDataFrame([(k * 97, "b", 0) for k in range(10)] + [(5000, "new", 1), (5000, "old", 0)], "id long, name string, seq int")
    files = lambda: {p: os.stat(p).st_mtime_ns for p in Path(tmp_path / "t/data").rglob("*.parquet")}
    before = files()
    written = table.rewrite(batch, merge, 2)
    assert 2 <= written <= 11 and len(set(files()) - set(before)) == written and all(files()[p] == t for p, t in before.items() if p in files())
    want = {k: "a" for k in range(1000)} | {k * 97: "b" for k in range(10)} | {5000: "new"}
    assert {r.id: r.name for r in table.read().collect()} == want and table.read().count() == 1001
    was = table.read(version=1).where("name = 'b'").count()
    assert was == 0 and table.rewrite(batch.withColumn("name", F.lit("again")), merge, 2) == 0 and {r.id: r.name for r in table.read().collect()} == want
    table.rewrite(batch.limit(1), merge, 3)
    table.rewrite(batch.limit(1), merge, 4)
    assert table.versions() == [3, 4] and {r.id: r.name for r in table.read().collect()} == want
    held = {(v, b) for m in (3, 4) for b, v in table.manifest(m).items()}
    assert {(int(p.parent.parent.name[8:]), int(p.parent.name[7:])) for p in files()} == held  # nothing else is left
    assert table.rewrite(batch.limit(0), merge, 5) == 0 and table.read().count() == 1001


def test_a_bucket_that_empties(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), "id long, name string", ["id"], buckets=4)
    table.rewrite(spark.createDataFrame([(1, "a")], table.schema), lambda _, b: b, 1)
    table.rewrite(spark.createDataFrame([(1, "gone")], table.schema), lambda held, b: held.join(b, "id", "left_anti"), 2)
    assert table.read().count() == 0 and table.manifest() == {}
