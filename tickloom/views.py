"""Ticks, candles, prices and dimensions derived from the given tables, in DataFrames and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.candles import tick_bars

#: Local days start seven hours before UTC's.
LOCAL_SHIFT = 7 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp without a zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """broker, symbol, user_id, timestamp (ms), ts_us, event_id, price, quantity."""
    e = table(spark, sf_dir, "events")
    us = epoch_us(F.col("ts"))
    return e.select(
        F.lit("sim").alias("broker"), F.col("event_type").alias("symbol"), "user_id", F.floor(us / 1000).alias("timestamp"), us.alias("ts_us"), "event_id",
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("quantity"),
    )


def candles(spark: SparkSession, sf_dir: str, period: int = 14400, key: str = "symbol") -> DataFrame:
    """Bars (symbol, t, o, h, l, c, v, last_qty) of the ticks; key user_id gives many symbols."""
    rows = ticks(spark, sf_dir).withColumn("symbol", F.col(key).cast("string"))
    return tick_bars(rows, period, keys=("symbol",), order=("ts_us", "event_id"))


TICKS = """ticks AS (SELECT 'sim' AS broker, event_type AS symbol, user_id, epoch_us(ts) // 1000 AS timestamp, epoch_us(ts) AS ts_us, event_id,
    value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity FROM events)"""


def candles_sql(name: str = "candles", period: int = 14400, key: str = "symbol") -> str:
    return f"""{name} AS (SELECT CAST({key} AS VARCHAR) AS symbol, ts_us // 1000000 // {period} * {period} AS t, first(price ORDER BY ts_us, event_id) AS o, max(price) AS h,
    min(price) AS l, last(price ORDER BY ts_us, event_id) AS c, round(sum(quantity), 6) AS v, last(quantity ORDER BY ts_us, event_id) AS last_qty FROM ticks GROUP BY ALL)"""


CANDLES = f"WITH {TICKS}, {candles_sql()}"
CANDLES_1H = f"WITH {TICKS}, {candles_sql(period=3600)}"


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, store_id, symbol_id, product_name, scope: the products that stores sell."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("store_id"), (F.col("l_partkey") % 20).alias("symbol_id")).distinct()
    return li.select(
        (F.col("store_id") * 100 + F.col("symbol_id")).alias("product_id"), "store_id", "symbol_id",
        F.concat(F.lit("Product "), F.col("symbol_id").cast("string")).alias("product_name"), (F.col("symbol_id") % 3).cast("int").alias("scope"),
    )


BRIDGE = """bridge AS (SELECT DISTINCT l_suppkey * 100 + l_partkey % 20 AS product_id, l_suppkey AS store_id, l_partkey % 20 AS symbol_id,
    'Product ' || (l_partkey % 20) AS product_name, CAST(l_partkey % 20 % 3 AS INTEGER) AS scope FROM lineitem)"""


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, store_id, symbol_id, buy, sell, ts (epoch seconds), id; id ranks rows of one time."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") * 100 + F.col("l_partkey") % 20).alias("product_id"), F.col("l_suppkey").alias("store_id"), (F.col("l_partkey") % 20).alias("symbol_id"),
        F.col("l_extendedprice").alias("buy"), (F.floor(F.col("l_extendedprice") * (1 + F.col("l_tax")) * 100 + 0.5) / 100).alias("sell"),
        F.floor(epoch_us(F.col("l_shipdate")) / 1000000).alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
    )


HISTORY = """history AS (SELECT l_suppkey * 100 + l_partkey % 20 AS product_id, l_suppkey AS store_id, l_partkey % 20 AS symbol_id, l_extendedprice AS buy,
    floor(l_extendedprice * (1 + l_tax) * 100 + 0.5) / 100 AS sell, epoch_us(l_shipdate) // 1000000 AS ts, l_orderkey * 8 + l_linenumber AS id FROM lineitem)"""
#: The order of history rows of a product; rows that tie in all of it are equal.
HISTORY_ORDER = "ts, id, buy, sell"


def price_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, buy, sell, ts of the last history row of each product."""
    last = F.max_by(F.struct("buy", "sell", "ts"), F.struct("ts", "id", "buy", "sell"))
    return price_history(spark, sf_dir).groupBy("product_id").agg(last.alias("p")).select("product_id", "p.buy", "p.sell", "p.ts")


CURRENT = f"""current AS (SELECT product_id, last(buy ORDER BY {HISTORY_ORDER}) AS buy, last(sell ORDER BY {HISTORY_ORDER}) AS sell, max(ts) AS ts FROM history GROUP BY product_id)"""


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, store, province, area."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    at = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # as many rows as there are nations
    return s.join(F.broadcast(at), s.s_nationkey == at.n_nationkey).select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"), F.col("n_name").alias("province"), F.col("r_name").alias("area"))


STORES = "stores AS (SELECT s_suppkey AS store_id, s_name AS store, n_name AS province, r_name AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
PRICES = f"WITH {BRIDGE}, {HISTORY}, {CURRENT}, {STORES}"
