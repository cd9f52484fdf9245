"""Queries that run streams over landed files until all is read, and give what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import views
from ..storage import scratch
from ..streaming import ordered
from ..streaming import ticks as live
from ..views import HISTORY_ORDER, TICKS, candles_sql
from .registry import query

RANGES = 8
#: Keys of the state over which boards are dealt.
BOARD_BUCKETS = 256


def in_order(rows: DataFrame, by: str, write) -> None:
    """Writes `rows` by RANGES ranges of `by`, one after the other: a stream reads files by the time they were written. A range has as many files as the table has partitions."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    part = F.least(F.floor((F.col(by) - low) * RANGES / max(high - low, 1)), F.lit(RANGES - 1))
    for k in range(RANGES):
        write(rows.where(part == k).write.mode("append"))


def landed(spark, d) -> str:
    """Ticks as files of JSON lines, in order of time."""
    path = scratch(spark, "ticks")
    in_order(views.ticks(spark, d).select("broker", "symbol", "price", "quantity", "timestamp"), "timestamp", lambda w: w.json(path))
    return path


def streamed(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream `df` writes as Parquet once all that is there is read."""
    spark = df.sparkSession
    path = scratch(spark, name)
    query_ = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    live.finish(query_)
    return spark.read.schema(df.schema).parquet(path)


def batches(df: DataFrame, name: str, each, mode: str = "append") -> None:
    """Runs the stream `df` with a function for each batch until all that is there is read."""
    query_ = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", scratch(df.sparkSession, name)).trigger(availableNow=True).start()
    live.finish(query_)


@query(f"WITH {TICKS} SELECT broker, symbol, price, quantity, timestamp FROM ticks")
def src_tick_stream(spark, d):
    rows = live.read_ticks(spark, landed(spark, d)).where("_corrupt_record is null").drop("_corrupt_record")
    return streamed(rows, "out")


FIELDS = {"symbol": ("event_type", "string"), "price": ("value", "f64"), "k": ("props.k", "i64"), "id": ("event_id", "i32")}


@query("SELECT event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(event_id AS INTEGER) AS id, 'sim' AS broker FROM events WHERE event_id % 7 > 0")
def st_json_map(spark, d):
    e = views.table(spark, d, "events").withColumn("props", F.from_json("props", "k long"))
    whole = F.when(F.col("event_id") % 7 == 0, F.to_json(F.struct("event_type", "value", "event_id"))).otherwise(F.to_json(F.struct("event_type", "value", "event_id", "props")))
    path = scratch(spark, "messages")
    e.select(whole.alias("payload")).write.text(path)
    messages = spark.readStream.schema("value string").text(path).withColumnRenamed("value", "payload")
    return streamed(live.json_map(messages, FIELDS, {"broker": "sim"}), "out")


@query(f"WITH {TICKS}, {candles_sql()} SELECT 'sim' AS broker, symbol, t, o, h, l, c, v FROM candles")
def st_ohlc(spark, d):
    """All bars as the stream closes them: two ticks of another symbol, far beyond the last, land at the end and move the watermark on.

    Every fiftieth tick lands two days late and still counts, as a week is allowed; one that lands after the watermark has passed it is dropped.
    """
    rows = views.ticks(spark, d).select("broker", "symbol", "price", "quantity", "timestamp", "event_id")
    path = scratch(spark, "ticks")
    late = F.when(F.col("event_id") % 50 == 0, 2 * 86_400_000).otherwise(0)
    in_order(rows.withColumn("arrival", F.col("timestamp") + late), "arrival", lambda w: w.json(path))
    for days in (30, 60):
        if days == 60:
            rows.orderBy("timestamp").limit(1).withColumn("price", F.lit(1e9)).write.mode("append").json(path)
        end = rows.agg((F.max("timestamp") + days * 86_400_000).alias("timestamp")).where("timestamp is not null")
        end.select(F.lit("sim").alias("broker"), F.lit("~end").alias("symbol"), F.lit(0.0).alias("price"), F.lit(0.0).alias("quantity"), "timestamp", F.lit(-1).alias("event_id")).write.mode("append").json(path)
    ticks = live.read_ticks(spark, path, f"{live.TICK}, event_id long", maxFilesPerTrigger="1").drop("_corrupt_record")
    return streamed(live.live_bars(ticks, 14400, "7 days"), "bars").where("symbol <> '~end'").select("broker", "symbol", "t", "o", "h", "l", "c", "v")


@query(f"WITH {TICKS} SELECT broker, symbol, last(price ORDER BY ts_us, event_id) AS price, max(timestamp) AS timestamp FROM ticks GROUP BY ALL")
def st_last_price(spark, d):
    path = scratch(spark, "last")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    rows = live.read_ticks(spark, landed(spark, d), maxFilesPerTrigger="1").drop("_corrupt_record")
    batches(live.last_prices(rows), "last", keep, "update")
    every = spark.read.parquet(path)
    g = every.groupBy("broker", "symbol").agg(F.max_by(F.struct("price", "timestamp"), "epoch").alias("x"))
    return g.select("broker", "symbol", "x.price", "x.timestamp")


def messages(spark, d, *more) -> DataFrame:
    e = views.table(spark, d, "events")
    version = F.floor(F.col("event_id") / 3) % 5 + 1
    return e.select(F.col("user_id").cast("string").alias("board"), F.col("event_id").alias("seq"), version.alias("version"), F.col("event_type").alias("payload"), *more)


CHANGED = """SELECT board, seq, version, payload FROM (SELECT *, coalesce(lag(version) OVER (PARTITION BY board ORDER BY seq), 0) AS b
    FROM (SELECT CAST(user_id AS VARCHAR) AS board, event_id AS seq, event_id // 3 % 5 + 1 AS version, event_type AS payload FROM events)) WHERE version <> b"""


@query(CHANGED)
def win_version_gate(spark, d):
    return live.version_changes(messages(spark, d))


def stateful(df: DataFrame, name: str) -> DataFrame:
    """streamed() with the state store that state processors need; a query takes it when it starts."""
    spark = df.sparkSession
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        return streamed(df, name)
    finally:
        spark.conf.set(key, before)


def landed_late(rows: DataFrame, path: str, end: DataFrame) -> None:
    """Rows with `ts` as Parquet by time, every fifth two days late; then `end`, rows of one key far behind, so that the watermark passes all others."""
    arrival = F.unix_micros("ts") + F.when(F.col("seq") % 5 == 0, 2 * 86_400_000_000).otherwise(0)
    in_order(rows.withColumn("arrival", arrival), "arrival", lambda w: w.parquet(path))
    for days in (60, 90):
        last = rows.agg((F.max("ts") + F.expr(f"interval {days} days")).alias("ts")).where("ts is not null")
        last.join(end).select(*rows.columns).withColumn("arrival", F.lit(0).cast("long")).coalesce(1).write.mode("append").parquet(path)


def of_schema(spark, path: str, rows: DataFrame) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "3").parquet(path)


@query(CHANGED)
def st_version_gate(spark, d):
    """Messages that land a batch or more behind later ones."""
    path = scratch(spark, "boards")
    rows = messages(spark, d, F.col("ts").cast("timestamp").alias("ts"))
    end = spark.createDataFrame([("~end", -1, 1, "")], "board string, seq long, version long, payload string")
    landed_late(rows, path, end)
    passed = ordered.gate_stream(of_schema(spark, path, rows), "7 days", 365 * 86400, BOARD_BUCKETS)
    return stateful(passed, "gate").where("board <> '~end'")


ROUTED = f"""WITH {TICKS}, a AS (SELECT 'c' || user_id % 7 AS client, event_type AS symbol, epoch_us(ts) AS at, CASE WHEN event_id % 3 = 0 THEN 'unsubscribe' ELSE 'subscribe' END AS action FROM events),
    w AS (SELECT DISTINCT client, symbol FROM a), t AS (SELECT w.client, t.broker, t.symbol, t.ts_us FROM ticks t JOIN w ON w.symbol = t.symbol)
    SELECT t.client, t.broker, t.symbol, count(*) AS n FROM t ASOF JOIN a ON a.client = t.client AND a.symbol = t.symbol AND t.ts_us >= a.at WHERE a.action = 'subscribe' GROUP BY ALL"""


@query(ROUTED)
def st_subscribe(spark, d):
    """Actions and ticks as two streams: who is subscribed changes between batches and within them."""
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = e.select(F.lit("sim").alias("broker"), F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), "ts", "user_id", F.col("value").alias("price"))
    action = F.when(F.col("seq") % 3 == 0, "unsubscribe").otherwise("subscribe")
    actions = base.select("broker", "symbol", F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("client"), action.alias("action"), "seq", "ts")
    ticks = base.select("broker", "symbol", "seq", "price", "ts")
    paths = [scratch(spark, n) for n in ("actions", "ticks")]
    landed_late(actions, paths[0], spark.createDataFrame([("sim", "~end", "c", "none", -1)], "broker string, symbol string, client string, action string, seq long"))
    landed_late(ticks, paths[1], spark.createDataFrame([("sim", "~end", -1, 0.0)], "broker string, symbol string, seq long, price double"))
    routed = ordered.routed_stream(of_schema(spark, paths[1], ticks), of_schema(spark, paths[0], actions), "7 days", 2)
    return stateful(routed, "routed").groupBy("client", "broker", "symbol").agg(F.count("*").alias("n"))


SUBSCRIBED = f"""WITH {TICKS}, a AS (SELECT 'c' || user_id % 7 AS client, 'sim' AS broker, event_type AS symbol, CASE WHEN event_id % 3 = 0 THEN 'unsubscribe' ELSE 'subscribe' END AS action, event_id AS seq FROM events),
    s AS (SELECT client, broker, symbol FROM (SELECT client, broker, symbol, arg_max(action, seq) AS action FROM a GROUP BY ALL) WHERE action = 'subscribe')
    SELECT client, broker, symbol, count(*) AS n FROM ticks JOIN s USING (broker, symbol) GROUP BY ALL"""


@query(SUBSCRIBED)
def st_subscribed_last(spark, d):
    """Ticks of a stream for whoever is subscribed by a table of actions."""
    e = views.table(spark, d, "events")
    actions = e.select(F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("client"), F.lit("sim").alias("broker"), F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 3 == 0, "unsubscribe").otherwise("subscribe").alias("action"), F.col("event_id").alias("seq"))
    path, out = scratch(spark, "actions"), scratch(spark, "routed")
    actions.write.parquet(path)

    def route(batch: DataFrame, epoch: int) -> None:
        now = live.subscriptions(batch.sparkSession.read.parquet(path))  # read again for each batch
        live.routed(batch, now).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    batches(live.read_ticks(spark, landed(spark, d)).drop("_corrupt_record"), "route", route)
    return spark.read.parquet(out).groupBy("client", "broker", "symbol").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT symbol, count(*) AS n FROM ticks GROUP BY symbol")
def st_fan_out(spark, d):
    out = scratch(spark, "fan")

    def broken(batch: DataFrame, epoch: int) -> None:
        raise OSError("this sink is down")

    sinks = {"files": lambda b, n: b.write.mode("overwrite").parquet(f"{out}/epoch={n}"), "none": lambda b, n: b.write.format("noop").mode("overwrite").save(), "down": broken}
    batches(live.read_ticks(spark, landed(spark, d)).drop("_corrupt_record"), "fan", live.fan_out(sinks))
    return spark.read.parquet(out).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"""WITH {views.HISTORY} SELECT product_id, last(buy ORDER BY {HISTORY_ORDER}) AS buy, last(sell ORDER BY {HISTORY_ORDER}) AS sell, (SELECT count(*) FROM history) AS kept FROM history GROUP BY product_id""")
def st_price_ingest(spark, d):
    path, base = scratch(spark, "prices"), scratch(spark, "ingest")
    rows = views.price_history(spark, d).select("product_id", "buy", "sell", "ts", "id")
    in_order(rows, "ts", lambda w: w.parquet(path))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(path)
    batches(stream, "ingest", live.price_ingest(f"{base}/current", f"{base}/history"))
    kept = spark.read.parquet(f"{base}/history").agg(F.count("*").alias("kept"))
    return live.prices_of(spark, f"{base}/current").read().join(F.broadcast(kept)).select("product_id", "buy", "sell", "kept")
