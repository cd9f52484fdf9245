"""Ticks as streams: mapping, bars, last prices, version gate, ingest, fan-out. All transforms also run on batches."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import strict_cast
from ..operators.candles import order_of
from ..operators.prices import ingest
from ..sources.history import land
from ..sources.json_path import parse
from ..sources.snapshots import Snapshot

TICK = "broker string, symbol string, price double, quantity double, timestamp long"


def read_ticks(spark: SparkSession, path: str, fields: str = TICK, **options: str) -> DataFrame:
    """Ticks of JSON lines that land in `path`, with _corrupt_record for lines that are no tick; empty lines don't count."""
    schema = f"{fields}, _corrupt_record string"
    return spark.readStream.format("json").schema(schema).option("mode", "PERMISSIVE").options(**options).load(path)


def _first(value: Column, path: str) -> Column:
    """The first match of a path without iteration, or of the first element where it iterates."""
    for kind, what in parse(path):
        step = {"field": lambda w: "$['" + str(w) + "']", "ts": lambda w: f"$[{w}]", "iter": lambda _: "$[0]"}[kind](what)
        value = F.try_variant_get(value, step, "variant")
    return value


def json_map(messages: DataFrame, fields: Mapping[str, tuple[str, str]], constants: Mapping[str, object] | None = None, payload: str = "payload") -> DataFrame:
    """Messages as rows of `fields` (name: (path, kind of strict_cast)); a message that lacks one, or where one can't be cast, is dropped. Constants come last and override."""
    v = F.try_parse_json(payload)
    rows = messages.select("*", *(strict_cast(_first(v, path), kind).alias(f"__{name}") for name, (path, kind) in fields.items()))
    for name in fields:
        rows = rows.where(F.col(f"__{name}").isNotNull())
    columns = {name: F.col(f"__{name}") for name in fields} | {k: F.lit(x) for k, x in (constants or {}).items()}
    keep = [c for c in messages.columns if c != payload and c not in columns]
    return rows.select(*keep, *(c.alias(name) for name, c in columns.items()))


def unmapped(messages: DataFrame, fields: Mapping[str, tuple[str, str]], payload: str = "payload") -> DataFrame:
    """The messages that json_map() drops."""
    v = F.try_parse_json(payload)
    missing = F.lit(False)
    for path, kind in fields.values():
        missing |= strict_cast(_first(v, path), kind).isNull()
    return messages.where(missing)


def live_bars(ticks: DataFrame, period: int, late: str = "1 minute") -> DataFrame:
    """broker, symbol, t, o, h, l, c, v, last_qty of ticks (TICK). On a stream ticks later than `late` are dropped."""
    rows = ticks.withColumn("ts", F.timestamp_millis("timestamp"))
    rows = rows.withWatermark("ts", late) if ticks.isStreaming else rows
    at = order_of([c for c in ("timestamp", "event_id") if c in ticks.columns])
    g = rows.groupBy("broker", "symbol", F.window("ts", f"{period} seconds").alias("w")).agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"),
        F.round(F.sum("quantity"), 6).alias("v"), F.max_by("quantity", at).alias("last_qty"),
    )
    return g.select("broker", "symbol", F.unix_seconds("w.start").alias("t"), "o", "h", "l", "c", "v", "last_qty")


def last_prices(ticks: DataFrame) -> DataFrame:
    """broker, symbol, price, quantity, timestamp of the latest tick of each; for update mode on a stream."""
    order = order_of([c for c in ("timestamp", "event_id") if c in ticks.columns])
    g = ticks.groupBy("broker", "symbol").agg(F.max_by(F.struct("price", "quantity", "timestamp"), order).alias("x"))
    return g.select("broker", "symbol", "x.price", "x.quantity", "x.timestamp")


def version_changes(messages: DataFrame) -> DataFrame:
    """What ordered.gate_stream() passes, of a batch without idle boards."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag("version").over(Window.partitionBy("board").orderBy("seq")), F.lit(0))
    return messages.withColumn("__before", before).where("version <> __before").drop("__before")


def subscriptions(actions: DataFrame) -> DataFrame:
    """client, broker, symbol of actions (client, broker, symbol, action, seq) whose last action is `subscribe`."""
    g = actions.groupBy("client", "broker", "symbol").agg(F.max_by("action", "seq").alias("action"))
    return g.where("action = 'subscribe'").drop("action")


def routed(ticks: DataFrame, subscribed: DataFrame) -> DataFrame:
    """A row for each tick and client that subscribes to it."""
    return ticks.join(subscribed, ["broker", "symbol"])


def fan_out(sinks: Mapping[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every sink gets each batch; a sink that fails is a warning, an error only where all fail."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        failed: dict[str, Exception] = {}
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, epoch)
                except Exception as error:
                    failed[name] = error
                    logging.getLogger(__name__).warning("sink %s failed on batch %s: %s", name, epoch, error)
        finally:
            batch.unpersist()
        if sinks and len(failed) == len(sinks):
            raise RuntimeError(f"all sinks failed on batch {epoch}: {', '.join(failed)}") from next(iter(failed.values()))

    return run


def price_ingest(current: str, history: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: batches of events (product_id, buy, sell, ts, id) go to `history`, by epoch and month, and into the
    snapshot below `current`, of which only the buckets of their products are rewritten; an event before a product's last one
    by ts and id changes nothing there, in whatever batch it comes. A batch that comes again replaces
    what it wrote in the history and changes nothing in the snapshot."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            land(batch, history, mode="overwrite", epoch=F.lit(epoch))
            prices_of(spark, current).rewrite(batch, ingest, epoch)
        finally:
            batch.unpersist()

    return run


def prices_of(spark: SparkSession, current: str) -> Snapshot:
    """The snapshot of current prices that price_ingest() keeps."""
    return Snapshot(spark, current, "product_id long, buy double, sell double, ts long, last_ts long, last_id long", ["product_id"])


def finish(query: StreamingQuery) -> None:
    """Waits for a query that reads what is available."""
    query.awaitTermination()
