"""Current and historic prices: star joins, as-of values, day buckets, boards, nested documents.

Products come as `bridge` (product_id, store_id, symbol_id, product_name, scope), prices as `current` (product_id, buy,
sell, ts) and `history` (product_id, buy, sell, ts, id); times are epoch seconds. Dimensions aren't forced to broadcast:
Spark does that by their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.history import between
from .series import SPAN, chunk_window, haloed

LOCAL_SHIFT = 7 * 3600
#: What ranks a product's history rows; rows that tie are equal.
ORDER = ("ts", "id", "buy", "sell")


def scaled(rows: DataFrame, degree: float | None, columns: Sequence[str] = ("buy", "sell")) -> DataFrame:
    """Prices divided by a unit, if there is one."""
    if degree is None:
        return rows
    if not degree:
        raise ValueError("degree must not be 0")
    return rows.withColumns({c: F.round(F.col(c) / float(degree), 6) for c in columns})


def current_star(bridge: DataFrame, current: DataFrame, symbols: DataFrame, scopes: Sequence[int]) -> DataFrame:
    """symbol_id, symbol, product_id, buy, sell of the products in `scopes`; a missing price is 0."""
    rows = bridge.where(F.col("scope").isin(*scopes)).join(symbols, "symbol_id").join(current, "product_id", "left")
    return rows.select("symbol_id", "symbol", "product_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("buy", "sell")))


def store_prices(bridge: DataFrame, current: DataFrame) -> DataFrame:
    return bridge.join(current, "product_id").select("store_id", "product_id", "product_name", "buy", "sell")


def history_star(history: DataFrame, bridge: DataFrame, scopes: Sequence[int], start: int, end: int) -> DataFrame:
    """History rows of the products in `scopes` from `start` to `end`, both inclusive; of a history that lies by month only those months are read."""
    rows = between(history, start, end) if "month" in history.columns else history.where(F.col("ts").between(start, end))
    rows = rows.select("product_id", "buy", "sell", "ts", "id")
    return rows.join(bridge.where(F.col("scope").isin(*scopes)).select("product_id", "symbol_id"), "product_id")


def as_of(current: DataFrame, history: DataFrame, cut: int | None) -> DataFrame:
    """`current` with buy_diff and sell_diff against the last history row at or before `cut`; 0 without one, null without a cut."""
    if cut is None:
        return current.withColumns({"buy_diff": F.lit(None).cast("double"), "sell_diff": F.lit(None).cast("double")})
    old = history.where(F.col("ts") <= cut).groupBy("product_id").agg(F.max_by(F.struct("buy", "sell"), F.struct(*ORDER)).alias("old"))
    diff = {f"{c}_diff": F.round(F.coalesce(F.col(c) - F.col(f"old.{c}"), F.lit(0.0)), 6) for c in ("buy", "sell")}
    return current.join(old, "product_id", "left").withColumns(diff).drop("old")


def as_of_each(requests: DataFrame, history: DataFrame) -> DataFrame:
    """For each request (product_id, cut) the last price at or before its cut, null without one: one union, one window."""
    asked = requests.select("product_id", F.col("cut").alias("ts"), F.lit(1).alias("asked"), F.lit(None).cast("struct<buy:double,sell:double>").alias("p"), F.lit(None).cast("long").alias("id"))
    told = history.select("product_id", "ts", F.lit(0).alias("asked"), F.struct("buy", "sell").alias("p"), "id")
    w = Window.partitionBy("product_id").orderBy("ts", "asked", "id", "p").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(told).withColumn("last", F.last("p", ignorenulls=True).over(w)).where("asked = 1")
    return rows.select("product_id", F.col("ts").alias("cut"), "last.buy", "last.sell")


def local_bucket(at: Column, interval: int = 86400) -> Column:
    return F.floor((at + LOCAL_SHIFT) / interval)


def bucket_last(history: DataFrame, interval: int = 86400) -> DataFrame:
    """symbol_id, product_id, bucket, buy, sell: the last price of each local day or other interval."""
    last = F.max_by(F.struct("buy", "sell"), F.struct(*ORDER)).alias("p")
    g = history.groupBy("symbol_id", "product_id", local_bucket(F.col("ts"), interval).alias("bucket")).agg(last)
    return g.select("symbol_id", "product_id", "bucket", "p.buy", "p.sell")


def market_board(buckets: DataFrame, lookback: int = 7) -> DataFrame:
    """For each symbol, by its product of the smallest id: the price of the last present bucket and of the one before, their difference, the trend in percent and the prices of the last `lookback` buckets."""
    first = buckets.groupBy("symbol_id").agg(F.min("product_id").alias("product_id"))
    rows = buckets.join(first, ["symbol_id", "product_id"])
    n = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("bucket")))
    rows = rows.withColumn("n", n).where(F.col("n") <= lookback)
    g = rows.groupBy("symbol_id", "product_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "buy", "sell"))).alias("x"))
    sell = F.transform("x", lambda v: v["sell"])
    g = g.withColumns({"trend": sell, "now": F.element_at("x", -1), "old": F.when(F.size("x") > 1, F.element_at("x", -2))})
    start = F.element_at("trend", 1)
    return g.select(
        "symbol_id", "product_id", F.col("now.buy").alias("buy"), F.col("now.sell").alias("sell"), F.col("old.sell").alias("yesterday"),
        F.round(F.coalesce(F.col("now.sell") - F.col("old.sell"), F.lit(0.0)), 6).alias("diff"),
        F.round(F.when(start != 0, (F.col("now.sell") - start) / start * 100).otherwise(0.0), 6).alias("trend_pct"), "trend",
    )


def top_history(history: DataFrame, n: int) -> DataFrame:
    """The latest `n` prices of each product, newest first: product_id, rank, buy, sell, ts."""
    w = Window.partitionBy("product_id").orderBy(*(F.desc(c) for c in ORDER))
    rows = history.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    return rows.select("product_id", "rank", "buy", "sell", "ts")


def changes(history: DataFrame) -> DataFrame:
    """History rows in which a product's price differs from the row before: what would have changed the current table."""
    w = chunk_window(ORDER)
    rows = haloed(history, 1, 0, ("product_id",), order=ORDER).withColumns({"b": F.lag("buy").over(w), "s": F.lag("sell").over(w)}).where("__own")
    return rows.where("b is null or b <> buy or s <> sell").select("product_id", "ts", "id", "buy", "sell")


def ingest(current: DataFrame, events: DataFrame) -> DataFrame:
    """`current` (product_id, buy, sell, ts) after `events` of the same columns and id: the last of each product; `ts` moves only with a price.

    Where `current` has the last event's time and id as well (last_ts, last_id), an event before it changes nothing, so
    batches may come in any order.
    """
    last = events.groupBy("product_id").agg(F.max_by(F.struct("buy", "sell", "ts", "id"), F.struct(*ORDER)).alias("e"))
    both = current.withColumn("__there", F.lit(True)).join(last, "product_id", "full_outer")
    new, ordered = F.col("__there").isNull(), {"last_ts", "last_id"} <= set(current.columns)
    at = lambda *c: F.struct(*(F.col(x) for x in c))
    later = new | (at("e.ts", "e.id", "e.buy", "e.sell") > at("last_ts", "last_id", "buy", "sell")) if ordered else F.lit(True)
    later &= F.col("e").isNotNull()
    moved = later & (new | ~F.col("e.buy").eqNullSafe(F.col("buy")) | ~F.col("e.sell").eqNullSafe(F.col("sell")))
    take = lambda c, e, when: F.when(when, F.col(f"e.{e}")).otherwise(F.col(c)).alias(c)
    seen = [take("last_ts", "ts", later), take("last_id", "id", later)] if ordered else []
    return both.select("product_id", *(take(c, c, moved) for c in ("buy", "sell", "ts")), *seen)


def store_documents(stores: DataFrame, locations: DataFrame, bridge: DataFrame, current: DataFrame) -> DataFrame:
    """Stores with nested locations and products: store_id, store, locations, products (price 0 where there is none).

    Locations (location_id, store_id, district, province, address) count once for a store, district and province, the
    smallest id's address; both arrays are gathered apart, so that they don't multiply.
    """
    first = locations.groupBy("store_id", "district", "province").agg(F.min_by("address", "location_id").alias("address"))
    places = first.groupBy("store_id").agg(F.array_sort(F.collect_list(F.struct("province", "district", "address"))).alias("locations"))
    priced = bridge.join(current, "product_id", "left")
    product = F.struct("product_id", "product_name", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("buy", "sell")))
    goods = priced.groupBy("store_id").agg(F.array_sort(F.collect_set(product)).alias("products"))
    return stores.select("store_id", "store").join(places, "store_id").join(goods, "store_id")


def symbol_documents(symbols: DataFrame, bridge: DataFrame, stores: DataFrame, current: DataFrame) -> DataFrame:
    """symbol_id, symbol, stores: the stores that sell a symbol and their prices."""
    rows = bridge.join(stores.select("store_id", "store"), "store_id").join(current, "product_id", "left")
    item = F.struct("product_id", "store", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("buy", "sell")))
    return symbols.join(rows.groupBy("symbol_id").agg(F.array_sort(F.collect_list(item)).alias("stores")), "symbol_id").select("symbol_id", "symbol", "stores")


def province_products(bridge: DataFrame, placed: DataFrame, stores: DataFrame, scopes: Sequence[int], provinces: Sequence[str]) -> DataFrame:
    """province, product_id, symbol_id, store of products sold there: those of `placed` (product_id, province) in their own province, the others wherever their store is."""
    wanted = bridge.where(F.col("scope").isin(*scopes)).select("product_id", "store_id", "symbol_id")
    own = wanted.join(placed, "product_id").join(stores.select("store_id", "store"), "store_id")
    rest = wanted.join(placed, "product_id", "left_anti").join(stores.select("store_id", "store", "province"), "store_id")
    columns = ("province", "product_id", "symbol_id", "store")
    return own.select(*columns).unionByName(rest.select(*columns)).where(F.col("province").isin(*provinces)).distinct()


def province_map(rows: DataFrame, current: DataFrame) -> DataFrame:
    """province, prices: map of store to price; of a store's products there the largest id counts."""
    priced = rows.join(current, "product_id").groupBy("province", "store").agg(F.max_by(F.struct("buy", "sell"), "product_id").alias("price"))
    return priced.groupBy("province").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("store", "price")))).alias("prices"))


def branches(stores: DataFrame, other: str = "Tỉnh thành khác") -> DataFrame:
    """province (`other` for null), stores: sorted names."""
    return stores.groupBy(F.coalesce("province", F.lit(other)).alias("province")).agg(F.array_sort(F.collect_list("store")).alias("stores"))


def fx_history(fx: DataFrame, days: int = 30) -> DataFrame:
    """code, rates: the array of (date, cash, sell) of the last `days` days with a valid rate, in order."""
    w = Window.partitionBy("code").orderBy(F.desc("date"))
    rows = valid_fx(fx).withColumn("n", F.dense_rank().over(w)).where(F.col("n") <= days)
    return rows.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("date", "cash", "sell"))).alias("rates"))


def valid_fx(fx: DataFrame) -> DataFrame:
    """Rates whose cash (text) is a number other than 0, with cash and sell as numbers."""
    rows = fx.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("cash", "sell")})
    return rows.where("cash is not null and cash <> 0 and not isnan(cash)")


def load_summary(loads: DataFrame) -> DataFrame:
    """store, total, success, failed, errors, ok of loads (store, ok, message)."""
    g = loads.groupBy("store").agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("message")))).alias("errors"))
    return g.withColumn("ok", F.col("failed") == 0)


def gold_parity(ticks: DataFrame, fx: DataFrame) -> DataFrame:
    """ticks (id, symbol, day, ts in microseconds, usd) in million a tael by the last rate (day, sell) of the day or before: id, parity, change, change_pct."""
    told = fx.select(F.col("day"), F.lit(0).alias("asked"), "sell", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("ts"), F.lit(None).cast("double").alias("usd"))
    asked = ticks.select("day", F.lit(1).alias("asked"), F.lit(None).cast("double").alias("sell"), "id", "ts", "usd")
    # rates are one row a day: the running last needs days alone, so it is taken by day and joined, not over all ticks
    days = told.select("day", "sell").unionByName(asked.select("day", "sell").distinct()).groupBy("day").agg(F.max("sell").alias("sell"))
    filled = days.select("day", F.last("sell", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("sell"))
    rows = ticks.join(filled, "day").withColumn("parity", F.col("usd") * 1.205 * F.col("sell") / 1e6)
    by = ("ts", "id")
    rows = haloed(rows.select("symbol", *by, "parity"), 1, 0, ("symbol",), SPAN * 1_000_000, order=by).withColumn("before", F.lag("parity").over(chunk_window(by))).where("__own")
    pct = F.when(F.coalesce("before", F.lit(0.0)) != 0, (F.col("parity") - F.col("before")) / F.col("before") * 100).otherwise(0.0)
    return rows.select("id", F.round("parity", 6).alias("parity"), F.round(F.coalesce(F.col("parity") - F.col("before"), F.lit(0.0)), 6).alias("change"), F.round(pct, 6).alias("change_pct"))
