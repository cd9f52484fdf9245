"""Bars from ticks, and what is kept about bars: duplicates, coverage, freshness, access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.history import between
from .series import chunk_window, haloed

#: Seconds of a coverage block.
WEEK = 7 * 86400
Keys = Sequence[str]


def order_of(columns: Keys) -> Column:
    """What ranks rows in max_by and min_by: one column as it is, which aggregates by hash; several as a struct, which takes a sort."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def tick_bars(ticks: DataFrame, period: int, keys: Keys = ("symbol",), order: Keys = ("timestamp",)) -> DataFrame:
    """Bars of `period` seconds from ticks (keys, timestamp in ms, price, quantity): keys, t, o, h, l, c, v, last_qty.

    `order` must rank the ticks of a bar; v sums the quantities, last_qty is the last tick's.
    """
    at = order_of(order)
    t = (F.floor(F.floor(F.col("timestamp") / 1000) / period) * period).alias("t")
    return ticks.groupBy(*keys, t).agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"),
        F.round(F.sum("quantity"), 6).alias("v"), F.max_by("quantity", at).alias("last_qty"),
    )


def series_stats(candles: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Last close, its change and change in percent against the bar before (0 without one), high, low and volume of each series."""
    rows = haloed(candles, 1, 0, keys).withColumn("before", F.lag("c").over(chunk_window())).where("__own")
    g = rows.groupBy(*keys).agg(F.max_by(F.struct("c", "before"), "t").alias("x"), F.max("h").alias("high"), F.min("l").alias("low"), F.round(F.sum("v"), 6).alias("volume"))
    change = F.coalesce(F.col("x.c") - F.col("x.before"), F.lit(0.0))
    return g.select(*keys, F.col("x.c").alias("last"), F.round(change, 6).alias("change"), F.round(F.when(F.coalesce("x.before", F.lit(0.0)) == 0, 0.0).otherwise(change / F.col("x.before") * 100), 6).alias("change_pct"), "high", "low", "volume")


def merged_bars(stored: DataFrame, fetched: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Stored and fetched bars, one for each key and t; a stored bar wins."""
    both = stored.withColumn("__from", F.lit(0)).unionByName(fetched.withColumn("__from", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*keys, "t").orderBy("__from", "o", "h", "l", "c", "v"))
    return both.withColumn("__n", first).where("__n = 1").drop("__n", "__from")


def backfill(shown: DataFrame, older: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """`shown` bars and those of `older` whose time isn't there."""
    return older.join(shown, [*keys, "t"], "left_anti").unionByName(shown)


def in_range(candles: DataFrame, start: int, end: int) -> DataFrame:
    """Bars from `start` to `end`, both inclusive; of bars that lie by month only those months are read."""
    return between(candles, start, end, "t") if "month" in candles.columns else candles.where(F.col("t").between(start, end))


def blocks(ranges: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Ranges (keys, start, end) cut at block borders: keys, block, start, end; a block ends where the next begins, inclusive."""
    b = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / WEEK), F.floor(F.col("end") / WEEK))))
    return b.select(*keys, "block", F.greatest("start", F.col("block") * WEEK).alias("start"), F.least("end", (F.col("block") + 1) * WEEK).alias("end"))


def coverage(fetched: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """The least and greatest second that fetched ranges cover in each block. Holes between two ranges of a block don't show."""
    return blocks(fetched, keys).groupBy(*keys, "block").agg(F.min("start").alias("cov_from"), F.max("end").alias("cov_to"))


def coverage_of(requests: DataFrame, covered: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """For each request (id, keys, start, end) whether all of its blocks are covered, and the blocks that aren't."""
    need = blocks(requests, ["id", *keys]).join(covered, [*keys, "block"], "left")
    ok = F.coalesce((F.col("start") >= F.col("cov_from")) & (F.col("end") <= F.col("cov_to")), F.lit(False))
    return need.groupBy("id", *keys).agg(F.bool_and(ok).alias("hit"), F.array_sort(F.collect_list(F.when(~ok, F.col("block")))).alias("missing"))


def max_age(resolution: Column) -> Column:
    """Seconds after which bars of a resolution are stale."""
    return F.when(resolution.isin("1", "5"), 60).when(resolution.isin("1D", "1W", "1M"), 3600).otherwise(300)


def freshness(series: DataFrame, loaded: DataFrame, now: Column, keys: Keys = ("symbol", "resolution")) -> DataFrame:
    """For each of `series` (keys) whether its last load (keys, updated_at) is too old at `now`; never loaded is stale."""
    last = loaded.groupBy(*keys).agg(F.max("updated_at").alias("updated_at"))
    age = now - F.col("updated_at")
    return series.join(last, list(keys), "left").select(*keys, "updated_at", F.coalesce(age > max_age(F.col("resolution")), F.lit(True)).alias("stale"))


def lookback(requests: DataFrame, now: Column) -> DataFrame:
    """Requests (id, resolution, look_back) with `start` and the finer `source`; those of other resolutions are left out."""
    unit = F.when(F.col("resolution") == "1H", 3600).when(F.col("resolution") == "1D", 86400).when(F.col("resolution") == "1W", WEEK)
    source = F.when(F.col("resolution") == "1H", "1m").when(F.col("resolution") == "1D", "1H").when(F.col("resolution") == "1W", "1D")
    return requests.withColumn("source", source).withColumn("start", now - F.col("look_back") * unit).where("source is not null")


def heat_colour(candles: DataFrame) -> DataFrame:
    return candles.withColumn("up", F.col("c") >= F.col("o"))
