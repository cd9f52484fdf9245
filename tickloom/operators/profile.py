"""Volume profiles: levels, sliding windows, ranges of levels, timelines."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..storage import settled
from .series import whole_groups

Keys = Sequence[str]
#: What a bar has besides its keys.
BAR = ("t", "o", "h", "l", "c", "v", "last_qty")


def _levels(candles: DataFrame, levels: int, keys: Keys) -> DataFrame:
    """`candles` with the series' low and bin width and the bar's first and last level; flat series are left out."""
    if levels < 1:
        raise ValueError("levels must be 1 or more")
    # partial minima and an equi-join, which can be split, so that no task holds a hot series' bars
    edges = candles.groupBy(*keys).agg(F.min("l").alias("low"), F.max("h").alias("high")).where("high > low")
    rows = candles.join(edges, list(keys))
    rows = rows.withColumn("bin", (F.col("high") - F.col("low")) / levels)
    at = lambda c: F.least(F.floor((F.col(c) - F.col("low")) / F.col("bin")), F.lit(levels - 1))
    return rows.withColumns({"a": at("l"), "b": at("h")})


def _filled(sums: DataFrame, group: Sequence[str], levels: int) -> DataFrame:
    """`sums` (group, level, v) with a row for each level of each group, 0 where there was none.

    A group's levels, a few hundred at most, meet in a map; that needs no join, and no exchange where the rows are
    already dealt by a part of the group.
    """
    by_level = F.map_from_entries(F.collect_list(F.struct("level", "v"))).alias("of")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(levels - 1).cast("long"))).alias("level")
    rows = sums.groupBy(*group).agg(by_level).select(*group, "of", every)
    return rows.withColumn("volume", F.round(F.coalesce(F.try_element_at("of", F.col("level")), F.lit(0.0)), 6)).drop("of")


def volume_profile(candles: DataFrame, levels: int = 10, keys: Keys = ("symbol",)) -> DataFrame:
    """keys, level, price, volume: each bar's volume spread evenly over the levels between its low and its high.

    Levels cut the series' whole price range evenly; price is a level's lower edge. Levels without volume are there with 0.
    """
    rows = _levels(candles, levels, keys)
    each = rows.select(*keys, "low", "bin", F.explode(F.sequence("a", "b")).alias("level"), (F.col("v") / (F.col("b") - F.col("a") + 1)).alias("v"))
    sums = each.groupBy(*keys, "low", "bin", "level").agg(F.sum("v").alias("v"))
    price = F.round(F.col("low") + F.col("level") * F.col("bin"), 6)
    return _filled(sums, [*keys, "low", "bin"], levels).select(*keys, "level", price.alias("price"), "volume")


def heatmap(candles: DataFrame, levels: int = 10, hours: int = 24, overlap: int = 0, keys: Keys = ("symbol",)) -> DataFrame:
    """keys, window, level, volume: profiles of windows of `overlap` pins, a step of one apart; 0 is one window of all.

    A pin is a span of `hours` with bars in it. Series with fewer pins than `overlap` are left out. Bars are summed by pin
    and level before they are repeated for the windows; every window has a pin, so none is without rows.
    """
    if hours < 1 or overlap < 0:
        raise ValueError("hours must be 1 or more and overlap not negative")
    rows = _levels(candles, levels, keys).withColumn("pin", F.floor(F.col("t") / (hours * 3600)) if overlap else F.lit(0))
    each = rows.select(*keys, "pin", F.explode(F.sequence("a", "b")).alias("level"), (F.col("v") / (F.col("b") - F.col("a") + 1)).alias("v"))
    sums = each.groupBy(*keys, "pin", "level").agg(F.sum("v").alias("v"))
    # pins are numbered after the sums: a series has a row for each pin and level here, not for each bar
    sums = sums.withColumn("p", F.dense_rank().over(Window.partitionBy(*keys).orderBy("pin")) - 1)
    width = overlap or 1
    sums = sums.withColumn("pins", F.max("p").over(Window.partitionBy(*keys)) + 1).where(F.col("pins") >= width)
    first, last = F.greatest(F.col("p") - (width - 1), F.lit(0)), F.least(F.col("p"), F.col("pins") - width)
    windows = sums.select(*keys, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("window"), "level", "v")
    windows = windows.groupBy(*keys, "window", "level").agg(F.sum("v").alias("v"))
    return _filled(windows, [*keys, "window"], levels)


def level_totals(heat: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    return heat.groupBy(*keys, "level").agg(F.round(F.sum("volume"), 6).alias("total"))


def matrix(heat: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """keys, level, volumes: the array of a level's volumes by window."""
    rows = F.array_sort(F.collect_list(F.struct("window", "volume")))
    return heat.groupBy(*keys, "level").agg(F.transform(rows, lambda x: x["volume"]).alias("volumes"))


def smoothed(totals: DataFrame, window: int, keys: Keys = ("symbol",)) -> DataFrame:
    """keys, level, total: the mean of `window` / 2 levels on either side, fewer at the ends."""
    half = window // 2
    w = Window.partitionBy(*keys).orderBy("level").rowsBetween(-half, half)
    return totals.select(*keys, "level", F.round(F.avg("total").over(w), 6).alias("total"))


def grouped_levels(total: Sequence[float]) -> list[tuple[int, int, int]]:
    """(begin, center, end) of the ranges that grow around levels of much volume, in order of creation.

    Levels come by volume, largest first, the lower one of equals; each goes to the first range, by center, that it
    touches, else it starts one. Ranges don't merge.
    """
    made: list[list[int]] = []
    for level in sorted(range(len(total)), key=lambda i: (-total[i], i)):
        for r in sorted(made, key=lambda r: r[1]):
            if level in (r[0] - 1, r[2] + 1):
                r[0], r[2] = min(r[0], level), max(r[2], level)
                break
        else:
            made.append([level, level, level])
    return [tuple(r) for r in made]


def level_ranges(totals: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """keys, range, begin, center, end of each series' levels (keys, level, total); a series has as many rows as levels."""
    kinds = {f.name: f.dataType.simpleString() for f in totals.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, cuts in whole_groups(batches, keys):  # many series a batch
            total = b["total"].to_numpy()
            found = [(x, k, *r) for x, y in zip(cuts[:-1], cuts[1:]) for k, r in enumerate(grouped_levels(total[x:y].tolist()))]
            at, *columns = zip(*found)
            yield b[list(keys)].iloc[list(at)].assign(**dict(zip(("range", "begin", "center", "end"), columns)))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", range long, begin long, center long, end long"
    return totals.repartition(*keys).sortWithinPartitions(*keys, "level").mapInPandas(run, schema)


def timelines(heat: DataFrame, ranges: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """keys, range, start, end (exclusive): runs of two or more windows in which a range has over 1 % of its largest volume."""
    levels = ranges.select(*keys, "range", F.explode(F.sequence("begin", "end")).alias("level"))  # a level is in one range
    inside = heat.join(levels, [*keys, "level"])
    sums = inside.groupBy(*keys, "range", "window").agg(F.sum("volume").alias("v"))
    most = F.greatest(F.max("v").over(Window.partitionBy(*keys, "range")) * 0.01, F.lit(2.220446049250313e-16))
    live = sums.select(*keys, "range", "window", (F.col("v") > most).alias("live")).where("live")
    island = F.col("window") - F.row_number().over(Window.partitionBy(*keys, "range").orderBy("window"))
    runs = live.withColumn("island", island).groupBy(*keys, "range", "island").agg(F.min("window").alias("start"), (F.max("window") + 1).alias("end"))
    return runs.where("end - start > 1").drop("island")


def intensity(ranges: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """Ranges with `intensity`: 1 for the first, falling evenly to 0 for the last."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("range")) - 1
    return ranges.withColumn("intensity", F.round(F.when(n == 1, 1.0).otherwise(1 - rank / (n - 1)), 6))


def profile_tables(candles: DataFrame, levels: int = 10, hours: int = 24, overlap: int = 0, keys: Keys = ("symbol",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heatmap (written once, as all three read it), ranges and timelines of each series."""
    heat = settled(heatmap(candles, levels, hours, overlap, keys))
    ranges = level_ranges(smoothed(level_totals(heat, keys), levels // 10, keys), keys)
    return heat, ranges, timelines(heat, ranges, keys)


class VolumeProfile:
    """volume_profile() as a table function: SELECT * FROM volume_profile(TABLE(candles) PARTITION BY (symbol) ORDER BY (t), 10).

    Its argument has l, h, v and any key columns, which come back; the levels are a constant. A partition's bars are held as
    three arrays of numbers; the DataFrame function splits a large series over tasks.
    """

    @staticmethod
    def analyze(candles: AnalyzeArgument, levels: AnalyzeArgument) -> AnalyzeResult:
        if not candles.isTable or {"l", "h", "v"} - set(candles.dataType.fieldNames()):
            raise ValueError("the first argument is a table with l, h and v")
        if levels.value is None or levels.value < 1:
            raise ValueError("levels is a constant of 1 or more")
        keys = [f for f in candles.dataType.fields if f.name not in BAR]
        return AnalyzeResult(StructType(keys).add("level", "long").add("price", "double").add("volume", "double"))

    def __init__(self):
        self.key: tuple | None = None
        self.low, self.high, self.volume = (array("d") for _ in range(3))
        self.levels = 0

    def eval(self, candles: Row, levels: int) -> None:
        if self.key is None:
            self.key, self.levels = tuple(v for c, v in candles.asDict().items() if c not in BAR), levels
        for to, c in ((self.low, "l"), (self.high, "h"), (self.volume, "v")):
            to.append(float("nan") if candles[c] is None else candles[c])

    def terminate(self) -> Iterator[tuple]:
        if self.key is None:
            return
        low, high, volume = (np.frombuffer(x) for x in (self.low, self.high, self.volume))
        bottom, top = np.nanmin(low), np.nanmax(high)
        if not top > bottom:
            return
        width = (top - bottom) / self.levels
        # a quotient that rounds up to a level's edge is that level, as in SQL (numpy's // takes the one below), and a bound that is missing is the last level
        first, last = (np.fmin(np.floor((x - bottom) / width), self.levels - 1).astype(int) for x in (low, high))
        there = (first <= last) & ~np.isnan(volume)
        first, last, volume = first[there], last[there], volume[there]
        each = volume / (last - first + 1)
        steps = np.bincount(first, each, self.levels + 1) - np.bincount(last + 1, each, self.levels + 1)
        for k, v in enumerate(np.cumsum(steps)[: self.levels]):
            yield *self.key, k, float(bottom + k * width), float(v)


def register_profile(spark: SparkSession, name: str = "volume_profile") -> None:
    """Makes VolumeProfile a table function of SQL."""
    spark.udtf.register(name, udtf(VolumeProfile))
