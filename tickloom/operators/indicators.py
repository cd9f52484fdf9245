"""Indicators over candles: frames over chunks of a series, recurrences as scans over its chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import heatmap
from .series import SPAN, Average, Macd, Strength, chunk_window, followed, haloed, own

Keys = Sequence[str]


def _last(p: int):
    return chunk_window().rowsBetween(-(p - 1), 0)


def _positive(*periods: int) -> None:
    if min(periods) < 1:
        raise ValueError("a period must be 1 or more")


def sma(candles: DataFrame, period: int = 20, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """keys, t, sma from the bar on that has `period` bars. `chunks` go to haloed()."""
    _positive(period)
    rows = haloed(candles.select(*keys, "t", "c"), period - 1, 0, keys, **chunks)
    return own(rows.withColumn("sma", F.avg("c").over(_last(period))).where(F.col("i") >= period - 1), *keys, "t", "sma")


def bollinger(candles: DataFrame, period: int = 20, k: float = 2.0, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """keys, t, mid, upper, lower: the mean and k population deviations about it."""
    _positive(period)
    rows = haloed(candles.select(*keys, "t", "c"), period - 1, 0, keys, **chunks)
    mid, sd = (f("c").over(_last(period)) for f in (F.avg, F.stddev_pop))
    rows = rows.withColumns({"mid": mid, "sd": sd}).where(F.col("i") >= period - 1)
    return own(rows.withColumns({"upper": F.col("mid") + k * F.col("sd"), "lower": F.col("mid") - k * F.col("sd")}), *keys, "t", "mid", "upper", "lower")


def weighted(value: str, period: int) -> Column:
    """Weighted mean of the last `period` rows of a chunk, the newest counting `period` times: the sum of number times value less the first number times the sum."""
    r = F.col("__at")  # small numbers, as they cancel
    sums = F.sum(r * F.col(value)).over(_last(period)) - (r - period) * F.sum(value).over(_last(period))
    return sums / (period * (period + 1) / 2)


def wma(rows: DataFrame, /, period: int = 20, value: str = "c", name: str = "wma", keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """`rows` with column `name`, from the row on that has `period` rows."""
    _positive(period)
    cut = haloed(rows, period - 1, 0, keys, **chunks).withColumn(name, weighted(value, period))
    return own(cut.where(F.col("i") >= period - 1), *rows.columns, name)


def ema_first(candles: DataFrame, period: int = 20, keys: Keys = ("symbol",), span: int = SPAN) -> DataFrame:
    """keys, t, ema: starts with the first close, one row for each bar."""
    _positive(period)
    return followed(candles, Average(2 / (period + 1), 1, "ema"), keys, span)


def ema_sma(candles: DataFrame, period: int = 20, keys: Keys = ("symbol",), span: int = SPAN) -> DataFrame:
    """keys, t, ema: starts with the mean of the first `period` closes."""
    _positive(period)
    return followed(candles, Average(2 / (period + 1), period, "ema"), keys, span)


def macd(candles: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: Keys = ("symbol",), span: int = SPAN) -> DataFrame:
    """keys, t, macd, signal, histogram; the signal is the average of the MACD itself and missing before it has `signal` values."""
    _positive(fast, slow, signal)
    rows = followed(candles, Macd(fast, slow, signal), keys, span)
    rows = rows.withColumn("signal", F.when(~F.isnan("signal"), F.col("signal")))
    return rows.withColumn("histogram", F.col("macd") - F.col("signal"))


def rsi(candles: DataFrame, period: int = 14, high: float = 70, low: float = 30, keys: Keys = ("symbol",), span: int = SPAN) -> DataFrame:
    """keys, t, rsi, overbought, oversold from bar `period` + 1 on, counted from 0; without losses the ratio counts as 100."""
    _positive(period)
    rows = followed(candles, Strength(period), keys, span)
    return rows.select("*", (F.col("rsi") > high).alias("overbought"), (F.col("rsi") < low).alias("oversold"))


def relative_rotation(candles: DataFrame, benchmark: DataFrame, period: int = 10, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """keys, t, ratio, momentum of each series against `benchmark` (t, c), paired by time.

    RS = 100 c / benchmark c; ratio = WMA of WMA of RS; momentum = WMA of 100 ratio / ratio `period` bars before.
    A series of n paired bars has n - 4 period + 3 rows, none if that isn't positive.
    """
    _positive(period)
    bench = benchmark.select("t", F.col("c").alias("bench"))
    rows = candles.select(*keys, "t", "c").join(bench, "t").select(*keys, "t", (100 * F.col("c") / F.col("bench")).alias("rs"))
    back = period - 1
    rows = haloed(rows, 3 * back + period, 0, keys, **chunks)  # all frames, one behind the other, lie in one chunk
    rows = rows.withColumn("once", weighted("rs", period)).withColumn("ratio", weighted("once", period))
    roc = 100 + 100 * (F.col("ratio") / F.lag("ratio", period).over(chunk_window()) - 1)
    rows = rows.withColumn("roc", roc).withColumn("momentum", weighted("roc", period))
    return own(rows.where(F.col("i") >= 3 * back + period), *keys, "t", "ratio", "momentum")


def unpaired(candles: DataFrame, benchmark: DataFrame, keys: Keys = ("symbol",)) -> DataFrame:
    """keys, bars, paired, valid: whether a series has a bar for each of the benchmark's, and no other."""
    bench = benchmark.select("t", F.lit(1).alias("there"))
    n = benchmark.agg(F.count("*").alias("n"))
    g = candles.join(bench, "t", "left").groupBy(*keys).agg(F.count("*").alias("bars"), F.count("there").alias("paired"))
    return g.join(F.broadcast(n)).select(*keys, "bars", "paired", ((F.col("bars") == F.col("n")) & (F.col("paired") == F.col("n"))).alias("valid"))


def normalised(rows: DataFrame, value: str, keys: Keys, order: str) -> DataFrame:
    """keys, order, x, y: a series scaled to 0..1 both ways; series of under 2 points are left out, flat ones are 0."""
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    low, high, n = F.min(value).over(whole), F.max(value).over(whole), F.count(F.lit(1)).over(whole)
    y = F.when(high == low, 0.0).otherwise((F.col(value) - low) / (high - low))
    return rows.select(*keys, order, ((F.row_number().over(w) - 1) / (n - 1)).alias("x"), y.alias("y"), n.alias("n")).where("n > 1").drop("n")


#: Indicators by name: the function and its parameters' defaults.
REGISTRY: dict[str, tuple[Callable[..., DataFrame], dict]] = {
    "MA": (sma, {"period": 20}), "EMA": (ema_sma, {"period": 20}), "BOLL": (bollinger, {"period": 20, "k": 2.0}),
    "RSI": (rsi, {"period": 14, "high": 70, "low": 30}), "MACD": (macd, {"fast": 12, "slow": 26, "signal": 9}),
    "HEATMAP": (heatmap, {"levels": 10, "hours": 24, "overlap": 0}),
}


def indicator(name: str, **parameters) -> Callable[[DataFrame], DataFrame]:
    """A transform for DataFrame.transform() of a registered indicator; unknown names and parameters are errors."""
    if name not in REGISTRY:
        raise ValueError(f"no indicator {name}")
    f, defaults = REGISTRY[name]
    if unknown := set(parameters) - {*defaults, "keys"}:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return lambda df: f(df, **defaults | parameters)
