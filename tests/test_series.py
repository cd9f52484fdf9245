"""One long series over many chunks against the same series in one, and against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import views
from tickloom.operators import indicators, patterns
from tickloom.operators.series import haloed

FRAMES = {
    "sma": lambda c, **k: indicators.sma(c, 7, **k), "bollinger": lambda c, **k: indicators.bollinger(c, 9, **k), "wma": lambda c, **k: indicators.wma(c, 6, **k),
    "rotation": lambda c, **k: indicators.relative_rotation(c, c.where("symbol = 'a'"), 4, **k), "reverse": patterns.reverse_points, "gaps": patterns.gaps, "swings": lambda c, **k: patterns.swings(c, 3, **k),
    "shape": lambda c, **k: patterns.pivot_shape(c, 4, **k), "ranks": lambda c, **k: patterns.pivot_ranks(c, [(0, 3), (40, 41)], **k), "all": patterns.pivot_ranks_all, "indexed": patterns.indexed,
}
SCANS = {"first": lambda c, **k: indicators.ema_first(c, 5, **k), "sma": lambda c, **k: indicators.ema_sma(c, 20, **k), "macd": lambda c, **k: indicators.macd(c, 5, 12, 9, **k), "macd2": lambda c, **k: indicators.macd(c, 12, 5, 1, **k), "rsi": lambda c, **k: indicators.rsi(c, 14, **k)}


@pytest.fixture(scope="module")
def bars(spark):
    """Series of 300 bars, of one, of a few with holes, of a null key, and none."""
    r = random.Random(5)
    rows = []
    for symbol, n, step in (("a", 300, 60), ("b", 300, 60), ("one", 1, 60), ("two", 23, 4000), (None, 50, 300)):
        price = 100.0
        for k in range(n):
            price = round(price + r.uniform(-3, 3), 2)
            o = round(price + r.uniform(-2, 2), 1)
            rows.append((symbol, k * step + (7200 if k > n // 2 else 0), o, max(price, o) + 1, min(price, o) - 1, price, 1.0))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, t long, o double, h double, l double, c double, v double").cache()


def plain(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def near(a, b):
    a, b = (sorted((tuple(r) for r in df.collect()), key=lambda r: str(r[:3])) for df in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9) for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", FRAMES)
def test_frames_over_borders(bars, name):
    near(FRAMES[name](bars), FRAMES[name](bars, span=700, rows=13))


@pytest.mark.parametrize("name", SCANS)
def test_scans_over_borders(bars, name):
    """Chunks of a bar, of a few and of all."""
    whole = SCANS[name](bars)
    for span in (60, 700):
        near(whole, SCANS[name](bars, span=span))


def test_scans_against_one_value_at_a_time(bars):
    x = [r.c for r in bars.where("symbol = 'b'").orderBy("t").collect()]
    one = lambda df, c: [r[c] for r in df.where("symbol = 'b'").orderBy("t").collect()]
    a, y, want = 2 / 21, None, []
    for k in range(19, len(x)):
        y = sum(x[:20]) / 20 if y is None else a * x[k] + (1 - a) * y
        want.append(y)
    assert np.allclose(one(indicators.ema_sma(bars, 20, span=500), "ema"), want, rtol=1e-12)
    d = np.diff(x)
    up, down, want = np.maximum(d[:14], 0).mean(), np.maximum(-d[:14], 0).mean(), []
    for v in d[14:]:
        up, down = (up * 13 + max(v, 0)) / 14, (down * 13 + max(-v, 0)) / 14
        want.append(100 - 100 / (1 + (up / down if down else 100)))
    assert np.allclose(one(indicators.rsi(bars, 14, span=500), "rsi"), want, rtol=1e-9)


def test_halo_has_the_neighbours(bars):
    rows = haloed(bars.select("symbol", "t"), 5, 2, span=300, rows=8).toPandas()
    for (_, _), g in rows.groupby([rows["symbol"].fillna("~"), "__chunk"]):
        at = g["i"].sort_values().tolist()
        home = g[g["__own"]]["i"]
        n = g["n"].iloc[0]
        assert at == list(range(max(home.min() - 5, 0), min(home.max() + 2, n - 1) + 1))
    assert rows["__own"].sum() == bars.count()


def test_one_series_over_all_tasks(spark, small):
    """All events as one series: no window is dealt by the series alone, chunks hold about as much, results are those of one pass."""
    ticks = views.ticks(spark, small).select(F.lit("all").alias("symbol"), (F.col("ts_us") * 10 + F.col("event_id") % 10).alias("t"), F.col("price").alias("c")).dropDuplicates(["t"])
    low, high = ticks.agg(F.min("t"), F.max("t")).first()
    span = (high - low) // 8 + 1
    got = indicators.ema_first(ticks, 9, span=span).orderBy("t").toPandas()
    want = ticks.orderBy("t").toPandas()["c"].ewm(alpha=0.2, adjust=False).mean()
    assert np.allclose(got["ema"], want, rtol=1e-9)
    sizes = ticks.groupBy(F.floor(F.col("t") / span)).count().toPandas()["count"]
    assert len(sizes) >= 8 and sizes.max() <= 2 * sizes.median()
    plan = indicators.sma(ticks.withColumns({x: F.col("c") for x in "ohl"}), 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line and "avg(" in line]
    assert windows and all("__chunk" in line for line in windows)


def test_ranks_against_plain_python():
    r = np.random.default_rng(3)
    for n in (1, 2, 33, 200):
        x = np.round(r.normal(0, 1, n), 1)
        tree = patterns.Ranked(x)
        first = r.integers(0, n, 50)
        end = np.minimum(first + r.integers(0, n + 1, 50), n)
        at = r.integers(0, n, 50)
        assert tree.greater(first, end, at).tolist() == [int((x[a:b] > x[k]).sum()) for a, b, k in zip(first, end, at)]


def test_ranges_of_sizes_as_a_table(spark, bars):
    table = spark.createDataFrame([(2, 4), (10, 10), (4, 5)], "first int, last int")
    assert plain(patterns.pivot_ranks(bars, table)) == plain(patterns.pivot_ranks(bars, [2, 3, 4, 5, 10]))
    with pytest.raises(ValueError):
        patterns.pivot_ranks(bars, [(3, 2)])


def test_bars_without_a_time_come_first(spark):
    rows = spark.createDataFrame([("a", None, 5.0), ("a", 10, 7.0), ("a", 20, 9.0)], "symbol string, t long, c double")
    assert [(r.t, r.sma) for r in indicators.sma(rows, 2, span=15, rows=2).orderBy("t").collect()] == [(10, 6.0), (20, 8.0)]
    assert [(r.t, r.ema) for r in indicators.ema_first(rows, 3, span=15).orderBy("t").collect()] == [(None, 5.0), (10, 6.0), (20, 7.5)]


def test_no_bars(bars):
    for f in (*FRAMES.values(), *SCANS.values()):
        assert f(bars.limit(0)).count() == 0
