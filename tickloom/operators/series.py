"""Long series over many tasks: chunks with the rows before and behind them, and recurrences as scans of affine maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]
#: Seconds of a time chunk: a series of a bar a second has 7.8 million rows in one, of a bar a minute 130,000.
SPAN = 90 * 86400
#: Rows of a chunk by number, at least.
ROWS = 50_000
#: Values that are followed one by one sooner than by a call of pandas.
SHORT = 500


def _time(at: str, span: int) -> Column:
    """The number of a time chunk; rows without a time are the first."""
    return F.coalesce(F.floor(F.col(at) / span), F.lit(-(1 << 62)))


def haloed(candles: DataFrame, before: int = 0, after: int = 0, keys: Keys = ("symbol",), span: int = SPAN, rows: int = ROWS, order: Keys = ("t",)) -> DataFrame:
    """`candles` with i (number in the series from 0), n (bars of the series), and __chunk, __at (number from the chunk's begin), __own: each row once in its own chunk, where __own is true, and in those that need it as a neighbour.

    Chunks have `rows` rows of a series, or more if `before` and `after` are more; every row of its own chunk has `before`
    rows before it there and `after` behind it, or all that there are. Numbers come from counts of time chunks of `span`
    seconds (of the first column of `order`, in its unit), of which the series' sums see one row each, so no task holds a
    series. Null keys are a key, rows without a time come first.
    """
    k = F.struct(*keys)
    timed = candles.withColumn("__k", k).withColumn("__time", _time(order[0], span))
    timed = timed.withColumn("__n", F.row_number().over(Window.partitionBy("__k", "__time").orderBy(*order)))
    counts = timed.groupBy("__k", "__time").agg(F.max("__n").alias("__size"))
    by = Window.partitionBy("__k")
    counts = counts.select("__k", "__time", F.coalesce(F.sum("__size").over(by.orderBy("__time").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__upto"), F.sum("__size").over(by).alias("n"))
    numbered = timed.join(counts, ["__k", "__time"]).withColumn("i", F.col("__upto") + F.col("__n") - 1)
    size = max(rows, before, after, 1)
    home, place = F.floor(F.col("i") / size), F.col("i") % size
    copies = [home]
    if before:
        copies.append(F.when((place >= size - before) & (F.col("i") + size - place < F.col("n")), home + 1))
    if after:
        copies.append(F.when((place < after) & (home > 0), home - 1))
    each = numbered.withColumn("__chunk", F.explode(F.array_compact(F.array(*copies)))) if len(copies) > 1 else numbered.withColumn("__chunk", home)
    return each.withColumn("__own", F.col("__chunk") == home).select(*candles.columns, "__k", "i", "n", "__chunk", "__own", (F.col("i") - F.col("__chunk") * size).alias("__at"))


def chunk_window(order: Keys = ("t",)) -> WindowSpec:
    """The rows of a chunk of haloed(), in order."""
    return Window.partitionBy("__k", "__chunk").orderBy(*order)


def own(rows: DataFrame, *columns: str) -> DataFrame:
    """Of haloed() rows those that are at home, and `columns` of them."""
    return rows.where("__own").select(*columns)


def whole_groups(batches: Iterator[pd.DataFrame], by: Keys) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, cuts) of batches that come sorted by `by`: no group is cut between two; cuts tell where the groups begin and end."""
    held: list[pd.DataFrame] = []  # the last group of what has been read, which may go on; its parts are joined once

    def numbers(rows: pd.DataFrame) -> np.ndarray:
        return rows.groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()

    def cut(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        return rows, np.concatenate(([0], np.flatnonzero(np.diff(numbers(rows))) + 1, [len(rows)]))

    for b in batches:
        if not len(b):
            continue
        ends = numbers(pd.concat([x.iloc[[-1]] for x in (*held[-1:], b.iloc[[0]], b.iloc[[-1]])], ignore_index=True))
        if held and ends[0] == ends[1] == ends[2]:
            held.append(b)
            continue
        rows = pd.concat([*held, b], ignore_index=True)
        group = numbers(rows)
        whole = int(np.searchsorted(group, group[-1]))
        held = [rows.iloc[whole:]]
        if whole:
            yield cut(rows.iloc[:whole])
    if held:
        yield cut(pd.concat(held, ignore_index=True))


def _decayed(first: float, x: np.ndarray, alpha: float) -> np.ndarray:
    """y = alpha x + (1 - alpha) y before, from `first` on."""
    if len(x) < SHORT:
        out, y, rest = [], float(first), 1 - alpha
        for v in x.tolist():
            y = alpha * v + rest * y
            out.append(y)
        return np.array(out)
    return pd.Series(np.concatenate(([first], x))).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


class Recurrence:
    """Values that follow a series of closes: a state is [values so far, last close, averages...].

    After `head` values a state is steady: what `n` more values do to its averages is an affine map of them, whose matrix
    is power(n) and whose constant is what run() makes of zeros. Before that averages are gathered by step().
    """

    names: tuple[str, ...] = ()
    head = 1
    averages = 1

    def step(self, s: list, x: float) -> tuple[float, ...]:
        """Takes one value into a state that needn't be steady; the outputs there, NaN where there is none yet."""
        raise NotImplementedError

    def run(self, averages: np.ndarray, x: np.ndarray, before: float) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """The averages after values `x`, and the outputs at each, of a steady state whose last close is `before`."""
        raise NotImplementedError

    def power(self, n: int) -> np.ndarray:
        raise NotImplementedError


class Average(Recurrence):
    """An exponential average that starts with the mean of the first `seed` closes, at the last of them."""

    def __init__(self, alpha: float, seed: int, name: str):
        self.alpha, self.head, self.names = alpha, seed, (name,)

    def step(self, s, x):
        s[0] += 1
        s[1] = x
        s[2] = s[2] + x if s[0] < self.head else (s[2] + x) / self.head if s[0] == self.head else self.alpha * x + (1 - self.alpha) * s[2]
        return (s[2] if s[0] >= self.head else np.nan,)

    def run(self, averages, x, before):
        y = _decayed(averages[0], x, self.alpha)
        return y[-1:] if len(y) else averages, (y,)

    def power(self, n):
        return np.array([[(1 - self.alpha) ** n]])


class Macd(Recurrence):
    """The difference of a fast and a slow average, and its own average."""

    names, averages = ("macd", "signal"), 3

    def __init__(self, fast: int, slow: int, signal: int):
        self.spans, self.seed = (fast, slow, signal), max(fast, slow)
        self.alphas = tuple(2 / (p + 1) for p in self.spans)
        self.head = self.seed + signal - 1

    def step(self, s, x):
        s[0] += 1
        s[1] = x
        for k in (0, 1):
            p, a = self.spans[k], self.alphas[k]
            s[2 + k] = s[2 + k] + x if s[0] < p else (s[2 + k] + x) / p if s[0] == p else a * x + (1 - a) * s[2 + k]
        n = s[0] - self.seed + 1
        if n < 1:
            return np.nan, np.nan
        m, p, a = s[2] - s[3], self.spans[2], self.alphas[2]
        s[4] = s[4] + m if n < p else (s[4] + m) / p if n == p else a * m + (1 - a) * s[4]
        return m, s[4] if n >= p else np.nan

    def run(self, averages, x, before):
        if not len(x):
            return averages, (x, x)
        fast, slow = (_decayed(averages[k], x, self.alphas[k]) for k in (0, 1))
        signal = _decayed(averages[2], fast - slow, self.alphas[2])
        return np.array([fast[-1], slow[-1], signal[-1]]), (fast - slow, signal)

    def power(self, n):
        f, s, g = (1 - a for a in self.alphas)
        c = self.alphas[2]
        return np.linalg.matrix_power(np.array([[f, 0, 0], [0, s, 0], [c * f, -c * s, g]]), n)


class Strength(Recurrence):
    """The relative strength index of `period`, from the bar behind that where its averages of gains and losses start."""

    names, averages = ("rsi",), 2

    def __init__(self, period: int):
        self.period, self.head = period, period + 1

    def _index(self, up, down):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(down == 0, 100, np.asarray(up) / np.asarray(down))
        return 100 - 100 / (1 + ratio)

    def step(self, s, x):
        d, p = x - s[1], self.period
        s[0] += 1
        s[1] = x
        n = s[0] - 1
        if n < 1:
            return (np.nan,)
        for k, v in ((2, max(d, 0.0)), (3, max(-d, 0.0))):
            s[k] = s[k] + v if n < p else (s[k] + v) / p if n == p else (s[k] * (p - 1) + v) / p
        return (float(self._index(s[2], s[3])) if n > p else np.nan,)

    def run(self, averages, x, before):
        if not len(x):
            return averages, (x,)
        d = np.diff(np.concatenate(([before], x)))
        up, down = (_decayed(averages[k], np.maximum(v, 0), 1 / self.period) for k, v in ((0, d), (1, -d)))
        return np.array([up[-1], down[-1]]), (self._index(up, down),)

    def power(self, n):
        return np.eye(2) * (1 - 1 / self.period) ** n


def _kinds(df: DataFrame, keys: Keys) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)


def followed(candles: DataFrame, what: Recurrence, keys: Keys = ("symbol",), span: int = SPAN) -> DataFrame:
    """keys, t and the outputs of `what` along each series; rows where all are missing are left out.

    A series is cut into time chunks of `span` seconds, each a group of its own. Each is folded to a few numbers: its first
    values, and the affine maps that the rest is. The maps of a series, a row for each chunk, are applied one after the
    other, which gives the state at each chunk's start; from there each chunk is followed by itself. Null keys are a key.
    """
    by = [*keys, "__chunk"]
    rows = candles.select(*keys, "t", F.col("c").cast("double").alias("c")).withColumn("__chunk", _time("t", span))
    zeros = np.zeros(what.averages)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cuts in whole_groups(batches, by):
            closes = rows["c"].to_numpy()
            out = rows.iloc[cuts[:-1]][by].reset_index(drop=True)
            parts = [closes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            out["n"] = np.diff(cuts)
            out["first"] = [x[: what.head] for x in parts]
            out["last"] = [x[-1] for x in parts]
            for name, at in (("rest", 1), ("tail", what.head)):
                out[name] = [what.run(zeros, x[at:], x[min(at, len(x)) - 1])[0] for x in parts]
            yield out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cuts in whole_groups(batches, keys):
            states = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                s = [0.0] * (2 + what.averages)
                for n, first, last, rest, tail in zip(*(rows[c].iloc[a:b] for c in ("n", "first", "last", "rest", "tail"))):
                    states.append(list(s))
                    at, constant = (1, rest) if s[0] >= what.head else (what.head, tail)
                    for x in first[:at]:
                        what.step(s, float(x))
                    if n > at:
                        s[2:] = what.power(int(n) - at) @ np.array(s[2:]) + np.asarray(constant)
                        s[0] += int(n) - at
                    s[1] = float(last)
            out = rows[by].copy()
            out["state"] = states
            yield out

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, cuts in whole_groups(batches, by):
            closes = rows["c"].to_numpy()
            outs = np.full((len(what.names), len(rows)), np.nan)
            for a, b in zip(cuts[:-1], cuts[1:]):
                s = [float(x) for x in rows["state"].iloc[a]]  # the first row of a chunk has its state, and no close
                at = a + 1
                while at < b and s[0] < what.head:
                    outs[:, at] = what.step(s, closes[at])
                    at += 1
                if at < b:
                    outs[:, at:b] = what.run(np.array(s[2:]), closes[at:b], s[1])[1]
            out = rows[[*keys, "t"]].copy()
            for name, x in zip(what.names, outs):
                out[name] = x
            out = out[rows["state"].isna()]
            yield out.dropna(subset=list(what.names), how="all")

    array, kinds = "array<double>", _kinds(candles, keys)
    folded = rows.repartition(*by).sortWithinPartitions(*by, "t").mapInPandas(fold, f"{kinds}, __chunk long, n long, first {array}, last double, rest {array}, tail {array}")
    states = folded.repartition(*keys).sortWithinPartitions(*by).mapInPandas(scan, f"{kinds}, __chunk long, state {array}")
    none = candles.schema["t"].dataType
    both = rows.select(*by, "t", "c", F.lit(None).cast(array).alias("state")).union(states.select(*by, F.lit(None).cast(none), F.lit(None).cast("double"), "state"))
    outputs = ", ".join(f"{c} double" for c in what.names)
    followed_ = both.repartition(*by).sortWithinPartitions(*by, F.col("state").isNull(), "t").mapInPandas(replay, f"{kinds}, t {none.simpleString()}, {outputs}")
    return followed_
