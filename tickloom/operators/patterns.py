"""Patterns in candles: reverse points, gaps, swings, pivots. Series are cut into chunks with their neighbouring rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import Keys, chunk_window, haloed, own, whole_groups

#: Rows of one batch of pivot ranks, about.
OUT = 200_000


def indexed(candles: DataFrame, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """`candles` with `i`, the bar's number in its series from 0."""
    return own(haloed(candles, 0, 0, keys, **chunks), *candles.columns, "i")


def reverse_points(candles: DataFrame, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """keys, t, i, o, kind of bars whose open is above (top) or below (bottom) those of both neighbours."""
    w = chunk_window()
    rows = haloed(candles.select(*keys, "t", "o"), 1, 1, keys, **chunks).withColumns({"p": F.lag("o").over(w), "q": F.lead("o").over(w)})
    o, p, n = F.col("o"), F.col("p"), F.col("q")
    rows = rows.withColumn("kind", F.when((o > p) & (o > n), "top").when((o < p) & (o < n), "bottom"))
    return own(rows.where("kind is not null"), *keys, "t", "i", "o", "kind")


def gaps(candles: DataFrame, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """keys, t, i, kind, size of bars that open above the high or below the low of the bar before."""
    w = chunk_window()
    rows = haloed(candles.select(*keys, "t", "o", "h", "l"), 1, 0, keys, **chunks).withColumns({"ph": F.lag("h").over(w), "pl": F.lag("l").over(w)})
    up, down = F.col("o") > F.col("ph"), F.col("o") < F.col("pl")
    size = F.round(F.when(up, F.col("o") - F.col("ph")).when(down, F.col("o") - F.col("pl")), 6)
    rows = rows.withColumns({"kind": F.when(up, "up").when(down, "down"), "size": size})
    return own(rows.where("kind is not null"), *keys, "t", "i", "kind", "size")


def swings(candles: DataFrame, lookback: int = 3, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """keys, t, i, high, low: bars whose high is above, or whose low is below, those of `lookback` bars on either side.

    Only bars with so many on both sides count; with a lookback of 0 every bar is both.
    """
    if lookback < 0:
        raise ValueError("lookback must not be negative")
    rows = haloed(candles.select(*keys, "t", "h", "l"), lookback, lookback, keys, **chunks)
    if lookback == 0:
        return own(rows, *keys, "t", "i").select("*", F.lit(True).alias("high"), F.lit(True).alias("low"))
    before, after = chunk_window().rowsBetween(-lookback, -1), chunk_window().rowsBetween(1, lookback)
    high = (F.col("h") > F.max("h").over(before)) & (F.col("h") > F.max("h").over(after))
    low = (F.col("l") < F.min("l").over(before)) & (F.col("l") < F.min("l").over(after))
    rows = rows.withColumns({"high": high, "low": low})
    return own(rows.where((F.col("i") >= lookback) & (F.col("i") < F.col("n") - lookback) & (F.col("high") | F.col("low"))), *keys, "t", "i", "high", "low")


class Ranked:
    """Counts of greater values in ranges of an array, by a merge-sort tree: blocks of 1, 2, 4, ... values, each sorted.

    Values are replaced by their ranks, so a level of sorted blocks is one sorted array of block times values plus rank,
    and a binary search in it answers for any number of ranges at once. A level is made when a range first needs it.
    """

    def __init__(self, values: np.ndarray):
        self.rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
        self.base = int(self.rank.max(initial=0)) + 1
        self.levels: dict[int, np.ndarray] = {}

    def _level(self, k: int) -> np.ndarray:
        if k not in self.levels:
            self.levels[k] = np.sort((np.arange(len(self.rank)) >> k) * self.base + self.rank)
        return self.levels[k]

    def _greater(self, k: int, block: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values of blocks of 2^k are greater than a rank."""
        return np.minimum((block + 1) << k, len(self.rank)) - np.searchsorted(self._level(k), block * self.base + than, "right")

    def greater(self, first: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many values at first <= place < end are greater than that at `at`."""
        a, b, than = first.copy(), end.copy(), self.rank[at]
        out, k = np.zeros(len(at), np.int64), 0
        while (a < b).any():  # at either end a block that the level above doesn't hold with its neighbour
            left = np.flatnonzero((a < b) & (a & 1 == 1))
            out[left] += self._greater(k, a[left], than[left])
            a[left] += 1
            right = np.flatnonzero((a < b) & (b & 1 == 1))
            out[right] += self._greater(k, b[right] - 1, than[right])
            a, b, k = a >> 1, b >> 1, k + 1
        return out


def _ranks(candles: DataFrame, most: int, sizes: Sequence[int] | None, share: int, keys: Keys, **chunks: int) -> DataFrame:
    """keys, t, size, rank for `sizes` (None: all) up to n / share in a series of n bars; `most` is the largest of them, and so many bars lie before a chunk's own."""
    rows = haloed(candles.select(*keys, "t", "c"), max(most - 1, 0), 0, keys, **chunks)
    kinds = ", ".join(f"{c} {candles.schema[c].dataType.simpleString()}" for c in (*keys, "t"))
    by = [*keys, "__chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, cuts in whole_groups(batches, by):
            tree = Ranked(b["c"].to_numpy(np.float64))  # of all groups of a batch: ranges stay within their own
            begin = np.repeat(cuts[:-1], np.diff(cuts))
            limit = np.where(b["__own"].to_numpy(), b["n"].to_numpy() // share, -1)
            held, waiting = [], 0
            for size in range(int(limit.max()) + 1) if sizes is None else sizes:
                here = np.flatnonzero(limit >= size)
                rank = tree.greater(np.maximum(here - size + 1, begin[here]), here + 1, here) if size else np.zeros(len(here), np.int64)
                held.append((here, np.full(len(here), size, np.int32), rank))
                waiting += len(here)
                if waiting >= OUT:
                    yield told(b, held)
                    held, waiting = [], 0
            if held:
                yield told(b, held)

    def told(b: pd.DataFrame, held: list) -> pd.DataFrame:
        at, size, rank = (np.concatenate(x) for x in zip(*held))
        return b[[*keys, "t"]].iloc[at].assign(size=size, rank=rank)

    parted = rows.select(*by, "t", "c", "n", "__own").repartition(*by).sortWithinPartitions(*by, "t")
    return parted.mapInPandas(run, f"{kinds}, size int, rank long")


def pivot_ranks(candles: DataFrame, sizes: Sequence[int] | Sequence[tuple[int, int]] | DataFrame, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """keys, t, size, rank: how many of the last `size` closes are greater than the bar's own.

    `sizes` are numbers, or ranges of them (first and last) as pairs or as a table of two columns. A series of n bars has no
    rows for sizes over n / 2. A rank takes as many binary searches as a range has sorted blocks, about twice the
    logarithm of its size; a chunk of a series holds the largest size of bars before its own.
    """
    asked = [tuple(r) for r in sizes.collect()] if isinstance(sizes, DataFrame) else [s if isinstance(s, tuple) else (s, s) for s in sizes]
    if any(a < 0 or b < a for a, b in asked):
        raise ValueError("a size must not be negative, nor a range's last size less than its first")
    every = sorted({s for a, b in asked for s in range(a, b + 1)})
    return _ranks(candles, max(every, default=0), every, 2, keys, **chunks)


def pivot_ranks_all(candles: DataFrame, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """pivot_ranks() for all sizes from 0 to a third of each series: keys, t, size, rank. The result itself grows with the square of a series."""
    longest = candles.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return _ranks(candles, longest // 3, None, 3, keys, **chunks)


def pivot_shape(candles: DataFrame, size: int, keys: Keys = ("symbol",), **chunks: int) -> DataFrame:
    """keys, t, spread (c - o) / (h - l), null for flat bars, and peak: 1 where no close of `size` bars on either side is greater, less by the shares that are."""
    rows = haloed(candles.select(*keys, "t", "o", "h", "l", "c"), size, size, keys, **chunks)
    greater = lambda step, k: F.when(step("c", k).over(chunk_window()) > F.col("c"), 1).otherwise(0)
    left, right = (reduce(add, (greater(step, k) for k in range(1, size + 1)), F.lit(0)) for step in (F.lag, F.lead))  # no lists of neighbours
    spread = (F.col("c") - F.col("o")) / F.when(F.col("h") != F.col("l"), F.col("h") - F.col("l"))
    rows = rows.withColumns({"spread": F.round(spread, 6), "peak": F.round(1 - left * right / float(size * size), 6)})
    return own(rows, *keys, "t", "spread", "peak")
