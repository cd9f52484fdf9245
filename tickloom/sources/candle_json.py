"""Candles from the payloads of vendors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, lossy_number


@dataclass(frozen=True)
class Profile:
    """Where a vendor's payload has its bars: the JSON path of the list of rows and the fields t, o, h, l, c, v of a row, or without `rows` a path of a list for each."""

    fields: tuple[str, ...]
    rows: str | None = None


#: The vendors' layouts.
PROFILES = {
    "ssi": Profile(tuple(f"$.data.{c}" for c in "tohlcv")),
    "dnse": Profile(tuple(f"$.{c}" for c in "tohlcv")),
    "dragon": Profile(tuple(f"$.{c}" for c in "tohlcv")),
    "vix": Profile(("time", "open", "high", "low", "close", "volume"), "$.d"),
    "simplefx": Profile(("time", "open", "high", "low", "close", "volume"), "$.data"),
    "binance": Profile(tuple(f"[{i}]" for i in range(6)), "$"),
    "msn": Profile(tuple(f"[{i}]" for i in range(6)), "$.series.dataPoints"),
    "yahoo": Profile(("$.chart.result[0].timestamp", *(f"$.chart.result[0].indicators.quote[0].{c}" for c in ("open", "high", "low", "close", "volume")))),
}
MAX_LIMIT = 1000


def _list(payload: Column, path: str) -> Column:
    return F.from_json(payload if path == "$" else F.get_json_object(payload, path), "array<string>")


def parse_candles(landed: DataFrame, provider: str, limit: int = 0) -> DataFrame:
    """Bars of landed payloads (payload and other columns, which stay): t, o, h, l, c, v.

    The six lists are read side by side up to the end of the shortest, and to `limit` bars if that is over 0. Prices may
    be numbers or texts; what is neither is 0. A payload without times, or that is no JSON, has no bars.
    """
    if limit > MAX_LIMIT:
        raise ValueError(f"limit is over {MAX_LIMIT}")
    if provider not in PROFILES:
        raise ValueError(f"no profile for {provider}")
    p, payload = PROFILES[provider], F.col("payload")
    keep = [c for c in landed.columns if c != "payload"]
    if p.rows is None:
        lists = landed.select(*keep, *(_list(payload, f).alias(f"__{i}") for i, f in enumerate(p.fields)))
        n = F.least(*(F.coalesce(F.size(f"__{i}"), F.lit(0)) for i in range(6)))
        n = F.greatest(F.least(n, F.lit(limit)) if limit > 0 else n, F.lit(0))
        bars = lists.select(*keep, F.inline(F.arrays_zip(*(F.slice(f"__{i}", F.lit(1), n).alias(f"r{i}") for i in range(6)))).alias(*(f"r{i}" for i in range(6))))
    else:
        rows = _list(payload, p.rows)
        rows = F.slice(rows, 1, limit) if limit > 0 else rows
        one = landed.select(*keep, F.explode(rows).alias("__r"))
        path = lambda f: f"${f}" if f.startswith("[") else f"$.{f}"
        bars = one.select(*keep, *(F.get_json_object("__r", path(f)).alias(f"r{i}") for i, f in enumerate(p.fields))).where("r0 is not null")
    t = epoch_seconds(F.floor(lossy_number(F.col("r0"))), F.lit(provider)).cast("long")
    return bars.select(*keep, t.alias("t"), *(lossy_number(F.col(f"r{i}")).alias(c) for i, c in enumerate("ohlcv", 1)))
