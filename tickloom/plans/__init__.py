"""The library's queries over the given tables."""

from __future__ import annotations

from . import candle_queries, function_queries, price_queries, source_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
