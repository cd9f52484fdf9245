"""Substring search and keyword matching."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settled

#: Parts in which the first rows of a group are looked for.
PARTS = 32


def containing(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(name, query) of all `names` (name) that contain one of `queries` (query); both distinct, empty queries find nothing.

    A query of three letters or more meets the names that have its rarest piece of three letters, by a join that carries
    numbers of names, not names: a piece that nearly all names have is some query's key only if all its pieces are like
    that. The few candidates get their names back and are tested. Shorter queries are looked for among the names' own
    pieces, which are made only if there are such queries.
    """
    n = names.where("name is not null").distinct().withColumn("__key", F.xxhash64("name"))
    q = settled(queries.where("query <> ''").distinct())
    pieces = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(k))))
    asked = q.where(F.length("query") >= 3).select("query", F.explode(pieces("query", 3)).alias("gram"))
    grams = n.select("__key", F.explode(pieces("name", 3)).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    grams = settled(grams)
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    # a piece that no name has leaves its query without a name
    rare = asked.join(often, "gram", "left").groupBy("query").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rare.join(grams, "gram").select("query", "__key").join(n, "__key").where(F.contains("name", "query")).select("name", "query")
    short = q.where(F.length("query") < 3)
    if not short.isEmpty():
        own = n.select("name", F.explode(F.array_union(pieces("name", 1), pieces("name", 2))).alias("query"))
        found = found.unionByName(own.join(short, "query", "left_semi").select("name", "query"))
    return found


def first_of_each(rows: DataFrame, group: str, by: str, limit: int) -> DataFrame:
    """The first `limit` rows of each `group` by `by`: first of parts of a group, so that no task sorts a large one."""
    salt = F.pmod(F.xxhash64(by), F.lit(PARTS))
    n = F.row_number().over(Window.partitionBy(group, salt).orderBy(by))
    rows = rows.withColumn("__n", n).where(F.col("__n") <= limit)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(by))).where(F.col("__n") <= limit).drop("__n")


def substring_search(names: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, rank, id: for each query (query_id, query) the first `limit` names (id, name) by id that contain it, case aside.

    Different names and different queries are matched, so repeated ones cost nothing; see containing(). Empty queries find
    nothing. At most 100 are given.
    """
    limit = min(limit, 100)
    ids = names.select("id", F.lower("name").alias("name")).distinct()
    asked = queries.select("query_id", F.lower("query").alias("query"))
    found = containing(ids.select("name"), asked.select("query"))
    first = first_of_each(ids.join(found, "name").select("query", "id").distinct(), "query", "id", limit)
    hits = asked.join(first, "query").select("query_id", "id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    return hits.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select("query_id", "rank", "id")


def keywords(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns that occur in a text, in order; empty and repeated ones don't count. For up to about a thousand patterns."""
    own = list(dict.fromkeys(p for p in patterns if p))
    return F.filter(F.array(*map(F.lit, own)).cast("array<string>"), lambda p: F.contains(text, p))


def has_keyword(text: Column, patterns: Sequence[str]) -> Column:
    return F.size(keywords(text, patterns)) > 0


def many_keywords(patterns: Sequence[str]) -> Callable[[Column], Column]:
    """has_keyword() for thousands of patterns: one compiled alternation a worker, over Arrow batches."""
    own = sorted({p for p in patterns if p}, key=lambda p: (-len(p), p))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = re.compile("|".join(map(re.escape, own))) if own else None
        for texts in batches:
            yield texts.map(lambda t: bool(found and t is not None and found.search(t))).astype(bool)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "boolean")


def token_matcher(patterns: Sequence[str], split: Callable[[str], list[str]] = list, equal: Callable[[str, str], bool] | None = None) -> Callable[[Column], Column]:
    """A column function: the patterns whose tokens stand one after the other in a text, by the caller's `split` and `equal`."""
    own = [(p, split(p)) for p in dict.fromkeys(p for p in patterns if p)]

    def found(text: str | None) -> list[str]:
        tokens = split(text) if text else []
        same = equal or str.__eq__
        return [p for p, want in own if any(all(same(a, b) for a, b in zip(want, tokens[i : i + len(want)])) for i in range(len(tokens) - len(want) + 1))]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(found)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")
