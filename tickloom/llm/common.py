"""What several operators share: lineage cuts, connected components, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint_folder, settled

__all__ = ["WORD", "checkpoint_folder", "connected_components", "n_words", "settled", "table", "text_key", "unused"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart: a hash of the text; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name like each of `names` that `df` has no column of."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of `edges` (a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star steps: each joins every node with the smallest of its neighbours, so the
    number of rounds grows with the logarithm of the longest path. Minima are partial aggregates and the joins are
    plain equi-joins, which adaptive execution splits where one node has most of the edges.
    """

    def normal(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        return normal(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("low"))
        hung = e.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return normal(hung.union(low.select("a", F.col("low").alias("b"))))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = settled(normal(edges))
    seen = mark(now)
    while seen[0]:
        now = settled(small(large(now)))
        was, seen = seen, mark(now)
        if was == seen:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
