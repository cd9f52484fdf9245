"""Histories below month partitions: even files, and reads that touch the months asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settled


def month_of(seconds: Column | int) -> Column:
    """yyyymm of epoch seconds, in UTC."""
    at = F.timestamp_seconds(F.lit(seconds) if isinstance(seconds, int) else seconds)
    return F.year(at) * 100 + F.month(at)


def rebalanced(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` dealt by `by`, where adaptive execution cuts what is large into even parts and joins what is small, by spark.sql.adaptive.advisoryPartitionSizeInBytes: a month is neither one task nor many small files."""
    return rows.hint("rebalance", *(F.col(c) for c in by))


def land(rows: DataFrame, path: str, at: str = "ts", mode: str = "append", **more: Column) -> None:
    """Appends `rows` below `path` in partitions month=yyyymm of the epoch seconds `at`, and before it of the columns `more`. Rows without a time go to a partition of their own."""
    rows = rows.withColumns({**more, "month": month_of(F.col(at))})
    writer = rebalanced(rows, "month").write.mode(mode).partitionBy(*more, "month")
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else writer).parquet(path)


def between(history: DataFrame, start: int, end: int, at: str = "ts") -> DataFrame:
    """Rows from `start` to `end`, both inclusive, of a history that lies by month: other months' folders aren't listed, and within a month files' ranges of `at` are asked. Without `month`."""
    first, last = (history.sparkSession.range(1).select(month_of(x)).first()[0] for x in (start, end))
    return history.where(F.col("month").between(first, last) & F.col(at).between(start, end)).drop("month")


def asked(history: DataFrame, requests: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """Rows of `history` for each of `requests` (id, key, start, end), with its id; a row may serve several.

    Requests are written out by month, and the history meets them by month and key, so its scan reads only months that some
    request has, whatever their number (dynamic pruning, where Spark broadcasts the requests).
    """
    months = F.sequence(F.trunc(F.timestamp_seconds("start"), "month"), F.trunc(F.timestamp_seconds("end"), "month"), F.expr("interval 1 month"))
    wanted = requests.where("start <= end").withColumn("m", F.explode(months))
    wanted = settled(wanted.select("id", F.col(key).alias("__key"), "start", "end", (F.year("m") * 100 + F.month("m")).alias("__month"))).where("__month > 0")
    rows = history.join(wanted, (F.col("month") == F.col("__month")) & (F.col(key) == F.col("__key")))
    return rows.where(F.col(at).between(F.col("start"), F.col("end"))).select("id", *(c for c in history.columns if c != "month"))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The history below `path`, with its column month."""
    return (spark.read.schema(f"{schema}, month int") if schema else spark.read).parquet(path)
