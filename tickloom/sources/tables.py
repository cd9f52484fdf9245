"""Tables whose schema is data, and partitioned writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import INTEGERS, json_kind
from .history import rebalanced

KINDS = {"i32": "int", "i64": "bigint", "string": "string"}


def checked(bodies: DataFrame, schema: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Bodies (JSON text `body` and other columns) as rows of `schema` (name, kind of KINDS), and those rejected with a reason.

    i32 and i64 take integral JSON numbers in range, string takes strings; any other type rejects the body, naming the
    column. Unknown keys are ignored, missing ones null; a body with no known key is rejected.
    """
    keep = [c for c in bodies.columns if c != "body"]
    df, wrong, some = bodies.withColumn("__v", F.try_parse_json("body")), [], F.lit(False)
    for name, kind in schema:
        v = F.try_variant_get("__v", f"$['{name}']", "variant")
        what = json_kind(v)
        some |= v.isNotNull()
        if kind == "string":
            bad, value = what.isNotNull() & (what != "string"), F.try_variant_get(v, "$", "string")
        else:
            low, high = INTEGERS[kind]
            number = F.try_variant_get(v, "$", "decimal(38,0)")
            bad = what.isNotNull() & ((what != "integer") | ~F.coalesce(number.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)")), F.lit(False)))
            value = number.cast(KINDS[kind])
        wrong.append(F.when(bad, f"column {name} is not {kind}"))
        df = df.withColumn(f"__{name}", value)
    df = df.withColumn("reason", F.coalesce(F.when(F.col("__v").isNull(), "no JSON"), *wrong, F.when(~some, "no column")))
    good = df.where("reason is null").select(*keep, *(F.col(f"__{n}").alias(n) for n, _ in schema))
    return good, df.where("reason is not null").select(*keep, "body", "reason")


def read_page(rows: DataFrame, schema: Sequence[tuple[str, str]], after: int, limit: int) -> DataFrame:
    """One row of arrays, a column each, of the next `limit` rows by the first column."""
    key = schema[0][0]
    page = rows.where(F.col(key) > after).orderBy(key).limit(limit)
    item = F.array_sort(F.collect_list(F.struct(*(n for n, _ in schema))))
    return page.agg(item.alias("x")).select(*(F.col("x")[n].alias(n) for n, _ in schema))  # a field of an array of structs is an array


def write_monthly(rows: DataFrame, path: str, at: str = "created_at", mode: str = "append") -> None:
    """Rows below `path` in partitions month=YYYYMM of `at`, in even files: a large month is cut, small ones share tasks."""
    rebalanced(rows.withColumn("month", F.date_format(at, "yyyyMM")), "month").write.mode(mode).partitionBy("month").parquet(path)


def retained(spark: SparkSession, path: str, first_month: str) -> DataFrame:
    """What a month-partitioned table keeps when months before `first_month` go: a partition filter, for a rewrite or for dropping folders."""
    return spark.read.parquet(path).where(F.col("month").cast("string") >= first_month)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def discard(rows: DataFrame) -> int:
    """Sends all rows to nothing; the number sent."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def console(rows: DataFrame, prefix: str = "", limit: int = 20) -> None:
    """Prints the first `limit` rows as JSON behind a prefix, on the driver's standard output."""
    lines = rows.select(F.concat(F.lit(prefix), F.to_json(F.struct("*"))).alias("line"))
    lines.write.format("console").mode("append").option("numRows", limit).option("truncate", False).save()
