"""Paths into JSON, compiled on the driver to DataFrame operations on variants."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(path: str) -> list[tuple[str, object]]:
    """Steps of a path such as a.b[].c[1]["k"].0{x,y}: ("field", name), ("at", index), ("iter", None), ("select", names).

    A number between dots is an index or a key. A bracket or brace without its end is an error.
    """
    steps: list[tuple[str, object]] = []
    at = 0
    while at < len(path):
        rest = path[at:]
        if m := re.match(r"\.?\[\]", rest):
            steps.append(("iter", None))
        elif m := re.match(r"\.?\[(\d+)\]", rest):
            steps.append(("at", int(m[1])))
        elif m := re.match(r"""\.?\[(?:"([^"]*)"|'([^']*)')\]""", rest):
            steps.append(("field", m[1] if m[1] is not None else m[2]))
        elif m := re.match(r"\.?\{([^}]*)\}", rest):
            steps.append(("select", [x.strip() for x in m[1].split(",") if x.strip()]))
        elif m := re.match(r"\.?(\d+)(?=[.\[{]|$)", rest):
            steps.append(("at", int(m[1])))
        elif m := re.match(r"\.?([^.\[\]{}]+)", rest):
            steps.append(("field", m[1]))
        elif rest == ".":
            break
        else:
            raise ValueError(f"path {path!r} is wrong at {at}")
        at += m.end()
    return steps


def _quoted(name: str) -> str:
    return "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def execute(docs: DataFrame, column: str, path: str, name: str = "match") -> DataFrame:
    """`docs` with a row for each match of `path` in the JSON text of `column`: `name` (variant) and `<name>_pos` (array of the positions iterated over).

    Documents that are no JSON, missing keys and iterations over anything but arrays and objects have no matches.
    """
    here, pos = f"__{name}", f"{name}_pos"
    df = docs.withColumn(here, F.try_parse_json(column)).withColumn(pos, F.array().cast("array<int>"))
    for kind, what in parse(path):
        if kind == "field":
            df = df.withColumn(here, F.try_variant_get(here, "$" + _quoted(str(what)), "variant"))
        elif kind == "at":
            df = df.withColumn(here, F.coalesce(F.try_variant_get(here, f"$[{what}]", "variant"), F.try_variant_get(here, "$" + _quoted(str(what)), "variant")))
        elif kind == "select":
            fields = [F.try_variant_get(here, "$" + _quoted(n), "variant").alias(n) for n in what]
            df = df.withColumn(here, F.when(F.col(here).isNotNull(), F.try_parse_json(F.to_json(F.struct(*fields)))))
        else:
            columns = [c for c in df.columns if c not in (here, pos)]
            inner = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(here).outer()))
            df = inner.select(*columns, F.col("value").alias(here), F.concat(F.col(pos), F.array("pos")).alias(pos))
        df = df.where(F.col(here).isNotNull())
    return df.withColumnRenamed(here, name)
