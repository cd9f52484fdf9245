"""Snapshots by key in hash buckets: a batch rewrites the buckets that it touches, and a manifest says which files count."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table: a batch rewrites the buckets of its keys, so large tables take thousands.
BUCKETS = 16


class Snapshot:
    """A table below `path`: data/version=v/bucket=b, and manifests/v.json with the version that holds each bucket.

    A version is there once its manifest is, under its own name by a rename; a reader of an older manifest keeps its files
    until the version after the next is committed. One writer at a time. Buckets are numbered by a hash of the keys.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{path}/{name}")
        self._fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        at = self._at("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The version that holds each bucket which isn't empty."""
        have = self.versions()
        if not have:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{have[-1] if version is None else version}.json", wholetext=True).first()[0]
        return {int(b): v for b, v in json.loads(text).items()}

    def read(self, of: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows, of all buckets or of those in `of`."""
        held = self.manifest(version)
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in held.items() if of is None or b in set(of)]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def rewrite(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> int:
        """Commits `merge(rows of the touched buckets, batch)` as `version`; the number of buckets written.

        `version` must grow from batch to batch; one that is committed already changes nothing, so a batch may be sent again.
        """
        if version in self.versions():
            return 0
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # buckets at most
        held = self.manifest()
        if touched:
            rows = merge(self.read(touched), batch).select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", bucket)
            rows.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
            there = {f.getPath().getName() for f in self._fs.listStatus(self._at(f"data/version={version}"))}
            held = {b: v for b, v in held.items() if b not in touched} | {b: version for b in touched if f"bucket={b}" in there}
        out = self._fs.create(self._at(f"manifests/_{version}"), True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if not self._fs.rename(self._at(f"manifests/_{version}"), self._at(f"manifests/{version}.json")):
            raise OSError(f"version {version} of {self.path} could not be committed")
        self._clear()
        return len(touched)

    def _clear(self) -> None:
        """Removes manifests but the last two, and buckets that neither has."""
        have = self.versions()
        for v in have[:-2]:
            self._fs.delete(self._at(f"manifests/{v}.json"), False)
        used = {(v, b) for m in have[-2:] for b, v in self.manifest(m).items()}
        for folder in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            v = int(folder.getPath().getName().partition("=")[2])
            if v > have[-1]:
                continue
            for f in self._fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.startswith("bucket=") and (v, int(name.partition("=")[2])) not in used:
                    self._fs.delete(f.getPath(), True)
