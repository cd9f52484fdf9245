"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, settled

#: Pieces that one task's packer holds, about: documents are dealt over as many packers as this needs.
SHARD = 4096


def pack_shard(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, position in the bin and word offset in the bin of every piece, taken in the given order.

    Bins are kept ordered by residual. A piece goes to the bin of the smallest residual that takes it: a binary search
    finds the first that is large enough, and the search goes on over its successors until one has neither the piece's
    source nor its cluster in its bitmaps; else a new bin is opened. source and cluster count from 0; -1 conflicts with nothing.
    """
    n = len(size)
    words = [int(x.max(initial=-1)) // 64 + 1 for x in (source, cluster)]
    maps = [np.zeros((n + 1, max(w, 1)), np.uint64) for w in words]
    residual, order = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)  # of open bins, by residual
    bins, held, into = 0, np.zeros(n + 1, np.int64), (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))
    opened = 0
    for k in range(n):
        need = int(size[k])
        at = int(np.searchsorted(residual[:opened], need))
        near = order[at:opened]
        free = np.ones(len(near), bool)
        marks = []
        for m, x in zip(maps, (int(source[k]), int(cluster[k]))):
            if x >= 0:
                bit = np.uint64(1 << (x & 63))
                marks.append((m, x >> 6, bit))
                free &= (m[near, x >> 6] & bit) == 0
        first = int(free.argmax()) if len(free) else 0
        if len(free) and free[first]:
            at += first
            b, left = int(order[at]), int(residual[at])
            residual[at : opened - 1], order[at : opened - 1] = residual[at + 1 : opened].copy(), order[at + 1 : opened].copy()
            opened -= 1
        else:
            b, left = bins, capacity
            bins += 1
        for m, w, bit in marks:
            m[b, w] |= bit
        into[0][k], into[1][k], into[2][k] = b, held[b], capacity - left
        held[b] += 1
        left -= need
        if left > 0:
            at = int(np.searchsorted(residual[:opened], left))
            residual[at + 1 : opened + 1], order[at + 1 : opened + 1] = residual[at:opened].copy(), order[at:opened].copy()
            residual[at], order[at] = left, b
            opened += 1
    return into


def exact_cluster(text: Column) -> Column:
    """A key that texts share which are equal but for case and white space; null for texts without words."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def pack(docs: DataFrame, capacity: int = 2048, cluster: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row for each piece of a document: doc_id, copy, source, cluster, piece, start_word, n_words, bin_id, position, bin_offset.

    Documents (doc_id, text, source; `cluster` names a column of duplicate clusters, else exact_cluster() is used) are cut
    into pieces of `capacity` words. A full piece is a bin of its own. The last pieces are dealt over shards by a hash of
    id and copy, `shard` a shard about, and packed there, largest first, in bins that hold one piece at most of a source
    and of a cluster. A hot source or cluster therefore opens more bins, spread evenly over the shards; nothing is dropped.

    Null texts and texts without words have one piece of 0 words in a bin with position and conflicts like any other. Null
    sources and clusters conflict with nothing. Rows of one doc_id are copies 0, 1, ... and rows without one are so numbered
    within their cluster; copies never share a bin unless without words.
    """
    key = F.col(cluster) if cluster else exact_cluster(F.col("text"))
    rows = docs.select("doc_id", "source", key.alias("cluster"), n_words(F.col("text")).alias("size"))
    # rows without an id are numbered by cluster, or else by what size they have, as there may be very many
    rows = rows.withColumn("nameless", F.when(F.col("doc_id").isNull(), F.coalesce(F.col("cluster").cast("string"), F.concat(F.lit("size"), F.col("size").cast("string")))))
    copies = Window.partitionBy("doc_id", "nameless").orderBy("source", "cluster", "size")
    rows = settled(rows.withColumn("copy", F.row_number().over(copies) - 1))
    full = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / capacity)
    rows = rows.withColumn("full", full.cast("int"))
    shards = max(1, -(-rows.count() // shard))

    whole = rows.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    whole = whole.select(
        "doc_id", "copy", "source", "cluster", "piece", (F.col("piece").cast("long") * capacity).alias("start_word"), F.lit(capacity).cast("long").alias("n_words"),
        F.concat_ws("-", F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("nameless"))), F.col("copy").cast("string"), F.col("piece").cast("string")).alias("bin_id"),
        F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("bin_offset"),
    )

    tail = rows.withColumn("start_word", F.col("full").cast("long") * capacity)
    kinds = {c: tail.schema[c].dataType for c in ("doc_id", "source", "cluster")}
    tail = tail.select(*(F.col(c).cast("string").alias(c) if c in kinds else c for c in ("doc_id", "copy", "source", "cluster")), F.col("full").alias("piece"), "start_word", (F.col("size") - F.col("start_word")).alias("n_words"))
    tail = tail.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(shards)))  # text keys: pandas has no null integers
    out = "bin_id string, position long, bin_offset long"

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["n_words", "doc_id", "copy"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        source = pd.factorize(b["source"])[0]
        many = b["cluster"].map(b["cluster"].value_counts()) > 1  # a cluster met once can't conflict
        cluster = pd.factorize(b["cluster"].where(many))[0]
        b["bin"], b["position"], b["bin_offset"] = pack_shard(b["n_words"].to_numpy(), source, cluster, capacity)
        b["bin_id"] = ("s-" + b["shard"].astype(str) + "-" + b.pop("bin").astype(str)).astype(object)
        return b.drop(columns="shard")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tail.drop("shard").schema) + ", " + out
    packed = tail.groupBy("shard").applyInPandas(lambda b: run(b)[[x.split()[0] for x in schema.split(", ")]], schema)
    return whole.unionByName(packed.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in packed.columns)))
