"""SimHash near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, settled

SEED = 42
HALVES = 2
#: Members of a bucket that are compared directly; larger buckets take the whole-ball way.
DIRECT = 2048


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of UTF-8 `text`, A-Z lower-cased; 0 where there are no words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    k = min(words, len(tokens))
    n = len(tokens) - k + 1
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, step):
        low = starts[at : min(at + step, n)].tolist()
        high = (starts + sizes)[at + k - 1 : min(at + step, n) + k - 1].tolist()
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(low, high)), np.uint64, len(low))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row of `docs`; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"", words) for x in batch.column(1)]
            fps = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.record_batch([batch.column(0), fps], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From batches sorted by (bucket, fp): bucket, fp and run number arrays that hold whole buckets only."""
    rest: tuple = (np.empty(0, np.int64), np.empty(0, np.int64))
    for batch in batches:
        key, fp = (np.concatenate((r, c.to_numpy(zero_copy_only=False))) for r, c in zip(rest, batch.columns))
        whole = np.searchsorted(key, key[-1]) if len(key) else 0
        rest = key[whole:], fp[whole:]
        if whole:
            yield key[:whole], fp[:whole], np.concatenate(([0], np.flatnonzero(np.diff(key[:whole])) + 1, [whole]))
    if len(rest[0]):
        yield rest[0], rest[1], np.array([0, len(rest[0])])


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n positions over links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return label


def links(fps: DataFrame, radius: int = 4, halves: int = HALVES, direct: int = DIRECT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within `radius` bits.

    With halves=1 every fingerprint emits all variants within half the radius, 2,081 rows of 64 bits for a radius of 4.
    Fingerprints that meet in a variant are within the radius of one another, so each links with the smallest there.
    With halves=2 the same is done in each 32-bit half: of two fingerprints within the radius one half differs in half
    as many bits, so balls of a quarter of the radius meet there, 66 rows in place of 2,081. Those that meet are verified
    on all 64 bits. Buckets of more than `direct` members aren't compared pair by pair; their members go the first way. The balls are fixed to this: halves=1 takes an even radius, halves=2 one of 2 or 4.
    """
    if radius < 2 or radius % 2 or halves == 2 and radius > 4:
        raise ValueError(f"no balls for a radius of {radius} with halves={halves}")
    if halves == 1:
        flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (b == 63 and 1 << 64)).cast("long") for b in range(64)))
        ball = flips
        for _ in range(radius // 2 - 1):
            ball = F.array_distinct(F.flatten(F.transform(ball, lambda x: F.transform(flips, lambda y: x.bitwiseXOR(y)))))
        seen = fps.select(F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("bucket"), "fp")
        low = seen.groupBy("bucket").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
        return seen.join(low, "bucket").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()

    one = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(32)))

    def half(shift: int):
        part = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(shift)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        tag = F.lit(shift // 32 << 32).cast("long")
        return F.transform(one, lambda m: part.bitwiseXOR(m).bitwiseOR(tag))

    seen = fps.select(F.explode(F.concat(half(0), half(32))).alias("bucket"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set = set()
        for key, fp, ends in _runs(batches):
            sizes = np.diff(ends)
            pairs = ends[:-1][sizes == 2]
            near = pairs[np.bitwise_count(fp[pairs].view(np.uint64) ^ fp[pairs + 1].view(np.uint64)) <= radius]
            out: list[tuple[int, int, bool]] = list(zip(fp[near + 1].tolist(), fp[near].tolist(), [False] * len(near)))
            for run in np.flatnonzero(sizes > 2):
                at, to = ends[run], ends[run + 1]
                own = fp[at:to]
                if to - at > direct:
                    out += [(x, x, True) for x in own.tolist()]
                    continue
                bits = own.view(np.uint64)
                i, j = np.nonzero(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius, 1))
                if len(i):
                    root = local_components(len(own), i, j)
                    moved = np.flatnonzero(root != np.arange(len(own)))
                    out += zip(own[moved].tolist(), own[root[moved]].tolist(), [False] * len(moved))
            out = list(dict.fromkeys(x for x in out if x not in known))
            if len(known) < 1 << 18:
                known.update(out)
            if out:
                a, b, hot = zip(*out)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hot)], names=["a", "b", "hot"])

    found = settled(seen.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(compare, "a long, b long, hot boolean"))
    edges = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return edges
    return edges.union(links(settled(hot), radius, 1))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each row of `docs` (doc_id, text; other columns are ignored).

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Repeated rows give
    repeated rows. component_id is the smallest doc_id reachable; where all of a component's are null, it is null.
    """
    fps = settled(with_fingerprints(docs, words))
    least = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = connected_components(links(least.select("fp"), radius))
    # smallest doc_id of each component, then of each fingerprint
    joined = least.join(comps, least.fp == comps.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = settled(joined)
    lowest = settled(joined.groupBy("component").agg(F.min("least").alias("component_id")))  # a plain side of the join, which can then be split
    of_fp = joined.join(lowest, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
