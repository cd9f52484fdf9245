"""Near-duplicates by the Jaccard similarity of word shingles: balls of SimHash fingerprints give candidates, MinHash bands those that lie farther apart, exact sets settle them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, settled, text_key, unused

#: Words of a shingle; least similarity of two sets, as a fraction, so that it is compared in whole numbers.
WORDS, SIMILAR = 5, (4, 5)
#: Bits by which the SimHash fingerprints of candidates differ at most. Many pairs at the similarity differ in more; bands find these.
RADIUS = 4
#: Bands of so many minima each: of pairs at the similarity one in 150,000 shares no band, (1 - 0.8 ** 5) ** 30.
BANDS, MINIMA = 30, 5
#: Bits of a set's parities. Where two sets' bits differ, the sets differ, so they bound the similarity and lose no pair; sets of well over BITS shingles pass unhindered.
BITS = 1024
#: Orders of nodes by which the bands choose the member that leads a bucket.
LEADS = 3
#: Members of a part of a bucket: parts are compared two at a time.
PART = 256
#: Shingles whose minima are taken at once.
STEP = 2048

_rng = np.random.default_rng(5)
_TIMES = _rng.integers(0, 1 << 31, BANDS * MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, BANDS * MINIMA, np.uint32)
_BAND = _rng.integers(0, 1 << 63, (BANDS, MINIMA + 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 `text`, A-Z lower-cased; a shorter text is one shingle, none without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(tokens))
    n = len(own) - k + 1
    total = np.full(n, k, np.uint64)
    for at in range(k):
        total += own[at : at + n] * _PLACE[at]
    return np.unique(_mixed(total))


def minima(of: np.ndarray) -> np.ndarray:
    """BANDS * MINIMA smallest values of the set under as many hashes."""
    low = np.full(len(_TIMES), 0xFFFFFFFF, np.uint32)
    short = (of >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), STEP):
        low = np.minimum(low, (short[at : at + STEP, None] * _TIMES + _PLUS).min(axis=0))
    return low


def fingerprint(of: np.ndarray) -> int:
    """64-bit SimHash of the set, as a signed number: a bit is 1 if set in over half the values; 0 of an empty set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(of), STEP):
        counts += np.unpackbits(of[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(of), bitorder="little").view("<i8")[0])


def parities(of: np.ndarray) -> bytes:
    """BITS bits, each whether an odd number of the set's values fall to it."""
    return np.packbits(np.bincount((of & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).tobytes()


def possible(n: np.ndarray, bits: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """False where sets of `n` and of `m` values cannot be similar, by their sizes and their parities (rows of 64-bit words)."""
    part, whole = SIMILAR
    apart = np.bitwise_count(bits ^ others).sum(axis=1, dtype=np.int64)  # so many values or more are in one of the two only
    return (whole * np.minimum(n, m) >= part * np.maximum(n, m)) & ((whole - part) * (n + m) >= (whole + part) * apart)


def _words(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64)


def _identity(of: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(of.tobytes()) - (1 << 63)


def with_bands(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, fp, bands, n, bits) of every row of `docs`: node stands for the set, equal sets have one; fp is its fingerprint, n its size, bits are its parities; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, bands, sizes, bits = [], [], [], [], []
            for x in batch.column(2):
                own = shingles(x.as_py() or b"")
                low = minima(own)
                nodes.append(_identity(own))
                fps.append(fingerprint(own))
                keys = (low.astype(np.uint64).reshape(BANDS, MINIMA) * _BAND[:, :-1]).sum(axis=1, dtype=np.uint64) + _BAND[:, -1]
                bands.append(_mixed(keys).view(np.int64))
                sizes.append(len(own))
                bits.append(parities(own))
            bands = pa.ListArray.from_arrays(np.arange(0, BANDS * len(nodes) + 1, BANDS, dtype=np.int32), np.concatenate(bands) if bands else np.empty(0, np.int64))
            yield pa.record_batch([*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), bands, pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "text_key", "node", "fp", "bands", "n", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, text_key long, node long, fp long, bands array<long>, n long, bits binary")


def with_sets(docs: DataFrame) -> DataFrame:
    """(node, own) of every row of `docs`: the bytes of its sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py() or b"") for x in batch.column(0)]
            yield pa.record_batch([pa.array([_identity(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "node long, own binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is SIMILAR or more."""
    part, whole = SIMILAR
    if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    both = int(np.count_nonzero(both[1:] == both[:-1]))
    return whole * both >= part * (len(x) + len(y) - both)


def sets_of(nodes: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, own) of `nodes` (node), made anew from the texts of `docs`; `ids` has a doc_id (least) of each node."""
    some = ids.join(nodes, "node", "left_semi").select(F.col("least").alias("__id")).distinct()
    own = with_sets(docs.select("doc_id", "text").join(some, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi"))
    return settled(own.groupBy("node").agg(F.first("own").alias("own")))


def alike(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) of nodes that may be similar by their sizes and parities, so that few sets are made and sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (c.to_pylist() for c in batch.columns[2:])
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(possible(np.array(n, np.int64), _words(x), np.array(m, np.int64), _words(y))))

    left = ids.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
    right = ids.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) of nodes whose sets in `own` (node, own) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = own.select(F.col("node").alias("a"), F.col("own").alias("x"))
    right = own.select(F.col("node").alias("b"), F.col("own").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def close(ids: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of `ids` (node, fp) that join all whose fingerprints are within RADIUS bits, by balls of fingerprints."""
    first = settled(ids.groupBy("fp").agg(F.min("node").alias("first")))
    same = ids.select("node", "fp").join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = simhash.links(first.select("fp"), RADIUS).withColumnsRenamed({"a": "x", "b": "y"})
    left, right = (first.select(F.col("fp").alias(x), F.col("first").alias(c)) for x, c in (("x", "a"), ("y", "b")))
    return same.union(links.join(left, "x").join(right, "y").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def compared(left: DataFrame) -> DataFrame:
    """Edges (a, b) that join different components with similar members, from `left` (bucket, node, component, n, bits, own, parts).

    Members of a bucket are dealt over `parts`, and every two parts, or a part with itself, are compared by themselves.
    Pairs that may be similar by their sizes and parities are compared exactly, unless edges of the same two parts have joined them by then.
    """
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j")))
    dealt = left.withColumn("mine", mine).withColumn("p", F.explode(pairs))
    cells = dealt.select(F.xxhash64("bucket", "p.i", "p.j").alias("cell"), "node", "component", "n", "bits", "own", F.when(F.col("p.i") == F.col("p.j"), 0).when(F.col("mine") == F.col("p.i"), 1).otherwise(2).alias("side"))

    def cell(held: list) -> list[tuple[int, int]]:
        node, comp, n, bits, own, side = zip(*held)
        comp, n, bits, side = np.array(comp), np.array(n), _words(bits), np.array(side)
        sets = [np.frombuffer(x, np.uint64) for x in own]
        place = np.arange(len(node))
        edges = []
        for i in np.flatnonzero(side < 2):
            others = np.flatnonzero((comp != comp[i]) & np.where(side == 0, place > i, side == 2))
            for j in others[possible(n[others], bits[others], n[i], bits[i])]:
                if comp[j] != comp[i] and similar(sets[i], sets[j]):
                    edges.append((max(node[i], node[j]), min(node[i], node[j])))
                    comp[comp == comp[j]] = comp[i]
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None

        def out() -> Iterator[pa.RecordBatch]:
            if edges := cell(held):
                a, b = zip(*edges)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and key != at:
                    yield from out()
                    held.clear()
                at = key
                held.append(row)
        if held:
            yield from out()

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row (doc_id, text_key, node, component, component_id) for each row of `docs` (doc_id, text; other columns are ignored).

    Texts are linked where the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Null and empty
    texts, and texts of white space, have one empty set and link like any other. Repeated rows give repeated rows.
    component_id is the smallest doc_id reachable; where all of a component's are null, it is null. component tells
    components apart even so.

    Sets are candidates whose SimHash fingerprints meet in a ball, and sets that share a band of minima. The exact sets
    settle every candidate that is not joined otherwise, unless sizes or parities prove that it is not similar. First
    fingerprints' balls are taken, and each set is held against one member of its bucket, another in each band,
    which joins large groups without their pairs. Then members of a bucket that are still in different components are
    compared with one another, in the same task, so that no list of pairs is made.
    """
    rows = settled(with_bands(docs))
    ids = settled(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    seen = ids.select("node", F.posexplode("bands").alias("band", "bucket"))
    order = F.xxhash64(F.pmod("band", F.lit(LEADS)), "node")  # so that members of a large group meet few leads
    lead = seen.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "node")).alias("low"), F.count("*").alias("n")).where("n > 1")
    seen = seen.drop("band")
    shared = settled(seen.join(lead.select("bucket", F.col("low.node").alias("lead")), "bucket"))

    stars = shared.where("node <> lead").select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b"))
    some = settled(alike(stars.union(close(ids)).distinct(), ids))
    own = sets_of(shared.select("node").union(some.select(F.explode(F.array("a", "b")))).distinct(), docs, ids)  # once, as this sends the texts
    near = settled(verified(some, own))
    comps = settled(connected_components(near))

    apart = shared.join(comps, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = settled(apart.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high"))
    left = settled(apart.join(mixed.select("bucket", F.ceil(F.col("n") / F.lit(PART)).cast("int").alias("parts")), "bucket"))
    near = near.union(settled(compared(left.join(own, "node").join(ids.select("node", "n", "bits"), "node"))))

    comps = settled(connected_components(near))
    joined = settled(ids.join(comps, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    lowest = settled(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    of_node = joined.join(lowest, "component").select("node", "component", "component_id")
    return rows.select("doc_id", "text_key", "node").join(of_node, "node").select("doc_id", "text_key", "node", "component", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of near_duplicates(): the smallest doc_id (null last), of equal ids the smallest text_key; of rows alike in both the first by its other columns."""
    rows = settled(near_duplicates(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    kept = rows.groupBy("component").agg(F.min(place).alias("kept")).select("kept.id", "kept.key").distinct()
    at, key, n = unused(docs, "id", "key", "n")
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  an ordinary key also for null
    kept = kept.select(tag("id").alias(at), F.col("key").alias(key))
    chosen = docs.withColumns({at: tag("doc_id"), key: text_key(F.col("text"))}).join(kept, [at, key], "left_semi")
    order = F.row_number().over(Window.partitionBy(at, key).orderBy(*([c for c in docs.columns if c not in ("doc_id", "text")] or [key])))
    return chosen.withColumn(n, order).where(F.col(n) == 1).select(*docs.columns)
