"""Line dedup: sharded minimal perfect hashes over the distinct lines of a corpus, which documents probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, unused

#: Distinct lines of a shard, about; documents of a block, about; probes of a shard that one task takes, about.
SHARD, BLOCK, PROBES = 200_000, 128, 500_000
#: Bits of a level for each line that it is to place, levels at most; lines that none of them places are listed.
BITS, LEVELS = 2, 24
#: The white space that is stripped from a line's ends.
BLANK = b" \t\n\v\f\r"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(key: np.ndarray, level: int, size: int) -> np.ndarray:
    return (_mixed(key + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def _prints(hi: np.ndarray) -> np.ndarray:
    return (_mixed(hi) >> np.uint64(32)).astype(np.uint32)


class LineIndex:
    """Counts of a shard's lines by their 128-bit digests (hi, lo), without the digests.

    Levels of bits: a line that is alone in its slot of a level has the slot's bit, the others go on to the next level. The
    number of bits set before a line's bit is its place, from 0 to n - 1, in the arrays of fingerprints (32 bits) and of
    counts (as few bytes each as the largest takes). Lines that no level places, if any, are listed with their digests.
    """

    def __init__(self, sizes: list[int], bits: bytes, prints: bytes, counts: bytes, width: int, rest: bytes):
        self.sizes = sizes
        self.bits = np.frombuffer(bits, np.uint8)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)))
        self.prints = np.frombuffer(prints, np.uint32)
        self.counts = np.frombuffer(counts, f"u{width}")
        left = np.frombuffer(rest, np.uint64).reshape(-1, 3)
        self.rest = {(a, b): n for a, b, n in left.tolist()}

    @staticmethod
    def parts(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple:
        """What __init__ takes, of distinct digests and their counts."""
        places, sizes, levels, base = [], [], [], 0
        at = np.arange(len(lo))
        while len(at) and len(sizes) < LEVELS:
            size = -(-max(64, BITS * len(at)) // 8) * 8
            slot = _slots(lo[at], len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            own = alone[slot]
            places.append((at[own], base + slot[own]))
            at, base = at[~own], base + size
            sizes.append(size)
        who = np.concatenate([x[0] for x in places]) if places else at
        order = who[np.argsort(np.concatenate([x[1] for x in places]))] if places else at
        width = next(w for w in (1, 2, 4, 8) if int(n.max(initial=0)) < 1 << 8 * w)
        rest = np.stack([hi[at], lo[at], n[at].astype(np.uint64)], axis=1) if len(at) else np.empty(0, np.uint64)
        bits = np.concatenate(levels).tobytes() if levels else b""
        return sizes, bits, _prints(hi[order]).tobytes(), n[order].astype(f"u{width}").tobytes(), width, rest.tobytes()

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The counts of lines; 0 for a line that isn't in the shard, but for one in four billion such lines."""
        out = np.zeros(len(lo), np.int64)
        open_, base = np.arange(len(lo)), 0
        for level, size in enumerate(self.sizes):
            slot = base + _slots(lo[open_], level, size)
            byte, bit = slot >> 3, (slot & 7).astype(np.uint8)
            own = (self.bits[byte] >> bit) & 1 == 1
            at, byte, bit = open_[own], byte[own], bit[own]
            place = self.before[byte] + np.bitwise_count(self.bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[at] = np.where(self.prints[place] == _prints(hi[at]), self.counts[place].astype(np.int64), 0)
            open_, base = open_[~own], base + size
        for k in open_ if self.rest else ():
            out[k] = self.rest.get((int(hi[k]), int(lo[k])), 0)
        return out


def digest(line: bytes) -> bytes | None:
    """Of a line's key: the line without white space at its ends, A-Z lower-cased; None if that is empty."""
    key = line.strip(BLANK).lower()
    return xxhash.xxh3_128_digest(key) if key else None


def _long_enough(line: bytes, min_chars: int) -> bool:
    return min_chars <= 1 or len(line.strip(BLANK).decode("utf-8", "replace")) >= min_chars


def blocked(docs: DataFrame, blocks: int, name: str) -> DataFrame:
    """`docs` with the number of a block of documents, by id and text, in column `name`."""
    return docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))


def line_keys(docs: DataFrame, block: str, min_chars: int = 1) -> DataFrame:
    """(block, hi, lo, n): the digests of a block's lines with the number of its documents that have the line; a block may have several such rows of a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {digest(x) for x in (text.as_py() or b"").split(b"\n") if _long_enough(x, min_chars)} - {None}
                of.extend([b] * len(own))
                found.extend(own)
            keys = np.frombuffer(b"".join(found), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(of, pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], names=["block", "hi", "lo"])

    rows = docs.select(F.col(block), F.col("text").cast("binary")).mapInArrow(run, "block long, hi long, lo long")
    return rows.groupBy("block", "hi", "lo").agg(F.count("*").alias("n"))


def line_index(keys: DataFrame) -> DataFrame:
    """(shard, shards, probes, n, and the parts of a LineIndex) of each shard of the lines in `keys` (block, hi, lo, n); probes is the number of the shard's rows in `keys`."""
    counts = settled(keys.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.count("*").alias("rows")))
    shards = max(1, -(-counts.count() // SHARD))
    schema = "shard long, shards long, probes long, n long, sizes array<int>, bits binary, prints binary, counts binary, width int, rest binary"

    def build(table: pa.Table) -> pa.Table:
        hi, lo, n, rows = (table.column(c).to_numpy() for c in ("hi", "lo", "n", "rows"))
        sizes, bits, prints, counts, width, rest = LineIndex.parts(hi.view(np.uint64), lo.view(np.uint64), n)
        values = {"shard": table.column("shard")[0].as_py(), "shards": shards, "probes": int(rows.sum()), "n": len(n), "sizes": sizes, "bits": bits, "prints": prints, "counts": counts, "width": width, "rest": rest}
        kinds = {"sizes": pa.list_(pa.int32()), "width": pa.int32()} | dict.fromkeys(("bits", "prints", "counts", "rest"), pa.binary())
        return pa.table({k: pa.array([v], kinds.get(k, pa.int64())) for k, v in values.items()})

    return settled(counts.withColumn("shard", F.pmod("hi", F.lit(shards))).groupBy("shard").applyInArrow(build, schema))


def frequent(keys: DataFrame, index: DataFrame, at_least: int) -> DataFrame:
    """(block, hot): for every block of `keys` (block, hi, lo) with such lines, the digests of those that `index` counts `at_least` times or more, one behind the other.

    The lines of a shard go to its arrays; where there are many, in parts, each with a copy of the arrays. A line that all
    documents have comes once for each block, not once for each document.
    """
    shards = (index.agg(F.max("shards")).first()[0]) or 1
    parts = index.select("shard", F.ceil(F.col("probes") / F.lit(PROBES)).cast("int").alias("parts"))
    probes = keys.withColumn("shard", F.pmod("hi", F.lit(shards))).join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("block", "hi"), F.col("parts")).cast("int"))
    arrays = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = ("sizes", "bits", "prints", "counts", "width", "rest")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "key": pa.array([], pa.string())})
        hi, lo = (left.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        hot = np.flatnonzero(LineIndex(*(right.column(c)[0].as_py() for c in names)).probe(hi, lo) >= at_least)
        key = np.stack([hi[hot], lo[hot]], axis=1).astype(">u8").tobytes()
        return pa.table({"block": left.column("block").take(pa.array(hot)), "key": pa.array([key[k : k + 16].hex() for k in range(0, len(key), 16)], pa.string())})

    left = probes.select("shard", "part", "block", "hi", "lo").groupBy("shard", "part")
    hits = left.cogroup(arrays.select("shard", "part", *names).groupBy("shard", "part")).applyInArrow(probe, "block long, key string")
    return hits.groupBy("block").agg(F.unhex(F.array_join(F.array_sort(F.collect_list("key")), "")).alias("hot"))


def without_frequent_lines(docs: DataFrame, at_least: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` (doc_id, text) without the lines that stand in `at_least` documents or more, and with n_lines (before) and n_dropped.

    A text is cut at \\n; what is left is joined by \\n, so texts that lose nothing stay as they are, and those that lose all
    are empty. Lines count as the same if they differ only in A-Z and in white space (ASCII) at their ends; those of under
    `min_chars` code points without these stay. A document counts once for each of its lines, every row as a document of
    its own. Null texts stay null and have one empty line, as empty ones have. Columns n_lines and n_dropped of `docs`, if
    any, are replaced; all others go along. Rows are told from one another nowhere, so repeated rows lose the same lines.
    """
    block, hot = unused(docs, "block", "hot")
    docs = docs.drop("n_lines", "n_dropped")
    blocks = max(1, -(-docs.count() // BLOCK))
    rows = blocked(docs, blocks, block)
    keys = settled(line_keys(rows, block, min_chars))
    found = settled(frequent(keys, line_index(keys), at_least)).select(F.col("block").alias(block), F.col("hot").alias(hot))
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "text binary, n_lines long, n_dropped long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, drop = b"", frozenset()
        for batch in batches:
            texts, total, lost = [], [], []
            for text, own in zip(batch.column(len(names)), batch.column(len(names) + 1)):
                text, own = text.as_py(), own.as_py() or b""
                lines = (text or b"").split(b"\n")
                if own:
                    if own != known:
                        known, drop = own, frozenset(own[k : k + 16] for k in range(0, len(own), 16))
                    kept = [x for x in lines if digest(x) not in drop or not _long_enough(x, min_chars)]
                else:
                    kept = lines
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept))
                total.append(len(lines))
                lost.append(len(lines) - len(kept))
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(texts, pa.binary()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*names, "text", "n_lines", "n_dropped"])

    held = rows.join(found, block, "left").select(*names, F.col("text").cast("binary").alias("text"), hot)
    out = held.mapInArrow(run, schema).withColumn("text", F.col("text").cast("string"))
    return out.select(*docs.columns, "n_lines", "n_dropped")
