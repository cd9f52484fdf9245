"""Near-dedup and nearest neighbours of embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, settled
from .simhash import local_components

#: Projections whose windows are counted, and the half-width of a window in standard deviations of a threshold pair's difference.
PROJECTIONS, WIDTH = 48, 2.0
#: The share of pairs at the very threshold that the candidate search may miss, about; likelier pairs are missed less.
MISSED = 1e-3
#: Projections that are counted for all pairs of a cell; only pairs with a calibrated count of these are counted in the others.
EARLY = 16
#: Vectors in a cell, about, and the most that one task compares at once; larger cells are split into pairs of parts.
CELL, PART = 512, 4096
#: Cells of over PART vectors are broadcast, up to so many; beyond it they are joined by a shuffle.
LARGE_CELLS = 10_000


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, not zero, and has neither null nor non-finite components."""
    v = vector.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (vec_id, v): members (vec_id, digest), and one row (digest, rep, copies, ids, v) for each distinct vector.

    rep is the smallest vec_id; the digest is two hashes, 96 bits. Copies of one vector fall together before anything else, however many there are.
    """
    rows = rows.select("vec_id", F.concat_ws("/", F.xxhash64("v").cast("string"), F.hash("v").cast("string")).alias("digest"), "v")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("digest", "v")).alias("x")).select("vec_id", "x.digest", "x.v")
    rows = settled(rows)
    reps = rows.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return rows.select("vec_id", "digest", "v"), reps


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of a column of equally long byte strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def count_needed(threshold: float, missed: float = MISSED, projections: int = PROJECTIONS) -> tuple[float, int]:
    """Half-width of the windows, and the number of collisions of `projections` that all but a tenth of `missed` of pairs at the threshold reach."""
    sd = math.sqrt(2 - 2 * threshold)
    p = math.erf(WIDTH / math.sqrt(2))
    tail, need = 0.0, 0
    for k in range(projections + 1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail > missed / 10:
            break
        need = k + 1
    return WIDTH * sd, need


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, missed: float = MISSED, seed: int = 11) -> DataFrame:
    """One row for each vec_id of `embeddings` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link whose cosine is `threshold` or more, computed in double precision. Candidates come from collision
    counting: every vector has PROJECTIONS one-dimensional Gaussian projections; two collide in one where each lies in the
    window centred at the other; pairs with at least the calibrated count are verified. One window lets a third of all
    pairs through, so windows are searched in cells: a table's cell holds the vectors on the same side of some further
    projections, sorted by the first projection. As many tables are searched as leave out only `missed` of pairs at the
    threshold, and a pair is counted in the first table in which both share a cell.

    Copies are taken together first. Vectors that aren't usable() link with nothing and are kept. Rows with a null vec_id
    are left out; of rows that share a vec_id the vector with the smallest digest counts. Vectors of different lengths
    share no cell and don't link.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null")
    members, reps = distinct_vectors(rows.where(usable(F.col("v"))))
    reps = settled(reps)
    n = reps.count()
    kind = "<f4" if "float" in embeddings.schema["embedding"].dataType.simpleString() else "<f8"
    bits = max(1, math.ceil(math.log2(max(n, 2) / CELL)))
    same = 1 - math.acos(threshold) / math.pi
    tables = math.ceil(math.log(missed) / math.log(1 - same**bits))
    half, need = count_needed(threshold, missed)
    early = count_needed(threshold, missed, EARLY)[1]
    step = half / 20
    reach = int(np.ceil(half / step)) + 1

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict = {}
        for b in batches:
            out = []
            sizes = b["v"].map(len)
            for size, own in b.groupby(sizes):
                if size not in made:
                    rng = np.random.default_rng(seed)
                    made[size] = rng.standard_normal((size, PROJECTIONS)), rng.standard_normal((size, tables * bits))
                v = np.stack(own["v"].to_numpy())
                x = _unit(v)
                flat = np.clip(np.rint(x @ made[size][0] / step), -32000, 32000).astype("<i2")
                sides = (x @ made[size][1] > 0).reshape(len(x), tables, bits)
                cells = (sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2) * 65536 + int(size)
                out.append(pd.DataFrame({"rep": own["rep"], "copies": own["copies"], "x": [r.tobytes() for r in v.astype(kind)], "flat": [r.tobytes() for r in flat], "cells": list(cells), "first": flat[:, 0]}))
            if out:
                yield pd.concat(out)

    coded = settled(reps.select("rep", "copies", "v").mapInPandas(code, "rep long, copies long, x binary, flat binary, cells array<long>, first int"))
    each = coded.select("rep", F.posexplode("cells").alias("t", "cell"))
    large = settled(each.groupBy("t", "cell").agg(F.count("*").alias("size")).where(F.col("size") > PART))
    large = F.broadcast(large) if large.count() <= LARGE_CELLS else large
    parts = F.ceil(F.coalesce("size", F.lit(1)) / PART).cast("int")
    placed = coded.select("*", F.posexplode("cells").alias("t", "cell")).join(large, ["t", "cell"], "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    others = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    placed = placed.select("t", "cell", F.explode(others).alias("ij"), "part", "first", "rep", "copies", "x", "flat", F.slice("cells", F.lit(1), F.col("t")).alias("cells"))
    placed = placed.select("t", "cell", "ij.i", "ij.j", "part", "first", "rep", "copies", "x", "flat", "cells")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in _whole_runs(batches, 4):
            out = [r for a, b in zip(ends[:-1], ends[1:]) if b - a > 1 for r in pairs(rows.slice(a, b - a))]
            if out:
                yield pa.record_batch([pa.array(np.concatenate([r[k] for r in out]), pa.int64()) for k in range(3)], names=["rep", "links", "root"])

    def pairs(run: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        t, i, j = (run.column(c)[0].as_py() for c in ("t", "i", "j"))
        part, first, rep, copies = (run.column(c).to_numpy() for c in ("part", "first", "rep", "copies"))
        x, flat = _unit(_matrix(run.column("x"), kind)), _matrix(run.column("flat"), "<i2")
        columns = np.ascontiguousarray(flat[:, :EARLY].T)
        cells = np.array(run.column("cells").combine_chunks().flatten()).reshape(len(rep), t) if t else None
        n = len(rep)
        links, left, right = np.zeros(n, np.int64), [], []
        upto = np.searchsorted(first, first + reach, side="right")
        for at in range(0, n, 256):
            to = min(at + 256, n)
            high = int(upto[to - 1])
            count = np.zeros((to - at, high - at), np.int8)
            for c in columns:
                count += np.abs(c[at:to, None] - c[None, at:high]) <= reach
            near = (count >= early) & (np.arange(at, high)[None, :] > np.arange(at, to)[:, None])
            if i != j:
                near &= part[at:to, None] != part[None, at:high]
            every_p, every_q = np.nonzero(near)
            for some in range(0, len(every_p), 1 << 17):
                p, q = every_p[some : some + (1 << 17)], every_q[some : some + (1 << 17)]
                seen = count[p, q].astype(np.int16)
                p, q = p + at, q + at
                seen += (np.abs(flat[p, EARLY:] - flat[q, EARLY:]) <= reach).sum(axis=1, dtype=np.int16)
                good = seen >= need
                if t:
                    good &= (cells[p] != cells[q]).all(axis=1)  # in no earlier table's cell
                p, q = p[good], q[good]
                good = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[good], q[good]
                links += np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
                root = local_components(n, p, q)  # of a block's pairs only what connects is kept
                moved = np.flatnonzero(root != np.arange(n))
                left.append(moved), right.append(root[moved])
        if any(map(len, left)):
            p, q = np.concatenate(left), np.concatenate(right)
            order = np.argsort(rep, kind="stable")  # so that the smallest position has the smallest rep
            where = np.empty(n, np.int64)
            where[order] = np.arange(n)
            root = rep[order][local_components(n, where[p], where[q])[where]]
            some = np.flatnonzero(links)
            yield rep[some], links[some], root[some]

    keys = ["t", "cell", "i", "j"]
    found = placed.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(compare, "rep long, links long, root long")
    found = settled(found.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    comps = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = reps.select("digest", "rep", "copies").join(links, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = members.select("vec_id", "digest").join(of_rep, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.select("vec_id").distinct().join(members.select("vec_id"), "vec_id", "left_anti")
    every = linked.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return every.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal first `keys` columns, with the runs' ends, from batches sorted by them."""
    rest: list[pa.RecordBatch] = []

    def ends(table: pa.Table) -> np.ndarray:
        cols = [table.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(max(table.num_rows - 1, 0), bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1, [table.num_rows]))

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        same = all(batch.column(k)[0].as_py() == batch.column(k)[batch.num_rows - 1].as_py() == rest[0].column(k)[0].as_py() for k in range(keys))
        if same:
            continue
        table = pa.Table.from_batches(rest)
        cut = ends(table)
        yield table.slice(0, cut[-2]).combine_chunks(), cut[:-1]
        rest = table.slice(cut[-2]).to_batches()
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, ends(table)


#: Least bits of a code, and standard deviations of an estimate's error that its bounds allow for.
CODE_BITS, BOUND = 256, 2.5
#: Vectors that the index is fitted on, at most (those of the smallest hashes), and bytes of them; cells, at most; vectors in a part of a cell and queries in a block, about.
FIT_VECTORS, FIT_BYTES, CELLS, BLOCK, QUERY_BLOCK = 16_384, 32 << 20, 1024, 4096, 4096
#: Cells in which a query's first neighbours are looked for.
FIRST = 4


def rotation(size: int, seed: int) -> np.ndarray:
    """A random rotation of vectors that are padded to a multiple of 64 components, CODE_BITS at least."""
    wide = -(-max(size, CODE_BITS) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:, :size].T


def encoded(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-bit codes of vectors, packed, and the inner product of each one's direction with its code."""
    o = _unit(v) @ turn
    return np.packbits(o > 0, axis=1, bitorder="little"), np.abs(o).sum(axis=1) / math.sqrt(o.shape[1])


def estimates(bits: np.ndarray, ip: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit vectors (a row for each query), and the error of each vector's estimates.

    bits: the vectors' packed codes; ip: each vector's inner product with its own code; turned: rotated unit queries. The
    codes' signs meet all queries in one product of matrices.
    """
    wide = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=wide, bitorder="little").astype(np.float32) * 2 - 1
    about = (turned.astype(np.float32) @ signs.T) / (ip * math.sqrt(wide)).astype(np.float32)
    return about, BOUND * np.sqrt(np.maximum(1 - ip**2, 0) / max(wide - 1, 1)) / ip


@dataclass
class Cells:
    """An index of unit vectors of one length: centroids, the least and largest cosine of members with theirs, their largest norm, and how far products stray."""

    centroids: np.ndarray
    least: np.ndarray
    most: np.ndarray
    norm: np.ndarray
    stray: float

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """What members of each cell may score with unit queries, at most, but for rare ones: a row for each query.

        A member of cosine a with its centroid has a * (q . c) and a part across, sqrt(1 - a^2) * sqrt(1 - (q . c)^2)
        times the cosine of the two rests, for which `stray` stands.
        """
        qc = np.clip(unit @ self.centroids.T, -1, 1)
        across = self.stray * np.sqrt(1 - qc**2)
        sides = [a * qc + across * np.sqrt(np.maximum(1 - a**2, 0)) for a in (self.least, self.most)]
        best = np.arctan2(across, qc)  # where the sum is largest
        inside = (np.cos(best) >= self.least) & (np.cos(best) <= self.most)
        return np.where(inside, np.hypot(qc, across), np.maximum(*sides)) * self.norm


def fitted(sample: np.ndarray, cells: int, k: int, seed: int) -> tuple[np.ndarray, float]:
    """Centroids of unit vectors by a few rounds of spherical k-means, and the largest cosine of rests that neighbours in the sample show."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(6):
        own = (sample @ c.T).argmax(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, own, sample)
        long = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(long > 1e-9, new / np.maximum(long, 1e-9), c)
    asked = sample[rng.permutation(len(sample))[:256]]
    score = asked @ sample.T
    near = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, : k + 1]
    own = c[(sample @ c.T).argmax(axis=1)]
    a, qc = np.einsum("ij,ij->i", sample, own)[near], np.einsum("qd,qkd->qk", asked, own[near])
    rest = (np.take_along_axis(score, near, 1) - a * qc) / np.maximum(np.sqrt(np.maximum((1 - a**2) * (1 - qc**2), 0)), 1e-9)
    wide = (np.sqrt((1 - a**2) * (1 - np.minimum(qc**2, 1))) > 0.05) if rest.size else np.zeros(0, bool)
    return c, min(1.0, 1.1 * float(rest[wide].max(initial=0.0))) if wide.any() else 1.0


def nearest(embeddings: DataFrame, queries: Column, k: int = 20, seed: int = 5) -> DataFrame:
    """The `k` rows of largest inner product with each row for which `queries` holds: query_id, rank, vec_id, score.

    Every distinct vector has a randomly rotated one-bit code, its norm, the inner product with its code, and a cell, that
    of its nearest centroid. Centroids are fitted on FIT_VECTORS vectors at most; every vector is assigned. A query
    searches the FIRST cells of the largest bounds, then all cells whose bound reaches its k-th score. Within a cell inner
    products are estimated from the bits; vectors whose estimate and error reach the k-th score are computed exactly, in
    double precision. Ties go to the smaller vec_id. Vectors go to their cell once for a block of queries, cells of over
    BLOCK vectors are split by hash, and only k rows of a query leave a part of a cell.

    Copies of a vector are estimated once and stand with their k + 1 smallest ids, which is all that a list of k can take.
    Rows with a null vec_id or a vector that isn't usable() take no part. Of rows that share a vec_id the vector with the
    smallest digest counts. Vectors of another length than the query's aren't its candidates.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null")
    members, reps = distinct_vectors(rows.where(usable(F.col("v"))))
    order = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    ids = members.select("vec_id", "digest", order.alias("n")).where(F.col("n") <= k + 1).groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    ask = settled(members.where(queries).select(F.col("vec_id").alias("query_id"), "v"))
    reps = settled(reps.select("digest", "v").join(ids, "digest").select("digest", "ids", F.size("v").alias("size"), "v"))
    sizes = reps.groupBy("size").agg(F.count("*").alias("n")).collect()  # one row for each length of vectors
    query_blocks = max(1, math.ceil(ask.count() / QUERY_BLOCK))
    made: dict[int, tuple[np.ndarray, float]] = {}
    for size, n in sizes:
        few = reps.where(F.col("size") == size).orderBy(F.xxhash64("digest"), "digest").limit(max(1, min(FIT_VECTORS, FIT_BYTES // (8 * size)))).select("v").toPandas()["v"]
        made[size] = fitted(_unit(np.stack(few.to_numpy())), min(CELLS, max(1, round(n / BLOCK))), k, seed)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict = {}
        for b in batches:
            for size, own in b.groupby("size"):
                if size not in turns:
                    turns[size] = rotation(size, seed)
                v = np.stack(own["v"].to_numpy())
                unit = _unit(v)
                by = unit @ made[size][0].T
                bits, ip = encoded(v, turns[size])
                yield pd.DataFrame({"digest": own["digest"], "ids": own["ids"], "size": size, "cell": by.argmax(axis=1), "with_own": by.max(axis=1), "norm": np.linalg.norm(v, axis=1), "v": [r.tobytes() for r in v], "bits": [r.tobytes() for r in bits], "ip": ip})

    coded = settled(reps.mapInPandas(code, "digest string, ids array<long>, size int, cell int, with_own double, norm double, v binary, bits binary, ip double"))
    cells = coded.groupBy("size", "cell").agg(F.min("with_own"), F.max("with_own"), F.max("norm"), F.ceil(F.count("*") / F.lit(BLOCK)).cast("int")).collect()  # at most CELLS for each length
    index, parts = {}, {}
    for size, _ in sizes:
        own = sorted(r[1:] for r in cells if r[0] == size)
        at = [r[0] for r in own]
        least, most, norm = (np.array([r[f] for r in own]) for f in (1, 2, 3))
        index[size] = np.array(at), Cells(made[size][0][at], np.clip(least, -1, 1), np.clip(most, -1, 1), norm, made[size][1])
        parts[size] = np.array([r[4] for r in own])

    def probes(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for size, own in b.groupby(b["v"].map(len)):
                    if size not in index:
                        continue
                    at, of = index[size]
                    v = np.stack(own["v"].to_numpy())
                    bound = of.bounds(_unit(v)) * np.linalg.norm(v, axis=1)[:, None]
                    order = np.argsort(-bound, axis=1, kind="stable")
                    known = own["known"].to_numpy(np.float64)
                    q, c = [], []
                    for r in range(len(v)):
                        some = order[r, :FIRST] if first else order[r, FIRST:][bound[r, order[r, FIRST:]] >= known[r]]
                        spread = np.repeat(some, parts[size][some])
                        c += [(int(at[x]), p) for x, p in zip(spread, (p for x in some for p in range(parts[size][x])))]
                        q += [r] * len(spread)
                    yield pd.DataFrame({"query_id": own["query_id"].to_numpy()[q], "known": known[q], "v": [v[r].tobytes() for r in q], "size": int(size), "cell": [x[0] for x in c], "part": [x[1] for x in c]}).astype({"size": "int32", "cell": "int32", "part": "int32"})

        return run

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(c):
            size = int(q["size"].iloc[0])
            x, asked = (np.frombuffer(b"".join(d["v"]), "<f8").reshape(-1, size) for d in (c, q))
            bits, ip = np.frombuffer(b"".join(c["bits"]), np.uint8).reshape(len(c), -1), c["ip"].to_numpy()
            long, turn, ids, of, known = c["norm"].to_numpy(), rotation(size, seed), c["ids"].to_numpy(), q["query_id"].to_numpy(), q["known"].to_numpy()
            most = min(k + 1, len(x))
            for at in range(0, len(asked), 256):
                own = asked[at : at + 256]
                about, error = estimates(bits, ip, _unit(own) @ turn)
                about, error = about * long.astype(np.float32), (error * long).astype(np.float32)
                scale = np.linalg.norm(own, axis=1)
                sure = np.argpartition(-about, most - 1, axis=1)[:, :most]
                for r, query in enumerate(own):
                    # of the best estimates the worst true score, or what earlier cells gave, is what others have to reach
                    reach = max(float((x[sure[r]] @ query).min()) if len(x) > k else -math.inf, known[at + r])
                    near = np.flatnonzero(about[r] + error >= np.float32(reach / scale[r] * (1 - 1e-6) - 1e-6))
                    rough = x[near] @ query
                    best = near[near_first(rough, k + 1)]
                    score = np.cumsum(x[best] * query, axis=1)[:, -1]  # summed in order, as anyone would
                    rows = sorted((-s, int(i)) for s, b in zip(score, best) for i in ids[b] if i != of[at + r])[:k]
                    out["query_id"] += [of[at + r]] * len(rows)
                    out["vec_id"] += [i for _, i in rows]
                    out["score"] += [-s for s, _ in rows]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    split = F.pmod(F.xxhash64("digest"), F.element_at(F.create_map(*(F.lit(x) for r in cells for x in (r[0] * 65536 + r[1], r[5]))), F.col("size") * 65536 + F.col("cell"))).cast("int") if cells else F.lit(0)
    blocks = coded.select("ids", "norm", "v", "bits", "ip", "size", "cell", split.alias("part")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def searched(first: bool, asked: DataFrame) -> DataFrame:
        q = asked.mapInPandas(probes(first), "query_id long, known double, v binary, size int, cell int, part int")
        q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
        keys = ["size", "cell", "part", "qb"]
        found = q.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    near = settled(searched(True, ask.withColumn("known", F.lit(-math.inf))))
    if any(len(at) > FIRST for at, _ in index.values()):
        known = near.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("known"))
        asked = ask.join(known, F.col("query_id") == F.col("of"), "left").select("query_id", "v", F.coalesce("known", F.lit(-math.inf)).alias("known"))
        near = near.unionByName(searched(False, asked)).withColumn("rank", rank).where(F.col("rank") <= k)
    return near.select("query_id", "rank", "vec_id", "score")


def near_first(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores and of all that equal the k-th, but for rounding."""
    if len(score) <= k:
        return np.arange(len(score))
    least = np.partition(score, len(score) - k)[len(score) - k]
    return np.flatnonzero(score >= least - 1e-12 * (1 + abs(least)))
