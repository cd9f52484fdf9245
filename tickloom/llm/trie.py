"""Prefix tries of conversations as balanced parentheses: one for each shard of sorted conversations, merged along the spines that shards share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Turns of a range of sorted conversations and of a shard within it, about; shards whose spines one task merges.
RANGE, SHARD, FAN = 400_000, 100_000, 64
#: Bytes of a turn's digest and of a node's key.
WIDTH = 16
#: conv_ids of one piece of the list of conversations that end at a node.
PIECE = 4096
#: Parentheses of a block of the excess.
BLOCK = 64
_FAR = np.iinfo(np.int64).max


class Parens:
    """A trie's shape by the depths of its nodes in preorder: `(` where a node begins, `)` where its subtree ends.

    The excess (open less closed so far) has a minimum for each block and a tree of minima above, by which close() finds
    the parenthesis that ends a subtree; a subtree is then a range of preorder, so its sums are differences of cumulative arrays.
    """

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        closed = np.concatenate(([0], depth[:-1] - depth[1:] + 1))
        self.opens = np.arange(n) + np.cumsum(closed)
        bits = np.zeros(2 * n, bool)
        bits[self.opens] = True
        self.pairs = np.concatenate(([0], np.cumsum(bits[:-1] & ~bits[1:], dtype=np.int64), [0]))  # leaf pairs that begin before a place
        self.pairs[-1] = self.pairs[-2]
        excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int32)
        blocks = -(-2 * n // BLOCK)
        self.excess = np.full((blocks, BLOCK), np.iinfo(np.int32).max, np.int32)
        self.excess.ravel()[: 2 * n] = excess
        self.lows = [self.excess.min(axis=1)]
        while len(self.lows[-1]) > 1:
            low = self.lows[-1]
            low = np.concatenate((low, np.full(len(low) % 2, np.iinfo(np.int32).max, np.int32)))
            self.lows.append(low.reshape(-1, 2).min(axis=1))
        self.ends = self.close(self.opens)
        self.size = (self.ends - self.opens + 1) // 2

    def _within(self, block: np.ndarray, least: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The first place of a block, from `least` on, whose excess is `below` or less; -1 if there is none."""
        out = np.full(len(block), -1, np.int64)
        for at in range(0, len(block), 1 << 15):
            part = slice(at, at + (1 << 15))
            hit = (self.excess[block[part]] <= below[part, None]) & (np.arange(BLOCK) >= least[part, None])
            first = hit.argmax(axis=1)
            out[part] = np.where(hit[np.arange(len(first)), first], first, -1)
        return out

    def close(self, opens: np.ndarray) -> np.ndarray:
        """Where the subtrees end that begin at `opens`: the first place behind with a smaller excess."""
        below = self.excess.ravel()[opens] - 1
        block, least = (opens + 1) // BLOCK, (opens + 1) % BLOCK
        first = self._within(block, least, below)
        out = block * BLOCK + first
        left = np.flatnonzero(first < 0)
        at, low, found = block[left] + 1, below[left], np.full(len(left), -1, np.int64)
        for level, lows in enumerate(self.lows):  # up, to the first tree of blocks behind that holds such a place
            odd = np.flatnonzero((found < 0) & ((at & 1 == 1) | (level == len(self.lows) - 1)))
            hit = odd[lows[np.minimum(at[odd], len(lows) - 1)] <= low[odd]]
            found[hit] = level
            on = found < 0
            at[on] = (at[on] + 1) >> 1
        for level in range(len(self.lows) - 1, 0, -1):  # and down in it
            here = np.flatnonzero(found >= level)
            left_child = 2 * at[here]
            at[here] = left_child + (self.lows[level - 1][left_child] > low[here])
        out[left] = at * BLOCK + self._within(at, np.zeros(len(at), np.int64), low)
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each node's subtree."""
        upto = np.concatenate(([0], np.cumsum(x)))
        at = np.arange(len(x))
        return upto[at + self.size] - upto[at]

    def leaves(self) -> np.ndarray:
        return self.pairs[self.ends] - self.pairs[self.opens]

    def least(self, x: np.ndarray) -> np.ndarray:
        """The minimum of each node's subtree, from minima of runs of 1, 2, 4, ... nodes."""
        out, run, width, at = x.copy(), x, 1, np.arange(len(x))
        for _ in range(int(self.size.max(initial=1)).bit_length()):
            now = np.flatnonzero((self.size >= width) & (self.size < 2 * width))
            out[now] = np.minimum(run[at[now]], run[at[now] + self.size[now] - width])
            run, width = np.minimum(run[:-width], run[width:]) if len(run) > width else run, 2 * width
        return out


class Nodes:
    """Nodes of one trie in preorder, as they come along the sorted paths."""

    def __init__(self):
        self.depth: list[int] = []
        self.parent: list[int] = []
        self.key: list[bytes] = []
        self.length: list[int] = []
        self.ends: list[str | None] = []
        self.sums: list[list[int]] = [[], [], [], []]  # members, and of closed subtrees children, leaves, saved
        self.low: list[int] = []
        self.path: list[int] = []  # nodes from the root to the last one

    def reach(self, depth: int, key: bytes, length: int) -> int:
        """The node of that key below the path, made if it isn't on it."""
        if len(self.path) > depth and self.key[self.path[depth]] == key:
            return self.path[depth]
        del self.path[depth:]
        self.path.append(len(self.depth))
        self.depth.append(depth)
        self.parent.append(self.path[depth - 1] if depth else -1)
        self.key.append(key)
        self.length.append(length)
        self.ends.append(None)
        for x in self.sums:
            x.append(0)
        self.low.append(_FAR)
        return self.path[depth]

    def fold(self, whole: bool) -> tuple[dict, dict]:
        """What is known of nodes that no other shard can have, and what goes on about the others, those of the first and of the last path; `whole`: there is no other shard."""
        n = len(self.depth)
        depth, parent, length = (np.array(x, np.int64) for x in (self.depth, self.parent, self.length))
        members, kids, leaves, saved = (np.array(x, np.int64) for x in self.sums)
        shape = Parens(depth)
        open_ = np.zeros(n, bool)
        if not whole:
            open_[: 1 + int(np.argmax(np.append(depth[1:] <= depth[:-1], True)))] = True  # the first path, down to its end
            open_[self.path] = True
        convs, low = shape.sums(members), shape.least(np.array(self.low, np.int64))
        children = kids + np.bincount(parent[1:], minlength=n)
        bare = (shape.size == 1) & (kids > 0)  # has children, though none of them is here
        all_leaves = shape.leaves() + shape.sums(leaves - bare)
        all_saved = shape.sums(saved + (convs - 1) * length)
        shut = np.flatnonzero(~open_)
        over = parent[shut]
        pending = (over >= 0) & open_[over]
        for total, more in ((kids, 1), (leaves, all_leaves[shut]), (saved, all_saved[shut]), (members, convs[shut])):
            np.add.at(total, over[pending], more if isinstance(more, int) else more[pending])
        hash_of = [self.ends[k] for k in shut]
        done = {
            "conv_id": low[shut], "depth": depth[shut], "parent_conv_id": pa.array(low[over], mask=pending | (over < 0)), "parent_key": [self.key[p] if x else None for p, x in zip(over, pending)],
            "n_convs": convs[shut], "n_children": children[shut], "n_leaves": all_leaves[shut], "saved_tokens": all_saved[shut], "ends": hash_of, "key": [self.key[k] for k in shut],
        }
        on = np.flatnonzero(open_)
        going = {
            "at": np.arange(len(on)), "conv_id": low[on], "depth": depth[on], "n_convs": members[on], "n_children": kids[on], "n_leaves": leaves[on], "saved_tokens": saved[on],
            "ends": [self.ends[k] for k in on], "key": [self.key[k] for k in on], "length": length[on],
        }
        return done, going

    def add(self, rows: dict) -> None:
        """What a shard passed on, in its order, by the names of fold()."""
        for depth, key, length, low, ends, *more in zip(*(rows[c] for c in ("depth", "key", "length", "conv_id", "ends", "n_convs", "n_children", "n_leaves", "saved_tokens"))):
            k = self.reach(depth, key, length)
            self.low[k] = min(self.low[k], low)
            self.ends[k] = self.ends[k] or ends
            for total, x in zip(self.sums, more):
                total[k] += x


_SCHEMA = {"seq": pa.int64(), "at": pa.int64(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "parent_key": pa.binary(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(), "key": pa.binary(), "length": pa.int64()}
_DDL = ", ".join(f"{k} {'binary' if v == pa.binary() else 'string' if v == pa.string() else 'long'}" for k, v in _SCHEMA.items())


def _batch(rows: dict, seq: int | None) -> pa.RecordBatch:
    n = len(rows["key"])
    rows = rows | ({"seq": [seq] * n} if seq is not None else {})
    return pa.record_batch([rows[k] if isinstance(rows.get(k), pa.Array) else pa.array(rows.get(k, [None] * n), kind) for k, kind in _SCHEMA.items()], names=list(_SCHEMA))


def _plain(rows: dict) -> dict:
    return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in rows.items()}


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, digests, lengths) of each conversation in `turns` (conv_id, turn, role, text): digests and code points of its turns' texts, in order.

    Turns go by turn, null first, then by role and text; null roles and texts are empty; repeated rows are repeated turns.
    Rows without a conv_id belong to no conversation and are left out. A conversation's digests, not its texts, meet in one row.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", F.struct(at.alias("at"), digest.alias("d"), F.length("text").alias("n")).alias("x"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return own.select("conv_id", F.transform("x", lambda x: x["d"]).alias("digests"), F.transform("x", lambda x: x["n"]).alias("lengths"))


def grafted(own: DataFrame, share: int = 100, most: int = 6) -> DataFrame:
    """`own` (conv_id, digests, lengths) with the first h turns of each conversation replaced by those of conversation conv_id - conv_id % share (all if fewer, none if it isn't there); h is the unsigned crc32 of the id's decimal digits % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = own.where(F.col("conv_id") % share == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("digests", "lengths")))
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % share).withColumn("h", h).join(heads, "base", "left")

    def both(c: str) -> Column:
        head = F.coalesce(f"head_{c}", F.slice(c, 1, 0))
        return F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0))))

    return rows.select("conv_id", *(both(c).alias(c) for c in ("digests", "lengths")))


def _distinct(own: DataFrame) -> DataFrame:
    """(path, lengths, n, low, ends) of every distinct sequence of `own`: its digests as bytes, the number and the smallest of its conversations, and the SHA-256 of all of their ids.

    Ids are sorted and written in pieces of a bounded number, many tasks at a time; the digest of a sequence reads its pieces in order, one at a time.
    """
    rows = own.select("conv_id", F.unhex(F.array_join("digests", "")).alias("path"), "lengths", F.floor(F.col("conv_id") / PIECE).alias("piece"))
    rows = rows.withColumn("key", F.unhex(F.md5("path")))
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    pieces = rows.groupBy("key", "piece").agg(F.first("path").alias("path"), F.first("lengths").alias("lengths"), F.count("*").alias("n"), F.min("conv_id").alias("low"), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def out() -> pa.RecordBatch:
            _, path, lengths, n, low, digest = held
            return pa.record_batch([pa.array([path], pa.binary()), pa.array([lengths], pa.list_(pa.int32())), pa.array([n]), pa.array([low]), pa.array([digest.hexdigest()])], names=["path", "lengths", "n", "low", "ends"])

        for batch in batches:
            for key, path, lengths, n, low, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0] == key:
                    held[3] += n
                    held[4] = min(held[4], low)
                    held[5].update(b"," + text.encode())
                    continue
                if held:
                    yield out()
                held[:] = key, path, lengths, n, low, hashlib.sha256(text.encode())
        if held:
            yield out()

    sorted_ = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "path", "lengths", "n", "low", "ids")
    return sorted_.mapInArrow(run, "path binary, lengths array<int>, n long, low long, ends string")


def _shards(paths: DataFrame, ranges: int, shard: int) -> DataFrame:
    """Nodes that only one range of the sorted `paths` has, and (seq: the range's number) those on its first and last path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spines: list[dict] = []
        nodes, turns, last = Nodes(), 0, b""

        def close() -> pa.RecordBatch:
            done, going = nodes.fold(False)
            spines.append(_plain(going))
            return _batch(done, None)

        for batch in batches:
            for path, lengths, n, low, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if not nodes.depth:
                    nodes.reach(0, b"", 0)
                    last = b""
                same = _shared(last, path)
                del nodes.path[same + 1 :]
                key = nodes.key[nodes.path[same]]
                for d in range(same, len(lengths)):
                    key = xxhash.xxh3_128_digest(key + path[d * WIDTH : (d + 1) * WIDTH])
                    nodes.reach(d + 1, key, lengths[d])
                at = nodes.path[-1]
                nodes.sums[0][at] += n
                nodes.low[at], nodes.ends[at] = low, ends
                last, turns = path, turns + len(lengths) - same
                if turns >= shard:
                    yield close()
                    nodes, turns = Nodes(), 0
        if nodes.depth:
            yield close()
        if spines:
            done, going = _merged(spines, False)
            yield _batch(done, None)
            yield _batch(going, TaskContext.get().partitionId())

    return paths.select("path", "lengths", "n", "low", "ends").repartitionByRange(ranges, "path").sortWithinPartitions("path").mapInArrow(run, _DDL)


def _shared(a: bytes, b: bytes) -> int:
    """The number of first turns that two paths share."""
    n = min(len(a), len(b)) // WIDTH * WIDTH
    if a[:n] == b[:n]:
        return n // WIDTH
    return int((np.frombuffer(a, np.uint64, n // 8) != np.frombuffer(b, np.uint64, n // 8)).argmax()) * 8 // WIDTH


def _merged(spines: Sequence[dict], whole: bool) -> tuple[dict, dict]:
    nodes = Nodes()
    for rows in spines:
        nodes.add(rows)
    return nodes.fold(whole)


def _merge(open_: DataFrame, fan: int, whole: bool) -> DataFrame:
    """Spines of `fan` neighbouring shards merged; nodes that are done, and (seq) the spine of each group."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("seq", "ascending"), ("at", "ascending")])
        group = rows.column("seq")[0].as_py() // fan
        done, going = _merged([rows.to_pydict()], whole)
        return pa.Table.from_batches([_batch(done, None), _batch(going, group)])

    return open_.withColumn("group", F.floor(F.col("seq") / fan)).groupBy("group").applyInArrow(lambda t: run(t.drop(["group"])), _DDL)


def prefix_trie(own: DataFrame, turns: int = RANGE, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """One row for each distinct sequence of first turns in `own` (conv_id, digests, lengths; see sequences()).

    conv_id (the smallest of its members, the conversations that begin so), depth (turns), parent_conv_id (that of the
    sequence without the last turn; null for the root, of no turn), n_convs (members), n_children, n_leaves (sequences below
    or itself that no other continues), saved_tokens (below and itself: (n_convs - 1) times the code points of the last
    text), ends_sha256 (of the ids of members that have no further turn, ascending, comma-joined). A conversation without
    turns is a member of the root. Without conversations there is no row. conv_id and depth name a node.

    Distinct sequences are sorted and cut into ranges, and these into shards of about `shard` new turns. A shard's trie is a
    string of balanced parentheses. Nodes on its first and last path may go on in other shards: what is known of these
    is merged by `fan` neighbours at a time until nothing is open. A common first turn is therefore one node in every
    shard, no task holds all that begins with it, and no key is hot.
    """
    paths = settled(_distinct(own))
    total = paths.agg(F.sum(F.size("lengths"))).first()[0] or 0
    ranges = max(1, -(-total // turns))
    first = settled(_shards(paths, ranges, shard))
    known = [first.where("seq is null").drop("key")]
    spine, open_ = None, first.where("seq is not null")
    while True:
        ranges = -(-ranges // fan)
        step = settled(_merge(open_, fan, ranges == 1))
        now = step.where("seq is null")
        spine = now if spine is None else spine.union(now)
        if ranges == 1:
            break
        open_ = step.where("seq is not null")
    known.append(spine.drop("key"))
    rows = known[0].unionByName(known[1])
    above = spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    rest = rows.where("parent_key is not null").join(above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return rows.where("parent_key is null").select(*names, ends).union(rest.select(*names, ends))
