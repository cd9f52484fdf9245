"""Stateful operators in order of event time: rows wait in state until the watermark has passed them, so late and early batches give one result."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a piece that is held, of what is given on at once, and of what a task packs at once.
PIECE, OUT, PACK = 16_384, 262_144, 262_144
#: Whole numbers stay exact beside nulls.
WHOLE = {pa.int64(): pd.Int64Dtype()}
ROUTED = ["broker", "symbol", "client", "seq", "timestamp", "price"]


def packed(rows: pa.Table) -> bytes:
    """`rows` for a state variable."""
    return b"".join(b.serialize().to_pybytes() for b in rows.combine_chunks().to_batches()[:1])


def unpacked(rows: bytes, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(rows), schema)] if rows else [], schema)


def pieces_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows (keys, columns of `schema`) packed by key, as keys, at (of the last) and rows. Those without a time are left out, as Spark drops them."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PACK:
            yield _pieces(pa.Table.from_batches(held), keys, schema)
            held, n = [], 0
    if n:
        yield _pieces(pa.Table.from_batches(held), keys, schema)


def _pieces(rows: pa.Table, keys: Sequence[str], schema: pa.Schema) -> pa.RecordBatch:
    rows = rows.filter(rows["at"].is_valid()).combine_chunks()
    group = np.zeros(len(rows), "int64")
    for k in keys:
        code, names = pd.factorize(rows[k].to_pandas(), use_na_sentinel=False)
        group = group * len(names) + code
    at = rows["at"].to_numpy()
    order = np.lexsort((at, group))
    rows, at, group = rows.take(pa.array(order)), at[order], group[order]
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    ends = [*begins[1:].tolist(), len(group)]
    cuts = [(i, min(i + PIECE, y)) for x, y in zip(begins.tolist(), ends) for i in range(x, y, PIECE)]
    first = rows.select(list(keys)).take(pa.array([x for x, _ in cuts], pa.int64()))
    columns = [*(first[k].combine_chunks() for k in keys), pa.array([int(at[y - 1]) for _, y in cuts], pa.int64())]
    columns.append(pa.array([packed(rows.slice(x, y - x).select(schema.names).cast(schema)) for x, y in cuts], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, [*keys, "at", "rows"])


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark reaches them, and hands them on. A timer waits for the earliest row that is held.

    Rows come packed (see in_order()) and are held as Arrow batches, pieces of up to PIECE rows by time. A row is written
    when it comes, read once its piece begins before the watermark, and written again only where the piece ends behind it;
    Spark's way into Python and calls to the state count by pieces, not by rows. Rows have their time, in microseconds, in
    `at`. Those that come after the watermark has passed their time are dropped, by Spark where all of a piece are.
    """

    schema = pa.schema([])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "piece long", "rows binary")
        self.index = handle.getValueState("index", "due long, passed long, pieces binary")

    def known(self) -> tuple[int | None, int | None, np.ndarray]:
        """The timer that is set, the time up to which rows were handed on, and the first time and number of each piece."""
        due, passed, pieces = self.index.get() or (None, None, b"")
        return due, passed, np.frombuffer(pieces, "int64").reshape(-1, 2)

    def wait(self, before: int | None, due: int | None, passed: int | None, pieces: np.ndarray) -> None:
        """Sets the timer for `due` in place of that for `before`."""
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and before != due:
            self.handle.registerTimer(due)
        self.index.update((due, passed, pieces.tobytes()))

    def hold(self, rows: pa.Table, pieces: np.ndarray) -> np.ndarray:
        """Writes `rows` as further pieces."""
        rows = rows.sort_by("at")
        begins, free = range(0, len(rows), PIECE), int(pieces[:, 1].max(initial=-1)) + 1
        for k, i in enumerate(begins):
            self.held.updateValue((free + k,), (packed(rows.slice(i, PIECE)),))
        more = [(rows["at"][i].as_py(), free + k) for k, i in enumerate(begins)]
        return np.concatenate([pieces, np.array(more, "int64").reshape(-1, 2)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, passed, pieces = self.known()
        new = pa.concat_tables([self.schema.empty_table(), *(unpacked(x, self.schema) for b in rows for x in b["rows"])])
        if passed is not None:
            new = new.filter(pa.array(new["at"].to_numpy() > passed * 1000))
        if len(new):
            pieces = self.hold(new, pieces)
            first = due_of(pieces)
            self.wait(before, first if before is None else min(before, first), passed, pieces)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        before, _, pieces = self.known()
        before = None if before is not None and before <= passed else before
        begun = pieces[:, 0] <= passed * 1000
        tables = []
        for n in pieces[begun, 1].tolist():
            tables.append(unpacked(self.held.getValue((n,))[0], self.schema))
            self.held.removeKey((n,))
        pieces, rows = pieces[~begun], pa.concat_tables([self.schema.empty_table(), *tables])
        ready = rows["at"].to_numpy() <= passed * 1000
        if not ready.all():
            pieces = self.hold(rows.filter(pa.array(~ready)), pieces)
        out, idle, kept = self.take(key, rows.filter(pa.array(ready)).to_pandas(types_mapper=WHOLE.get), passed)
        due = [d for d in (due_of(pieces) if len(pieces) else None, idle) if d is not None]
        self.wait(before, min(due, default=None), passed, pieces)
        if not due and not kept:
            self.index.clear()
        return out

    def take(self, key, rows: pd.DataFrame, passed: int) -> tuple[Iterator[pd.DataFrame], int | None, bool]:
        """What rows in no order give, when, in milliseconds, the key is to be woken without a further row, and whether it keeps a state; `passed` is the time up to which all are known."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def due_of(pieces: np.ndarray) -> int:
    """The millisecond by which the first row of `pieces` has passed."""
    return -int(-pieces[:, 0].min() // 1000)


class VersionGate(InOrder):
    """Passes a board's message when its version differs from the last one's, 0 at first and after `idle` milliseconds without a message; an idle board leaves the state. A key has any boards."""

    schema = pa.schema([("board", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("version", pa.int64()), ("payload", pa.string())])

    def __init__(self, idle: int):
        self.idle = idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "boards binary")

    def take(self, key, rows, passed):
        kept = pa.schema([self.schema.field(c) for c in ("board", "at", "version")])
        last = unpacked((self.last.get() or (b"",))[0], kept)
        before = last.to_pandas(types_mapper=WHOLE.get).assign(seq=-1, payload=None).astype({"seq": "Int64"})
        both = pd.concat([before, rows], ignore_index=True)
        board, _ = pd.factorize(both["board"], use_na_sentinel=False)
        at = both["at"].to_numpy("int64")
        order = np.lexsort((both["seq"].fillna(-1).to_numpy("int64"), at, board))
        both, board, at, version = both.iloc[order], board[order], at[order], both["version"].iloc[order]
        known = np.r_[False, (board[1:] == board[:-1]) & (np.diff(at) <= self.idle)][: len(at)]
        differs = (version != version.shift().where(known, 0).fillna(0)).fillna(False).to_numpy(bool)
        out = both[differs & (order >= len(last))]
        state = both[np.r_[board[1:] != board[:-1], True][: len(at)] & (at + self.idle >= passed * 1000)]
        if len(state):
            self.last.update((packed(pa.Table.from_pandas(state[kept.names], kept, preserve_index=False)),))
        elif len(last):
            self.last.clear()
        idle = int(state["at"].min() + self.idle) // 1000 + 1 if len(state) else None
        out = out[["board", "seq", "version", "payload"]]
        return (out.iloc[i : i + OUT] for i in range(0, len(out), OUT)), idle, bool(len(state))


class Router(InOrder):
    """Gives each tick of a broker's symbol to the clients that are subscribed at its time; an action counts before a tick of the same time.

    `action` is 1 to subscribe, 0 to unsubscribe, negative for others and null for ticks. A client's ticks come in arrays.
    """

    schema = pa.schema([("at", pa.int64()), ("seq", pa.int64()), ("client", pa.string()), ("action", pa.int64()), ("price", pa.float64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.clients = handle.getMapState("clients", "client string", "since long")

    def take(self, key, rows, passed):
        rows = rows.sort_values(["at", "seq"], kind="stable", ignore_index=True)
        ticks, actions = rows[rows["action"].isna()], rows[rows["action"].fillna(-1) >= 0]
        now = [k[0] for k in self.clients.keys()]
        # who is subscribed so far counts as an action before all others
        client, names = pd.factorize(np.array([*now, *actions["client"]], object), use_na_sentinel=False)
        at = np.r_[np.full(len(now), np.iinfo("int64").min), actions["at"].to_numpy("int64")]
        on = np.r_[np.ones(len(now), bool), actions["action"].to_numpy("int64") == 1]
        order = np.argsort(client, kind="stable")
        client, at, on = client[order], at[order], on[order]
        last = np.r_[client[1:] != client[:-1], True][: len(client)]
        were = set(now)
        for c, t, subscribed in zip(names[client[last]], at[last].tolist(), on[last]):
            if subscribed and c not in were:
                self.clients.updateValue((c,), (t,))
            elif not subscribed and c in were:
                self.clients.removeKey((c,))
        # an action holds for the ticks from its time up to the client's next action
        begin = np.searchsorted(ticks["at"].to_numpy("int64"), at, "left")
        end = np.where(last, len(ticks), np.r_[begin[1:], 0][: len(begin)])
        return given(key[:2], ticks, names, client, begin, np.where(on, end - begin, 0)), None, bool(on[last].any())


def given(key: Sequence, ticks: pd.DataFrame, names: Sequence, client: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[pd.DataFrame]:
    """Spans of `ticks`, each of a client and by client, as arrays of PIECE ticks at most."""
    seq = ticks["seq"].to_numpy(object, na_value=None) if ticks["seq"].hasnans else ticks["seq"].to_numpy("int64")
    columns = [seq, ticks["at"].to_numpy("int64") // 1000, ticks["price"].to_numpy("float64")]
    first = np.flatnonzero(np.r_[True, client[1:] != client[:-1]][: len(client)]).tolist()
    made, size = [], 0
    for i, j in zip(first, [*first[1:], len(client)]):
        n = length[i:j]
        at = np.repeat(begin[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for k in range(0, len(at), PIECE):
            part = at[k : k + PIECE]
            made.append((*key, names[client[i]], *(c[part] for c in columns)))
            size += len(part)
            if size >= OUT:
                yield pd.DataFrame(made, columns=ROUTED)
                made, size = [], 0
    if made:
        yield pd.DataFrame(made, columns=ROUTED)


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def in_order(rows: DataFrame, keys: Sequence[str], processor: InOrder, late: str, result: str) -> DataFrame:
    """What `processor` makes of `rows` (keys, columns of its schema) with the watermark `late` behind.

    Spark hands each row to a state processor as a Python object, so tasks pack their rows by key before they are dealt; a
    piece has the time of its last row, so that the watermark is that of the rows.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    schema = processor.schema
    pieces = rows.mapInArrow(lambda batches: pieces_of(batches, keys, schema), f"{kinds}, at long, rows binary")
    pieces = pieces.select(*keys, F.timestamp_micros("at").alias("ts"), "rows").withWatermark("ts", late)
    return pieces.groupBy(*keys).transformWithStateInPandas(processor, result, "Append", "EventTime")


def gate_stream(messages: DataFrame, late: str = "1 minute", idle: int = 86400, buckets: int = 0) -> DataFrame:
    """Messages (board, seq, version, payload, ts) of a stream that bring a new version, in order of ts and seq across all batches.

    A message waits until none of its time can come any more, `late` behind the newest. A board without a message for `idle`
    seconds begins anew at version 0. Many boards are dealt over `buckets` keys of the state, as a batch costs calls for each
    key; with 0 each board is one.
    """
    rows = messages.select("board", micros("ts").alias("at"), "seq", "version", "payload")
    if buckets:
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("board"), F.lit(buckets)))
    return in_order(rows, ["bucket" if buckets else "board"], VersionGate(idle * 1000), late, "board string, seq long, version long, payload string")


def routed_stream(ticks: DataFrame, actions: DataFrame, late: str = "1 minute", buckets: int = 1) -> DataFrame:
    """A row (broker, symbol, client, seq, timestamp, price) for each tick (broker, symbol, seq, price, ts) and each client that is subscribed at its time by `actions` (client, broker, symbol, action, seq, ts); both are streams.

    Times are compared in microseconds; `timestamp` is in milliseconds. Clients of a symbol are dealt over `buckets`, and its
    ticks go to each, so that a symbol that all want isn't one key.
    """
    does = F.when(F.col("action") == "subscribe", 1).when(F.col("action") == "unsubscribe", 0).otherwise(-1).cast("long")
    bucket = F.pmod(F.xxhash64("client"), F.lit(buckets)).alias("bucket")
    a = actions.select("broker", "symbol", bucket, micros("ts").alias("at"), "seq", "client", does.alias("action"), F.lit(None).cast("double").alias("price"))
    t = ticks.select("broker", "symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), micros("ts"), "seq", F.lit(None).cast("string"), F.lit(None).cast("long"), "price")
    spans = in_order(a.union(t), ["broker", "symbol", "bucket"], Router(), late, "broker string, symbol string, client string, seq array<long>, timestamp array<long>, price array<double>")
    return spans.select("broker", "symbol", "client", F.inline(F.arrays_zip("seq", "timestamp", "price")))
