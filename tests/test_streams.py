"""Streams whose input changes between batches."""

import struct
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.sources import components
from tickloom.streaming import ordered

BEGIN = datetime(2024, 1, 1, tzinfo=UTC)


def record(text):
    return struct.pack("<I", len(text)) + text.encode()


def follow(spark, path, base, **options):
    """One run of the stream over what is there; all payloads so far."""
    rows = spark.readStream.format("framed_log").option("path", str(path)).options(**options).load()
    rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return sorted(bytes(r.payload).decode() for r in spark.read.parquet(f"{base}/out").collect())


def test_log_is_followed(spark, tmp_path):
    """Records appended between runs, a half-written tail, a rotation, and a stop in between."""
    components.register(spark)
    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs/a.log"
    log.write_bytes(record("one") + record("two") + record("three")[:6])
    assert follow(spark, tmp_path / "logs", tmp_path) == ["one", "two"]
    with log.open("ab") as f:
        f.write(record("three")[6:] + record("") + record("four")[:3])
    assert follow(spark, tmp_path / "logs", tmp_path) == ["", "one", "three", "two"]
    with log.open("ab") as f:
        f.write(record("four")[3:])
    log.rename(f"{log}.1700000000")
    log.write_bytes(record("five"))
    (tmp_path / "logs/b.log").write_bytes(record("six"))
    assert follow(spark, tmp_path / "logs", tmp_path) == sorted(["", "one", "three", "two", "four", "five", "six"])
    assert follow(spark, tmp_path / "logs", tmp_path) == sorted(["", "one", "three", "two", "four", "five", "six"])


def test_offsets_after_rotation():
    known = {"x.log": 50, "y.log": 7}
    names = ["x.log", "x.log.10", "x.log.20", "y.log", "z.log"]
    assert components._begins_at(known, names) == {"x.log": 0, "x.log.10": 50, "x.log.20": 0, "y.log": 7, "z.log": 0}
    assert components._begins_at({}, names) == dict.fromkeys(names, 0)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def landed(spark, batches, schema, path):
    """A file for each batch, in order."""
    Path(path).mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame([tuple(BEGIN + timedelta(seconds=x) if c.endswith("ts timestamp") else x for x, c in zip(r, schema.split(", "))) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(path))


def run(df, tmp_path):
    df.writeStream.format("parquet").option("path", str(tmp_path / "res")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "res"))


def test_gate_over_batches(spark, rocks, tmp_path):
    """A message a batch late comes in its place; one behind the watermark is dropped; a board that was idle begins anew."""
    schema = "board string, seq long, version long, payload string, ts timestamp"
    batches = [
        [("a", 1, 1, "p", 0), ("a", 3, 1, "r", 20), ("b", 1, 4, "x", 5)],
        [("a", 2, 2, "q", 10), ("a", 4, 1, "s", 30)],
        [("~", 0, 1, "", 200)],
        [("a", 6, 1, "t", 210)],
        [("a", 5, 9, "late", 40), ("~", 0, 1, "", 2000)],
        [("a", 7, 1, "u", 2010), ("b", 2, 4, "y", 2010)],
        [("~", 0, 1, "", 9000)],
        [("~", 0, 1, "", 9500)],
    ]
    got = run(ordered.gate_stream(landed(spark, batches, schema, tmp_path / "in"), "60 seconds", 1000), tmp_path).where("board <> '~'")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, "p"), ("a", 2, 2, "q"), ("a", 3, 1, "r"), ("a", 7, 1, "u"), ("b", 1, 4, "x"), ("b", 2, 4, "y")]
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "ck"))
    assert {r.key.board for r in state.select("key").collect()} <= {"~"}


def test_subscriptions_change_between_batches(spark, rocks, tmp_path):
    actions = [[("c1", "s", "A", "subscribe", 1, 0)], [("c2", "s", "A", "subscribe", 3, 30), ("c1", "s", "A", "unsubscribe", 2, 20)], [("c1", "s", "A", "subscribe", 4, 5000)]]
    ticks = [[("s", "A", 1, 1.0, 0), ("s", "A", 2, 2.0, 19), ("s", "B", 3, 3.0, 19)], [("s", "A", 5, 5.0, 31), ("s", "A", 4, 4.0, 20)], [("s", "A", 6, 6.0, 40), ("s", "A", 9, 0.0, 9000)], [("s", "~", 9, 0.0, 20000)], [("s", "~", 9, 0.0, 30000)]]
    a = landed(spark, actions, "client string, broker string, symbol string, action string, seq long, ts timestamp", tmp_path / "a")
    t = landed(spark, ticks, "broker string, symbol string, seq long, price double, ts timestamp", tmp_path / "t")
    got = run(ordered.routed_stream(t, a, "60 seconds", 3), tmp_path)
    assert sorted((r.client, r.seq, r.price) for r in got.collect()) == [("c1", 1, 1.0), ("c1", 2, 2.0), ("c1", 9, 0.0), ("c2", 5, 5.0), ("c2", 6, 6.0), ("c2", 9, 0.0)]


def test_gate_deals_boards_over_few_keys(spark, rocks, tmp_path):
    """Many boards in a few keys of the state give what each board by itself gives, in order of microseconds."""
    schema = "board string, seq long, version long, payload string, ts timestamp"
    rows = [(None if k % 50 == 7 else f"b{k % 50}", k, k * k % 4, "p", 30 + k / 7 + 0.0002 * (k % 3)) for k in range(600)]
    batches = [rows[100:400:2], rows[:100] + rows[101:400:2], rows[400:], [("~", 0, 1, "", 500)], [("~", 0, 1, "", 600)], [("~", 0, 1, "", 700)]]
    got = run(ordered.gate_stream(landed(spark, batches, schema, tmp_path / "in"), "60 seconds", 86400, 4), tmp_path).where("board is null or board <> '~'")
    want, last = [], {}
    for board, seq, version, payload, _ in sorted(rows, key=lambda r: r[4]):
        if version != last.get(board, 0):
            want.append((board, seq, version, payload))
        last[board] = version
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    for name in ("last", "index"):
        assert spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "ck")).count() <= 4


class Kept:
    """State variables in a dict, with the calls that are made to them."""

    def __init__(self):
        self.of, self.calls, self.timers = {}, 0, set()

    def variable(self, name):
        def at(key=()):
            self.calls += 1
            return self.of.setdefault(name, {}), key

        class Variable:
            def get(_):
                of, key = at()
                return of.get(key)

            def update(_, value):
                of, key = at()
                of[key] = value

            def clear(_):
                at()[0].clear()

            def getValue(_, key):
                return at(key)[0].get(key)

            def updateValue(_, key, value):
                at(key)[0][key] = value

            def removeKey(_, key):
                del at(key)[0][key]

            def keys(_):
                return iter([*at()[0]])

        return Variable()

    def getMapState(self, name, *_):  # noqa: N802
        return self.variable(name)

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_state_is_called_by_pieces(monkeypatch):
    """Calls to the state don't grow with rows or boards, and what the watermark hasn't reached is neither read nor written again."""
    monkeypatch.setattr(ordered, "PIECE", 1000)
    kept, gate = Kept(), ordered.VersionGate(10_000_000)
    gate.init(kept)
    rows = pd.DataFrame({"board": [f"b{k % 700}" for k in range(5000)], "at": [k * 1000 for k in range(5000)], "seq": range(5000), "version": [k // 700 % 2 + 1 for k in range(5000)], "payload": "x"})
    come = [ordered.pieces_of([pa.RecordBatch.from_pandas(b.assign(bucket=0), preserve_index=False)], ["bucket"], gate.schema) for b in (rows[::2], rows[1::2])]
    assert not list(gate.handleInputRows((0,), (b.to_pandas() for pieces in come for b in pieces), None))
    assert kept.calls == 5 + 2 and kept.timers == {0}
    before = dict(kept.of["held"])
    kept.timers.remove(0)
    first = pd.concat(gate.handleExpiredTimer((0,), At(1500), At(0)))
    assert list(first["seq"].sort_values()) == list(range(1501)) and kept.calls <= 20 and kept.timers == {1501}
    assert [k for k, v in kept.of["held"].items() if before.get(k) == v] == [(2,), (3,), (4,)]
    kept.timers.remove(1501)
    rest = pd.concat(gate.handleExpiredTimer((0,), At(9000), At(1501)))
    assert list(rest["seq"].sort_values()) == list(range(1501, 5000)) and not kept.of["held"] and kept.calls <= 40
    assert min(kept.timers) == 4300 + 10_000_000 + 1  # the board that is idle first
    assert list(gate.handleExpiredTimer((0,), At(20_000_000), At(10_004_301))) == [] and not kept.of["last"] and not kept.of["index"]


def test_actions_and_ticks_of_one_millisecond(spark, rocks, tmp_path):
    """What happens within a millisecond is told apart, whatever batch it comes in; an action counts before a tick of its microsecond."""
    u = 1e-6
    actions = [[("c1", "s", "A", "subscribe", 2, 10 + 200 * u), ("c2", "s", "A", "subscribe", 1, 10 + 100 * u)], [("c1", "s", "A", "unsubscribe", 4, 10 + 400 * u)]]
    ticks = [[("s", "A", 4, 4.0, 10 + 400 * u), ("s", "A", 1, 1.0, 10 + 100 * u)], [("s", "A", 2, 2.0, 10 + 199 * u), ("s", "A", 3, 3.0, 10 + 399 * u)], [("s", "~", 9, 0.0, 20000)], [("s", "~", 9, 0.0, 30000)]]
    a = landed(spark, actions, "client string, broker string, symbol string, action string, seq long, ts timestamp", tmp_path / "a")
    t = landed(spark, ticks, "broker string, symbol string, seq long, price double, ts timestamp", tmp_path / "t")
    got = run(ordered.routed_stream(t, a, "60 seconds", 2), tmp_path)
    assert sorted((r.client, r.seq, r.price) for r in got.collect()) == [("c1", 3, 3.0), ("c2", 1, 1.0), ("c2", 2, 2.0), ("c2", 3, 3.0), ("c2", 4, 4.0)]


def test_router_against_one_pass(monkeypatch):
    """Ticks, actions and watermarks in any pieces give what one pass over all of them in order gives, and no call to the state for a row."""
    monkeypatch.setattr(ordered, "PIECE", 50)
    monkeypatch.setattr(ordered, "OUT", 70)
    kept, router = Kept(), ordered.Router()
    router.init(kept)
    rows = [(k * 37 % 401 * 1000 + k % 3, k, f"c{k % 4}", (k * k + k // 7) % 3 - 1, None) if k % 3 == 0 else (k * 37 % 401 * 1000 + k % 3, k, None, None, k / 2) for k in range(401)]
    got, timer = [], 0
    for passed in (100, 250, 400, 500):
        part = [r for r in rows if (passed - 150) * 1000 < r[0] <= passed * 1000 and r[0] > timer * 1000] if passed > 100 else [r for r in rows if r[0] <= 100_000]
        frame = pd.DataFrame(part, columns=router.schema.names).astype({"action": "Int64"}).assign(broker="s")
        come = ordered.pieces_of([pa.RecordBatch.from_pandas(frame, preserve_index=False)], ["broker"], router.schema) if part else iter(())
        list(router.handleInputRows(("s", "A", 0), (b.to_pandas() for b in come), None))
        kept.timers = {t for t in kept.timers if t > passed}
        for f in router.handleExpiredTimer(("s", "A", 0), At(passed), At(0)):
            got += [(c, int(s), float(p)) for c, seq, price in zip(f["client"], f["seq"], f["price"]) for s, p in zip(seq, price)]
        timer = passed
    want, on = [], set()
    for _, seq, client, action, price in sorted(rows, key=lambda r: (r[0], r[1])):
        if client is None:
            want += [(c, seq, price) for c in on]
        elif action == 1:
            on.add(client)
        elif action == 0:
            on.discard(client)
    assert sorted(got) == sorted(want) and len(want) > 100 and kept.calls < 120
