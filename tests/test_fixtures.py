"""Operators on small inputs whose results are worked out by hand."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars as fn
from tickloom.operators import candles as bars
from tickloom.operators import dimensions as dims
from tickloom.operators import indicators, patterns, prices, profile, text
from tickloom.sources import candle_json, components, framed_log, pages, tables
from tickloom.sources.json_path import execute, parse
from tickloom.streaming import ticks as live

DAY = 86400


def candle_rows(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, i * 60, c, c, c, c, 1.0) for i, c in enumerate(map(float, closes))], "symbol string, t long, o double, h double, l double, c double, v double")


@pytest.fixture(scope="module")
def six(spark):
    """Six bars on three days: whole-range profile of a low of 98 and a high of 118."""
    rows = [("A", 0, 100.0, 105.0, 98.0, 103.0, 1000.0), ("A", 3600, 103.0, 108.0, 101.0, 106.0, 1200.0), ("A", DAY, 106.0, 110.0, 104.0, 108.0, 1500.0), ("A", DAY + 3600, 108.0, 112.0, 106.0, 110.0, 1800.0), ("A", 2 * DAY, 110.0, 115.0, 108.0, 113.0, 2000.0), ("A", 2 * DAY + 3600, 113.0, 118.0, 110.0, 116.0, 2200.0)]
    return spark.createDataFrame(rows, "symbol string, t long, o double, h double, l double, c double, v double")


def test_profile_keeps_all_volume(six):
    got = profile.volume_profile(six, 10).orderBy("level").collect()
    assert [r.level for r in got] == list(range(10)) and [r.price for r in got] == [98.0 + 2 * i for i in range(10)]
    assert math.isclose(sum(r.volume for r in got), 9700, rel_tol=1e-9)


def test_heatmap_windows(six):
    whole = {r.level: r.volume for r in profile.volume_profile(six, 10).collect()}
    three = {r.level: r.volume for r in profile.heatmap(six, 10, 24, 3).collect()}
    one = {r.level: r.volume for r in profile.heatmap(six, 10, 24, 0).collect()}
    assert three == whole == one  # a window of all pins is the whole profile
    two = profile.heatmap(six, 10, 24, 2).groupBy("window").agg(F.sum("volume").alias("v")).orderBy("window").collect()
    assert [round(r.v) for r in two] == [5500, 7500] or sum(r.v for r in two) == pytest.approx(1000 + 1200 + 2 * 3300 + 4200)
    assert profile.heatmap(six, 10, 24, 4).count() == 0
    with pytest.raises(ValueError):
        profile.volume_profile(six, 0)


def test_level_ranges():
    assert profile.grouped_levels(np.array([250, 550, 550, 1050, 1100, 1550, 1250, 1483.333333, 1183.333333, 733.333333])) == [(3, 5, 6), (7, 7, 9), (0, 1, 2)]
    assert profile.grouped_levels(np.array([0.0])) == [(0, 0, 0)]


def test_timelines(spark):
    volumes = {0: [5, 0, 3, 4, 4], 1: [0, 2, 2, 0, 1]}
    heat = spark.createDataFrame([("A", w, level, float(v)) for level, vs in volumes.items() for w, v in enumerate(vs)], "symbol string, window long, level long, volume double")
    ranges = spark.createDataFrame([("A", 0, 0, 0, 0), ("A", 1, 1, 1, 1)], "symbol string, range long, begin long, center long, end long")
    got = sorted((r.range, r.start, r.end) for r in profile.timelines(heat, ranges).collect())
    assert got == [(0, 2, 5), (1, 1, 3)]
    assert [r.intensity for r in profile.intensity(ranges).orderBy("range").collect()] == [1.0, 0.0]


CLOSES = [10, 11, 10.5, 11.5, 12, 11]


@pytest.mark.parametrize(("f", "column", "want"), [
    (lambda c: indicators.sma(c, 2), "sma", {1: 10.5, 2: 10.75, 3: 11.0, 4: 11.75, 5: 11.5}),
    (lambda c: indicators.wma(c, 2), "wma", {1: 10.666667, 2: 10.666667, 3: 11.166667, 4: 11.833333, 5: 11.333333}),
    (lambda c: indicators.ema_first(c, 2), "ema", {0: 10, 1: 10.666667, 2: 10.555556, 3: 11.185185, 4: 11.728395, 5: 11.242798}),
    (lambda c: indicators.ema_sma(c, 2), "ema", {1: 10.5, 2: 10.5, 3: 11.166667, 4: 11.722222, 5: 11.240741}),
    (lambda c: indicators.rsi(c, 2), "rsi", {3: 85.714286, 4: 90.909091, 5: 37.037037}),
])
def test_indicators(spark, f, column, want):
    got = {r.t // 60: r[column] for r in f(candle_rows(spark, CLOSES)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_rsi_without_losses(spark):
    assert {round(r.rsi, 4) for r in indicators.rsi(candle_rows(spark, range(10)), 3).collect()} == {99.0099}


@pytest.mark.parametrize("n", [9, 10, 30])
def test_rotation_against_itself(spark, n):
    c = candle_rows(spark, [100 + i % 7 for i in range(n)])
    got = indicators.relative_rotation(c, c, 3).collect()
    assert len(got) == max(n - 4 * 3 + 3, 0)
    assert all(math.isclose(r.ratio, 100) and math.isclose(r.momentum, 100) for r in got)


def test_registry(spark):
    c = candle_rows(spark, CLOSES)
    assert c.transform(indicators.indicator("MA", period=1)).where("sma is not null").count() == 6
    for name, parameters in (("nothing", {}), ("MA", {"wrong": 1})):
        with pytest.raises(ValueError):
            indicators.indicator(name, **parameters)


@pytest.mark.parametrize(("closes", "size", "last"), [([10, 20, 30, 40, 50], 2, 0), ([10, 50, 20, 15, 1, 1], 3, None), ([10, 40, 20, 30], 2, 0), ([20, 20, 20, 20], 2, 0)])
def test_pivots(spark, closes, size, last):
    c = candle_rows(spark, closes)
    got = {r.t // 60: r["rank"] for r in patterns.pivot_ranks(c, [size]).collect()}
    want = {i: sum(x > closes[i] for x in closes[max(0, i - size + 1) : i + 1]) for i in range(len(closes))}
    assert got == want and (last is None or got[len(closes) - 1] == last)
    every = {(r.t // 60, r.size): r["rank"] for r in patterns.pivot_ranks_all(c).collect()}
    assert every == {(i, s): sum(x > closes[i] for x in closes[max(0, i - s + 1) : i + 1]) for i in range(len(closes)) for s in range(len(closes) // 3 + 1)}


def test_pivot_sizes_over_half_have_no_rows(spark):
    assert patterns.pivot_ranks(candle_rows(spark, [1]), [2, 5]).count() == 0


def test_swings(spark):
    c = candle_rows(spark, [1, 3, 2, 5, 1, 2])
    assert sorted((r.i, r.high) for r in patterns.swings(c, 1).collect()) == [(1, True), (2, False), (3, True), (4, False)]
    assert patterns.swings(c, 0).count() == 6


def test_coverage(spark):
    t1, t2 = 1700000000, 1700604900
    fetched = spark.createDataFrame([("A", t1 - 1000, t2 + 1000)], "symbol string, start long, end long")
    asked = spark.createDataFrame([(1, "A", t1, t1 + 10), (2, "A", t1, t2), (3, "A", t1 - 2000, t2), (4, "B", t1, t2), (5, "A", t2, t2 + 1001)], "id long, symbol string, start long, end long")
    got = {r.id: r.hit for r in bars.coverage_of(asked, bars.coverage(fetched)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_stored_bars_win(spark):
    a, b = candle_rows(spark, [1, 2]), candle_rows(spark, [9, 9, 3])
    got = {r.t: r.c for r in bars.merged_bars(a, b).collect()}
    assert got == {0: 1.0, 60: 2.0, 120: 3.0}
    assert bars.merged_bars(bars.merged_bars(a, b), b).count() == 3


def test_vendor_layouts(spark):
    t = 1700000000
    rows = [
        ("ssi", '{"data":{"t":[%d,%d],"o":[1,2],"h":["3",4],"l":[0,1],"c":[2,3],"v":[10,20,30]}}' % (t, t + 1), [(t, 1.0, 3.0, 0.0, 2.0, 10.0), (t + 1, 2.0, 4.0, 1.0, 3.0, 20.0)]),
        ("binance", '[[%d,"1.5","2","1","1.8","7",9],[%d,"x","2","1","1.8",null]]' % (t * 1000, t * 1000 + 60000), [(t, 1.5, 2.0, 1.0, 1.8, 7.0), (t + 60, 0.0, 2.0, 1.0, 1.8, 0.0)]),
        ("vix", '{"d":[{"time":%d,"open":1,"high":2,"low":0.5,"close":1.5,"volume":3}]}' % t, [(t, 1.0, 2.0, 0.5, 1.5, 3.0)]),
        ("msn", '{"series":{"dataPoints":[[%d,1,2,0.5,1.5,3]]}}' % t, [(t, 1.0, 2.0, 0.5, 1.5, 3.0)]),
        ("yahoo", '{"chart":{"result":[{"timestamp":[%d],"indicators":{"quote":[{"open":[1],"high":[2],"low":[0.5],"close":[1.5],"volume":[3]}]}}]}}' % t, [(t, 1.0, 2.0, 0.5, 1.5, 3.0)]),
        ("dnse", '{"o":[1]}', []), ("dnse", "no json", []),
    ]
    for provider, payload, want in rows:
        got = candle_json.parse_candles(spark.createDataFrame([(payload,)], "payload string"), provider)
        assert sorted(tuple(r) for r in got.collect()) == want, provider
    many = spark.createDataFrame([(rows[0][1],)], "payload string")
    assert candle_json.parse_candles(many, "ssi", 1).count() == 1
    for bad in (("ssi", 1001), ("unknown", 0)):
        with pytest.raises(ValueError):
            candle_json.parse_candles(many, *bad)


@pytest.mark.parametrize(("doc", "path", "want"), [
    ('{"a":{"b":[{"c":1},{"c":2}]}}', "a.b[].c", ["1", "2"]), ('{"a":[[1,2],[3]]}', "a[][]", ["1", "2", "3"]), ('{"a":[{"x":1},{"y":2}]}', "a[].x", ["1"]),
    ('{"a b":{"k.1":5}}', '["a b"]["k.1"]', ["5"]), ("[1,2]", "[]", ["1", "2"]), ("[1,2]", "[1]", ["2"]), ('{"0":7}', "0", ["7"]), ('{"a":{"x":1,"y":2}}', "a[]", ["1", "2"]),
    ('{"Data":[{"n":1,"m":2,"o":3}]}', "Data[]{n,m}", ['{"m":2,"n":1}']), ("{}", "a.b", []), ("nope", "a", []), ('{"a":1}', "", ['{"a":1}']),
])
def test_json_paths(spark, doc, path, want):
    got = execute(spark.createDataFrame([(doc,)], "doc string"), "doc", path)
    assert sorted(r[0] for r in got.select(F.to_json("match")).collect()) == want


def test_json_path_errors():
    for bad in ("a[", "a[1", "a{x"):
        with pytest.raises(ValueError):
            parse(bad)


CASTS = [("3.5", "i64", None), ("-1", "u64", None), ('" 12 "', "i64", 12), ("true", "f64", 1.0), ('"on"', "bool", True), ("2", "bool", True), ("null", "bool", False), ("null", "string", "null"), ("2147483648", "i32", None), ('"x"', "bool", None), ("{}", "f64", None), ('"18446744073709551615"', "u64", 18446744073709551615)]


@pytest.mark.parametrize(("json", "kind", "want"), CASTS)
def test_strict_cast(spark, json, kind, want):
    assert spark.range(1).select(fn.strict_cast(F.parse_json(F.lit(json)), kind)).first()[0] == want


def test_price_texts(spark):
    rows = [("VÀNG 610 (lần 1)", "8.150", "8.350", "as is"), ("Nhẫn", "13.750", "liên hệ", "below 100000"), ("A/B  C", "82.500", "83.000", "always"), ("- Vàng", "", "", "as is")]
    df = spark.createDataFrame(rows, "name string, buy string, sell string, scale string")
    price = lambda c: fn.price_scale(fn.price_digits(F.col(c)), F.col("scale"))
    got = df.select(fn.clean_name(F.col("name")).alias("name"), price("buy").alias("buy"), price("sell").alias("sell"))
    got = got.where(fn.valid_price_row(F.col("name"), F.col("buy"), F.col("sell"), F.lit("either")))
    assert [tuple(r) for r in got.collect()] == [("VÀNG 610", 8150, 8350), ("Nhẫn", 13750000, None), ("A B C", 82500000, 83000000)]


TABLE = "<table class='x'><tr><th>Tên</th></tr></table><table class='gia'><tr><td>Loại vàng</td><td>Mua</td></tr><tr><td>Nhẫn <b>trơn</b></td><td>8.150</td><td>8.350</td></tr><tr><td></td><td>1</td></tr></table>"


def test_shop_pages(spark):
    landed = spark.createDataFrame([("a", 1, TABLE), ("b", 2, "<div class='r'><span data-v='7.000'></span></div>"), ("c", 3, None)], "store string, page_id long, html string")
    rules = [("a", "table", "gia", "tr", "td", "", 1, 2, 3, "", "always", "either", None, ""), ("b", "", "", "div", "span", "data-v", 1, 1, 1, "", "as is", "either", None, ""), ("c", "", "", "tr", "td", "", 1, 2, 3, "", "as is", "either", None, "")]
    got = pages.html_prices(landed, spark.createDataFrame(rules, pages.RULE)).orderBy("store").collect()
    assert [(r.store, r.name, r.buy, r.sell) for r in got] == [("a", "Nhẫn trơn", 8150000, 8350000), ("b", "7.000", 7000, 7000)]


SHOPS = {
    "spanned": ("<table><tr><th>a</th></tr><tr><td rowspan=2>Group</td><td>One</td><td>1.000</td><td>2.000</td></tr><tr><td>Two</td><td>3.000</td><td>4.000</td></tr></table>", ("table", "", "tr", "td", "", -3, -2, -1, "", "as is", "both", None, ""), [("One", 1000, 2000), ("Two", 3000, 4000)]),
    "paragraphs": ("<table><tr><td><p>One</p><p>Two</p></td><td>1.000<br>3.000</td><td><p>2.000</p><p>4.000</p></td></tr></table>", ("table", "", "tr", "td", "", 1, 2, 3, "", "as is", "both", None, "zip"), [("One", 1000, 2000), ("Two", 3000, 4000)]),
    "two names": ("<table><tr><td>Gold</td><td>24K</td><td>1.000</td><td>2.000</td></tr></table>", ("table", "", "tr", "td", "", 1, 3, 4, "", "as is", "both", 2, ""), [("Gold 24K", 1000, 2000)]),
    "lists": ("<ul><li>One</li><li>Two</li></ul><ul><li>1.000</li><li>3.000</li></ul><ul><li>2.000</li><li>4.000</li></ul>", ("", "", "ul", "li", "", 1, 2, 3, "", "as is", "both", None, "join"), [("One", 1000, 2000), ("Two", 3000, 4000)]),
    "prefix": ("<div id='gold_1'><p><b>One</b><b>1.000</b><b>2.000</b></p></div><div id='silver'><p><b>Two</b><b>3</b><b>4</b></p></div>", ("div", "id^=gold", "p", "b", "", 1, 2, 3, "", "as is", "both", None, ""), [("One", 1000, 2000)]),
    "style": ("<table><tr><td>No</td><td>1</td><td>2</td></tr></table><table style='color:red'><tr><td>One</td><td>1.000</td><td>2.000</td></tr></table>", ("table", "style*=red", "tr", "td", "", 1, 2, 3, "", "as is", "both", None, ""), [("One", 1000, 2000)]),
    "no sell": ("<table><tr><td>One</td><td>1.000</td></tr><tr><td>Note</td><td>0</td></tr></table>", ("table", "", "tr", "td", "", 1, 2, 3, "", "as is", "positive", None, ""), [("One", 1000, None)]),
}


def test_shop_page_variants(spark):
    landed = spark.createDataFrame([(s, 1, x[0]) for s, x in SHOPS.items()], "store string, page_id long, html string")
    rules = spark.createDataFrame([(s, *x[1]) for s, x in SHOPS.items()], pages.RULE)
    got = {}
    for r in pages.html_prices(landed, rules).orderBy("store", "row_no").collect():
        got.setdefault(r.store, []).append((r.name, r.buy, r.sell))
    assert got == {s: x[2] for s, x in SHOPS.items()}


def test_bank_rates(spark):
    body = '{"results":[{"result":{"data":{"dsr":{"DS":[{"PH":[{"DM1":[{"C":["A","1","2","3","4","5"]},{"C":["B","1","2","3"],"R":2},{"C":["C",null,"2","3","4","5"]},{"C":[]}]}]}]}}}}]}'
    got = [tuple(r)[:6] for r in pages.bank_rates(spark.createDataFrame([(body,)], "payload string")).collect()]
    assert got == [("A", "1", "2", "3", "4", "5"), ("B", "1", "2", "3", "N/A", "N/A"), ("C", "", "2", "3", "4", "5")]


def test_framed_log(spark, tmp_path):
    records = [b"Message-1", b"Message-2-Longer", b"Msg-3"]
    data = b"".join(struct.pack("<I", len(r)) + r for r in records)
    assert [(a, p) for a, _, p in framed_log.frames(data)] == [(0, records[0]), (13, records[1]), (33, records[2])]
    assert [p for _, _, p in framed_log.frames(data[:-1], 13)] == [records[1]]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_bytes(data)
    got = framed_log.read_log(spark, str(tmp_path / "log"), 13).collect()
    assert [(r.offset, r.next_offset, bytes(r.payload)) for r in got] == [(13, 33, records[1]), (33, 42, records[2])]
    split = framed_log.read_log(spark, str(tmp_path / "log"), 0, split=10).collect()
    assert sorted((r.offset, bytes(r.payload)) for r in split) == [(0, records[0]), (13, records[1]), (33, records[2])]
    out = f"file://{tmp_path}/out"
    components.write_log(spark.createDataFrame([*((r,) for r in records), (None,)], "payload binary"), out)
    assert sorted(bytes(r.payload) for r in framed_log.read_log(spark, out).collect()) == sorted(records)
    assert framed_log.rotate(out, 100)
    components.write_log(spark.createDataFrame([(b"",)], "payload binary"), out)
    assert framed_log.remove_expired(spark, out, 100) == []
    assert framed_log.remove_expired(spark, out, 101)
    assert [bytes(r.payload) for r in framed_log.read_log(spark, out).collect()] == [b""]
    parts = spark.createDataFrame([("x.100",), ("x.200",), ("x",)], "path string")
    assert [r.path for r in framed_log.expired(parts, 150).collect()] == ["x.100"]


def test_dynamic_tables(spark):
    schema = [("id", "i64"), ("name", "string"), ("value", "i64")]
    bodies = spark.createDataFrame([(1, '{"id":1,"name":"test_row","value":42}'), (2, '{"id":"2"}'), (3, '{"other":1}'), (4, "no"), (5, '{"id":5,"name":7}')], "n long, body string")
    good, bad = tables.checked(bodies, schema)
    assert [tuple(r) for r in good.collect()] == [(1, 1, "test_row", 42)]
    assert {r.n: r.reason for r in bad.collect()} == {2: "column id is not i64", 3: "no column", 4: "no JSON", 5: "column name is not string"}
    page = tables.read_page(good.drop("n"), schema, 0, 10).first()
    assert (page.id, page.name, page.value) == ([1], ["test_row"], [42])
    assert tables.read_page(good.drop("n"), schema, 9999, 10).first().id == []


NAMES = ["hello", "world", "help", "tiem vang", "tiem bac", "Hà Nội", "Sài Gòn", *(f"item_{i}" for i in range(10))]


@pytest.mark.parametrize(("query", "limit", "want"), [("hel", 20, [0, 2]), ("o", 20, [0, 1]), ("TIEM", 20, [3, 4]), ("hà", 20, [5]), ("item", 3, [7, 8, 9]), ("zzz", 20, []), ("", 20, []), ("lo", 20, [0])])
def test_substring_search(spark, query, limit, want):
    names = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    assert [r.id for r in text.substring_search(names, asked, limit).orderBy("rank").collect()] == want


PATTERNS = [(["he", "she", "his", "hers"], "ushers", ["he", "she", "hers"]), (["CG", "TGC", "CGT", "GCC"], "ATGCGA", ["CG", "TGC"]), (["ư", "ới"], "người", ["ư"]), (["", "a", "a"], "b", []), (["ới"], "mới", ["ới"])]


@pytest.mark.parametrize(("patterns", "sample", "want"), PATTERNS)
def test_keywords(spark, patterns, sample, want):
    df = spark.createDataFrame([(sample,), (None,)], "s string")
    got = df.select(text.keywords(F.col("s"), patterns), text.many_keywords(patterns)(F.col("s")), text.token_matcher(patterns)(F.col("s"))).collect()
    assert list(got[0][0]) == want and got[0][1] == bool(want) and sorted(got[0][2]) == sorted(want)
    assert got[1][1] is False and got[1][2] == []


def test_as_of_and_board(spark):
    history = spark.createDataFrame([(1, 1, 10.0, 11.0, 0, 1), (1, 1, 12.0, 13.0, DAY, 2), (1, 1, 15.0, 16.0, DAY, 3), (2, 1, 1.0, 1.0, 0, 4)], "symbol_id long, product_id long, buy double, sell double, ts long, id long")
    current = spark.createDataFrame([(1, 20.0, 22.0, 2 * DAY), (3, 5.0, 5.0, 0)], "product_id long, buy double, sell double, ts long")
    got = {r.product_id: (r.buy_diff, r.sell_diff) for r in prices.as_of(current, history.where("symbol_id = 1"), DAY).collect()}
    assert got == {1: (5.0, 6.0), 3: (0.0, 0.0)}
    assert all(r.buy_diff is None for r in prices.as_of(current, history, None).collect())
    board = {r.symbol_id: r for r in prices.market_board(prices.bucket_last(history)).collect()}
    assert (board[1].sell, board[1].yesterday, board[1].diff, list(board[1].trend)) == (16.0, 11.0, 5.0, [11.0, 16.0])
    assert (board[2].yesterday, board[2].diff, board[2].trend_pct) == (None, 0.0, 0.0)


def test_ingest_moves_time_only_with_the_price(spark):
    kinds = "product_id long, buy double, sell double, ts long"
    current = spark.createDataFrame([(1, 1.0, 2.0, 5), (2, 3.0, 4.0, 5)], kinds)
    events = spark.createDataFrame([(1, 1.0, 2.0, 9, 1), (2, 9.0, 9.0, 7, 2), (2, 3.5, 4.0, 8, 3), (4, 1.0, 1.0, 9, 4)], f"{kinds}, id long")
    assert sorted(tuple(r) for r in prices.ingest(current, events).collect()) == [(1, 1.0, 2.0, 5), (2, 3.5, 4.0, 8), (4, 1.0, 1.0, 9)]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, kind string")
    batch = spark.createDataFrame([(2, "old", "z", 1), (2, "new", "z", 2), (3, "c", "w", 1)], "id long, name string, kind string, seq long")
    assert sorted(tuple(r) for r in dims.upsert(target, batch, ["id"], ["name"], "seq").collect()) == [(1, "a", "x"), (2, "new", "y"), (3, "c", "w")]


def test_fan_out(spark):
    seen = []

    def broken(batch, epoch):
        raise OSError("down")

    batch = spark.range(3)
    live.fan_out({"a": lambda b, n: seen.append(b.count()), "b": broken})(batch, 0)
    assert seen == [3]
    with pytest.raises(RuntimeError):
        live.fan_out({"b": broken})(batch, 0)


def test_results_do_not_depend_on_partitions(spark, six):
    for f in (lambda c: profile.heatmap(c, 10, 24, 2), lambda c: indicators.macd(c, 1, 2, 2), lambda c: patterns.swings(c, 1)):
        a, b = (sorted(map(str, f(c).collect())) for c in (six, six.orderBy(F.desc("t")).repartition(5)))
        assert a == b


def test_series_across_batches(spark):
    """Series that end within a batch, or go on over several, are followed alike."""
    rows = [(s, i * 60, float((i * 7 + len(s)) % 11)) for s in ("A", "BB", "CCC") for i in range(17)] + [(None, i, float(i)) for i in range(5)]
    c = spark.createDataFrame(rows, "symbol string, t long, c double").coalesce(1)
    whole = sorted(map(str, indicators.rsi(c, 2).collect())), sorted(map(str, indicators.ema_first(c, 3).collect()))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 4)
    try:
        cut = sorted(map(str, indicators.rsi(c, 2).collect())), sorted(map(str, indicators.ema_first(c, 3).collect()))
    finally:
        spark.conf.unset(size)
    assert whole == cut and len(whole[1]) == len(rows)


def test_console_and_discard(spark):
    rows = spark.range(5)
    assert tables.discard(rows) == 5
    assert tables.discard(rows.where("id < 0")) == 0
    tables.console(rows, "row: ", 3)


def test_ingest_takes_batches_in_any_order(spark):
    """Of events of one time the greater id counts, though it comes a batch earlier; a null price is a price."""
    kinds = "product_id long, buy double, sell double, ts long, id long"
    rows = [(1, 1.0, 2.0, 5, 9), (1, 3.0, 4.0, 5, 8), (1, 3.0, 4.0, 6, 1), (1, 8.0, 8.0, 4, 99), (2, 1.0, 1.0, 3, 1), (2, None, 1.0, 4, 1), (2, 7.0, 7.0, 4, 0)]
    for order in ([0, 1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1, 0], [2, 0, 5, 6, 3, 1, 4]):
        current = spark.createDataFrame([], "product_id long, buy double, sell double, ts long, last_ts long, last_id long")
        for k in order:
            current = spark.createDataFrame(prices.ingest(current, spark.createDataFrame([rows[k]], kinds)).collect(), current.schema)
        assert sorted((r.product_id, r.buy, r.sell, r.last_ts, r.last_id) for r in current.collect()) == [(1, 3.0, 4.0, 6, 1), (2, None, 1.0, 4, 1)]


def test_upsert_keeps_rows_that_tie(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, kind string")
    batch = spark.createDataFrame([(2, "one", "z", 2), (2, "two", "w", 2), (2, "old", "z", 1)], "id long, name string, kind string, seq long")
    assert sorted(tuple(r) for r in dims.upsert(target, batch, ["id"], ["name"], "seq").collect()) == [(1, "a", "x"), (2, "one", "y"), (2, "two", "y")]


def test_latest_report_is_whole(spark):
    rates = spark.range(1300).selectExpr("id % 650 AS bank", "'online' AS channel", "date '2001-08-01' AS day", "id").union(spark.sql("SELECT 1L, 'online', date '2001-07-31', -1L"))
    got = [(r.bank, r.id) for r in dims.latest_report(rates).collect()]
    assert got == sorted((k % 650, k) for k in range(1300)) and [(r.bank, r.id) for r in dims.latest_report(rates, limit=7).collect()] == got[:7]
