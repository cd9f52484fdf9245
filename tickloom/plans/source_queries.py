"""Queries that land the given tables as vendors, shops and logs would send them, and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import scalars as fn
from ..operators import text
from ..sources import candle_json, framed_log, pages, tables
from ..sources import components as parts
from ..sources.json_path import execute
from ..storage import scratch
from ..views import CANDLES, PRICES, TICKS, candles_sql
from .registry import query


def column_document(candles: DataFrame, wrap: str) -> DataFrame:
    """symbol, payload: one document of six lists for each series."""
    x = F.array_sort(F.collect_list(F.struct("t", "o", "h", "l", "c", "v")))
    lists = F.to_json(F.struct(*(F.col("x")[c].alias(c) for c in "tohlcv")))
    return candles.groupBy("symbol").agg(x.alias("x")).select("symbol", F.format_string(wrap, lists).alias("payload"))


def row_document(candles: DataFrame, wrap: str) -> DataFrame:
    """symbol, payload: one document of rows for each series, times in milliseconds, prices as texts."""
    x = F.array_sort(F.collect_list(F.struct((F.col("t") * 1000).alias("t"), *(F.col(c).cast("string").alias(c) for c in "ohlcv"))))
    rows = F.transform("x", lambda r: F.format_string('[%d,"%s","%s","%s","%s",%s]', *(r[c] for c in "tohlcv")))
    return candles.groupBy("symbol").agg(x.alias("x")).select("symbol", F.format_string(wrap, F.array_join(rows, ",")).alias("payload"))


@query(f"""WITH {TICKS}, {candles_sql()}, {candles_sql("u", key="user_id")}
    SELECT 'ssi' AS provider, symbol, t, o, h, l, c, v FROM candles UNION ALL SELECT 'binance', symbol, t, o, h, l, c, v FROM u""")
def src_candle_json(spark, d):
    wide = candle_json.parse_candles(column_document(views.candles(spark, d), '{"data":%s}'), "ssi")
    rows = candle_json.parse_candles(row_document(views.candles(spark, d, key="user_id"), "[%s]"), "binance")
    columns = ("symbol", "t", "o", "h", "l", "c", "v")
    both = [df.select(F.lit(n).alias("provider"), *columns) for n, df in (("ssi", wide), ("binance", rows))]
    return reduce(DataFrame.unionByName, both)


@query(f"{CANDLES} SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS pos, c AS value FROM candles")
def src_json_path(spark, d):
    docs = column_document(views.candles(spark, d), '{"data":[%s]}')
    found = execute(docs, "payload", "data[0].c[]")
    return found.select("symbol", F.col("match_pos")[0].cast("long").alias("pos"), F.try_variant_get("match", "$", "double").alias("value"))


@query(f"""{PRICES} SELECT CAST(store_id AS VARCHAR) AS store, 'N' || product_id AS name, CAST(floor(buy) + 1 AS BIGINT) AS buy, CAST(floor(sell) + 1 AS BIGINT) AS sell FROM bridge JOIN current USING (product_id)""")
def src_html_price_table(spark, d):
    """Shops of six kinds: plain tables; names that span rows; lists in paragraphs of one row; rows named by two cells in a table with a style; the one of two plain tables that has a text, or a header."""
    rows = views.bridge(spark, d).join(views.price_current(spark, d), "product_id")
    money = lambda c: F.format_number(F.floor(c) + 1, 0)
    kind, name = F.col("store_id") % 6, F.concat(F.lit("N"), F.col("product_id").cast("string"))
    own = F.struct("product_id", name.alias("name"), money("buy").alias("buy"), money("sell").alias("sell"), (F.row_number().over(Window.partitionBy("store_id").orderBy("product_id")) % 3).alias("n"))
    shops = rows.select("store_id", kind.alias("kind"), own.alias("r")).groupBy("store_id", "kind").agg(F.array_sort(F.collect_list("r")).alias("r"))
    each = lambda form, *of: F.array_join(F.transform("r", lambda x: F.format_string(form, *(x[c] for c in of))), "")
    spanned = F.array_join(F.transform("r", lambda x: F.format_string("<tr>%s<td>%s</td><td>%s</td><td>%s</td></tr>", F.when(x["n"] == 1, '<td rowspan="3">Gold</td>').otherwise(""), x["name"], x["buy"], x["sell"])), "")
    body = F.when(F.col("kind") == 0, F.concat(F.lit('<table class="big price"><tr><th>Name</th><th>Buy</th><th>Sell</th></tr>'), each("<tr><td>%s</td><td>%s</td><td><b>%s</b></td></tr>", "name", "buy", "sell"), F.lit("</table>")))
    body = body.when(F.col("kind") == 1, F.concat(F.lit("<table>"), spanned, F.lit("</table>")))
    body = body.when(F.col("kind") == 2, F.concat(F.lit("<table><tr><td>"), each("<p>%s</p>", "name"), F.lit("</td><td>"), each("<p>%s</p>", "buy"), F.lit("</td><td>"), each("<p>%s</p>", "sell"), F.lit("</td></tr></table>")))
    other = F.lit("<table><tr><th>City</th><th>Rain</th><th>Sun</th></tr><tr><td>Huế</td><td>1,000</td><td>2,000</td></tr></table>")
    plain = F.concat(F.lit("<tr><th>Loại vàng</th><th>Mua</th><th>Bán</th></tr>"), each("<tr><td>%s</td><td>%s</td><td>%s</td></tr>", "name", "buy", "sell"), F.lit("</table>"))
    body = body.when(F.col("kind") >= 4, F.concat(other, F.lit("<table><tr><td>"), other, F.lit("</td></tr></table><table>"), plain, other))
    body = body.otherwise(F.concat(F.lit('<table style="width:50%"><tr><td>x</td></tr></table><table style="color:red;width:99%">'), each("<tr><td>N</td><td>%s</td><td>%s</td><td>%s</td></tr>", "product_id", "buy", "sell"), F.lit("</table>")))
    landed = shops.select(F.col("store_id").cast("string").alias("store"), F.lit(0).alias("page_id"), F.concat(F.lit("<html><body><h1>Prices</h1>"), body, F.lit("</body></html>")).alias("html"))
    whole = F.struct(*(F.lit(x).cast(t).alias(c) for c, t, x in (("table", "string", "table"), ("row", "string", "tr"), ("cell", "string", "td"), ("attribute", "string", ""), ("digits", "string", "all"), ("scale", "string", "unit"), ("valid", "string", "both"))))
    places = F.when(kind == 3, F.struct(F.lit("style*=99%").alias("class"), F.lit(1).alias("name_at"), F.lit(2).alias("also_at"), F.lit("").alias("lines"))).otherwise(
        F.struct(F.when(kind == 0, "price").when(kind == 4, "text~=LOẠI vàng").when(kind == 5, "header~=Mua,Bán").otherwise("").alias("class"), F.lit(-3).alias("name_at"), F.lit(None).cast("int").alias("also_at"), F.when(kind == 2, "zip").otherwise("").alias("lines"))
    )
    rules = rows.select("store_id").distinct().select(F.col("store_id").cast("string").alias("store"), whole.alias("w"), places.alias("p")).select("store", "w.*", "p.*", F.lit(-2).alias("buy_at"), F.lit(-1).alias("sell_at"))
    found = pages.html_prices(landed, rules)
    return found.select("store", F.replace("name", F.lit("N "), F.lit("N")).alias("name"), "buy", "sell")


def price_lists(spark, d) -> DataFrame:
    """store, payload: a JSON list of the current prices for each store; odd stores call their fields otherwise."""
    rows = views.bridge(spark, d).join(views.price_current(spark, d), "product_id")
    plain = F.struct(F.col("symbol_id").cast("string").alias("code"), F.col("buy").alias("mua"), F.col("sell").alias("ban"), F.when(F.col("symbol_id") % 4 == 0, "b2").otherwise("b1").alias("branch"))
    return rows.groupBy(F.col("store_id").alias("store")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(plain)).alias("list"))).alias("payload"))


@query(f"{PRICES} SELECT store_id AS store, CASE WHEN symbol_id % 2 = 0 THEN 'Gold ' || symbol_id ELSE CAST(symbol_id AS VARCHAR) END AS name, buy, sell FROM bridge JOIN current USING (product_id) WHERE symbol_id % 4 > 0")
def src_json_price_list(spark, d):
    names = views.bridge(spark, d).where("symbol_id % 2 = 0").select(F.col("symbol_id").cast("string").alias("code")).distinct().withColumn("name", F.concat(F.lit("Gold "), "code"))
    return pages.json_prices(price_lists(spark, d), ("code", "mua", "ban"), "$.list", names, ("branch", "b1"))


@query(f"""{PRICES} SELECT 'Name ' || product_id AS name, CAST(floor(buy * 100) AS BIGINT) AS buy, CAST(floor(sell * 100) AS BIGINT) AS sell, 'up' AS trend FROM current WHERE product_id % 3 > 0""")
def src_text_price_record(spark, d):
    p = views.price_current(spark, d)
    money = lambda c: F.format_number(F.floor(F.col(c) * 100), 0)
    records = p.select(F.concat_ws("\n", F.col("product_id").cast("string"), F.lit("  "), money("buy"), money("sell"), F.lit("up "), F.lit("")).alias("text"))
    short = p.select(F.concat_ws("\n", F.col("product_id").cast("string"), money("buy")).alias("text"))
    names = p.where("product_id % 3 > 0").select(F.col("product_id").cast("string").alias("code"), F.concat(F.lit("Name "), F.col("product_id").cast("string")).alias("name"))
    return pages.text_prices(records.unionByName(short), names)


@query("""WITH r AS (SELECT s_name AS bank, s_suppkey AS k, s_acctbal AS b FROM supplier WHERE s_suppkey % 7 > 0) SELECT bank, CASE WHEN k % 2 = 0 THEN '' ELSE CAST(k % 900 AS VARCHAR) || '.25' END AS rate_1, '5.1' AS rate_3, '6' AS rate_6,
    CASE WHEN k % 3 = 0 THEN '7.5' WHEN k % 3 = 1 THEN 'N/A' ELSE '' END AS rate_9, CASE WHEN k % 3 = 0 THEN 'x' WHEN k % 3 = 1 THEN 'N/A' ELSE '' END AS rate_12,
    CASE WHEN k % 2 = 1 THEN k % 900 + 0.25::DOUBLE END AS rate_1_num, 5.1::DOUBLE AS rate_3_num, 6::DOUBLE AS rate_6_num, CASE WHEN k % 3 = 0 THEN 7.5::DOUBLE END AS rate_9_num, NULL::DOUBLE AS rate_12_num FROM r""")
def src_bank_rate_json(spark, d):
    s, k = views.table(spark, d, "supplier"), F.col("s_suppkey")
    first = F.when(k % 2 == 0, "null").otherwise(F.format_string('"%d.25"', k % 900))
    rest = F.when(k % 3 == 0, ',"7.5","x"').otherwise("")
    cells = F.when(k % 7 == 0, "[]").otherwise(F.concat(F.lit('["'), "s_name", F.lit('",'), first, F.lit(',"5.1","6"'), rest, F.lit("]")))
    entry = F.format_string('{"C":%s,"R":%d}', cells, F.when(k % 3 == 1, 2).otherwise(0))
    body = F.concat(F.lit('{"results":[{"result":{"data":{"dsr":{"DS":[{"PH":[{"DM1":['), entry, F.lit("]}]}]}}}}]}"))
    return pages.bank_rates(s.select(body.alias("payload")))


@query("SELECT o_orderkey AS id, n_name AS code, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS sell, CAST(CAST(floor(o_totalprice / 2) AS BIGINT) AS VARCHAR) AS cash FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def src_fx_json(spark, d):
    o = views.table(spark, d, "orders").withColumn("n_nationkey", (F.col("o_custkey") % 25).cast("int")).join(views.table(spark, d, "nation"), "n_nationkey")
    sell, cash = F.floor("o_totalprice"), F.floor(F.col("o_totalprice") / 2)
    body = F.to_json(F.struct(F.array(F.struct(F.col("n_name").alias("currencyCode"), sell.cast("string").alias("sell"), cash.cast("string").alias("cash"))).alias("Data")))
    return pages.fx_rates(o.select(F.col("o_orderkey").alias("id"), body.alias("payload")))


@query("SELECT p_brand AS index, p_name || ' ' || p_partkey AS symbol FROM part WHERE p_brand < 'Brand#2' OR p_size > 10")
def src_index_members(spark, d):
    p = views.table(spark, d, "part").withColumn("symbol", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).withColumnRenamed("p_brand", "index")
    local = p.where("index < 'Brand#2'").select("index", "symbol")
    landed = p.where("index < 'Brand#2' or p_size > 10").groupBy("index").agg(F.to_json(F.collect_list("symbol")).alias("payload"))
    return pages.index_members(landed, local)


def log_rows(spark, d) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.select(F.to_json(F.struct("event_id", "event_type", "value")).alias("payload"))


def written_log(spark, d) -> str:
    path = scratch(spark, "log")
    parts.write_log(log_rows(spark, d), path)
    return path


LOGGED = "SELECT event_id, event_type, value FROM events"


def told(rows: DataFrame) -> DataFrame:
    v = F.from_json(F.col("payload").cast("string"), "event_id long, event_type string, value double")
    return rows.select(v.alias("v")).select("v.*")


@query(LOGGED)
def src_framed_log(spark, d):
    return told(framed_log.read_log(spark, written_log(spark, d)))


@query("SELECT count(*) AS records FROM events")
def snk_framed_log(spark, d):
    return framed_log.read_log(spark, written_log(spark, d)).agg(F.count("*").alias("records"))


@query(LOGGED)
def udf_custom_component(spark, d):
    parts.register(spark)
    return told(spark.read.format("framed_log").option("path", written_log(spark, d)).load())


@query(LOGGED)
def src_framed_log_tail(spark, d):
    """A log that grows and is rotated while it is followed: three runs of one stream, each going on from the last one's checkpoint."""
    parts.register(spark)
    path, out, rows = scratch(spark, "tail"), scratch(spark, "followed"), log_rows(spark, d)
    part = F.get_json_object("payload", "$.event_id").cast("long") % 3
    for i in range(3):
        parts.write_log(rows.where(part == i), path)
        if i == 1:
            framed_log.rotate(path, 1700000000)
        tail = spark.readStream.format("framed_log").option("path", path).load()
        tail.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return told(spark.read.parquet(out))


@parts.transform("doubled")
def doubled(column: str):
    return lambda df: df.withColumn(column, F.col(column) * 2)


@query("SELECT event_id, event_type, value * 2 AS value FROM events")
def udf_custom_sink(spark, d):
    """A transform by name and a sink of our own, read back."""
    parts.register(spark)
    path = scratch(spark, "sink")
    rows = views.table(spark, d, "events").select("event_id", "event_type", "value").transform(parts.TRANSFORMS["doubled"]("value"))
    rows.write.format("json_lines_sink").mode("append").option("path", path).save()
    return spark.read.schema("event_id long, event_type string, value double").json(path)


@query(LOGGED + " WHERE event_id % 3 > 0")
def snk_log_rotation(spark, d):
    """A log written in three parts, two of them rotated; the older goes."""
    path, rows = scratch(spark, "rotated"), log_rows(spark, d)
    part = F.get_json_object("payload", "$.event_id").cast("long") % 3
    for i, epoch in ((0, 1700000000), (1, 1700086400), (2, None)):
        parts.write_log(rows.where(part == i), path)
        if epoch:
            framed_log.rotate(path, epoch)
    framed_log.remove_expired(spark, path, 1700086400)
    return told(framed_log.read_log(spark, path))


@query(LOGGED)
def snk_jsonl(spark, d):
    path = scratch(spark, "lines")
    tables.append_json_lines(views.table(spark, d, "events").select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id long, event_type string, value double").json(path)


@query("SELECT count(*) AS rows_sent FROM events")
def snk_console_noop(spark, d):
    return spark.createDataFrame([(tables.discard(views.table(spark, d, "events")),)], "rows_sent long")


MONTHS = "SELECT l_orderkey, l_linenumber, l_extendedprice, strftime(l_shipdate, '%Y%m') AS month FROM lineitem"


def monthly(spark, d) -> str:
    path = scratch(spark, "monthly")
    rows = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_shipdate").alias("created_at"))
    tables.write_monthly(rows, path)
    return path


@query(f"SELECT month, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM ({MONTHS}) GROUP BY month")
def snk_partition_monthly(spark, d):
    rows = spark.read.parquet(monthly(spark, d))
    return rows.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(f"SELECT month, count(*) AS n FROM ({MONTHS}) WHERE month >= '199901' GROUP BY month")
def snk_retention(spark, d):
    rows = tables.retained(spark, monthly(spark, d), "199901")
    return rows.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"))


BODY_SCHEMA = [("id", "i64"), ("kind", "string"), ("k", "i32")]


def bodies(spark, d) -> DataFrame:
    e, k = views.table(spark, d, "events"), F.col("event_id")
    value = F.when(k % 5 == 0, F.lit('"5"')).when(k % 5 == 1, F.lit("3000000000")).otherwise(F.get_json_object("props", "$.k"))
    return e.select("event_id", F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"kind":"'), "event_type", F.lit('","extra":[1],"k":'), value, F.lit("}")).alias("body"))


@query("""SELECT event_id, CASE WHEN event_id % 5 > 1 THEN event_id END AS id, CASE WHEN event_id % 5 > 1 THEN event_type END AS kind, CASE WHEN event_id % 5 > 1 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
    CASE WHEN event_id % 5 <= 1 THEN 'column k is not i32' END AS reason FROM events""")
def io_dynamic_table_write(spark, d):
    good, bad = tables.checked(bodies(spark, d), BODY_SCHEMA)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.drop("body"), allowMissingColumns=True)


@query("SELECT list(event_id ORDER BY event_id) AS id, list(event_type ORDER BY event_id) AS kind FROM (SELECT event_id, event_type FROM events WHERE event_id % 5 > 1 AND event_id > 100 ORDER BY event_id LIMIT 20)")
def io_dynamic_table_read(spark, d):
    good, _ = tables.checked(bodies(spark, d), BODY_SCHEMA)
    return tables.read_page(good.select("id", "kind"), BODY_SCHEMA[:2], 100, 20)


RAW = "SELECT *, row_number() OVER (PARTITION BY store, name ORDER BY row_no) AS n FROM (SELECT l_suppkey AS store, 'P' || l_partkey % 9 AS name, l_orderkey * 8 + l_linenumber AS row_no FROM lineitem)"


@query(f"SELECT store, name, min(row_no) AS row_no FROM ({RAW}) WHERE n = 1 GROUP BY ALL")
def win_price_dedup(spark, d):
    li = views.table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("store"), F.concat(F.lit("P"), (F.col("l_partkey") % 9).cast("string")).alias("name"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"))
    return pages.price_dedup(rows, ["store", "name"])


@query(f"{PRICES} SELECT store_id, product_name, buy, CASE WHEN store_id % 2 = 0 THEN sell END AS sell FROM bridge JOIN current USING (product_id)")
def set_store_union(spark, d):
    rows = views.bridge(spark, d).join(views.price_current(spark, d), "product_id").select("store_id", "product_name", "buy", "sell")
    lists = [rows.where("store_id % 2 = 0"), rows.where("store_id % 2 = 1").drop("sell"), rows.where("store_id < 0")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


@query("""WITH r AS (SELECT o_orderkey, p_name || ' item' AS name, CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS buy, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 4 AS BIGINT) END AS sell,
        ['either', 'positive', 'both'][1 + o_orderkey % 3] AS rule, o_orderkey % 11 = 0 AS head FROM orders JOIN part ON p_partkey = o_custkey % 50)
    SELECT o_orderkey, CASE rule WHEN 'both' THEN buy IS NOT NULL AND sell IS NOT NULL WHEN 'positive' THEN coalesce(greatest(buy, sell) > 0, false) ELSE coalesce(buy, sell) IS NOT NULL END AND NOT head AS ok FROM r""")
def flt_price_row_valid(spark, d):
    k = F.col("o_orderkey")
    o = views.table(spark, d, "orders").withColumn("p_partkey", F.col("o_custkey") % 50).join(views.table(spark, d, "part"), "p_partkey")
    name = F.when(k % 11 == 0, "Loại vàng").otherwise(F.concat("p_name", F.lit(" item")))
    buy, sell = F.when(k % 3 > 0, F.floor("o_totalprice")), F.when(k % 5 > 0, k % 4)
    rule = F.element_at(F.array(*map(F.lit, ("either", "positive", "both"))), (k % 3 + 1).cast("int"))
    return o.select("o_orderkey", fn.valid_price_row(name, buy, sell, rule).alias("ok"))


@query("""WITH b AS (SELECT user_id AS batch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, upper(substr(event_type, 1, 3)) AS symbol, CAST(event_id % 90 + 10 AS INTEGER) AS index, CAST(CAST(round(value * 10) AS BIGINT) AS DOUBLE) AS change, event_id % 6 AS bad FROM events)
    SELECT batch, symbol, list({'index': index, 'change': change} ORDER BY pos, index, change) AS changes FROM b WHERE bad > 0 GROUP BY batch, symbol""")
def agg_delta_by_symbol(spark, d):
    e = views.table(spark, d, "events")
    cell = F.concat(F.upper(F.substring("event_type", 1, 3)), (F.col("event_id") % 90 + 10).cast("string"))
    told_ = F.concat(F.lit("+"), F.round(F.col("value") * 10).cast("long").cast("string"), F.lit("%"))
    row = F.when(F.col("event_id") % 6 > 0, F.array(cell, told_, F.lit("x"))).otherwise(F.array(cell, told_))
    g = e.groupBy(F.col("user_id").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("event_id", row.alias("row")))).alias("x"))
    return pages.deltas(g.select("batch", F.to_json(F.transform("x", lambda x: x["row"])).alias("payload")))


PATTERNS = ["theand", "ñ", "token", "über", "the", "", "the", "%%%"]


@query("SELECT doc_id, list_filter(['theand', 'ñ', 'token', 'über', 'the', '%%%'], lambda p: contains(text, p)) AS found, len(list_filter(['theand', 'ñ', 'token', 'über', 'the', '%%%'], lambda p: contains(text, p))) > 0 AS hit FROM documents")
def txt_keyword_match(spark, d):
    t = F.col("text")
    return views.table(spark, d, "documents").select("doc_id", text.keywords(t, PATTERNS).alias("found"), text.has_keyword(t, PATTERNS).alias("hit"))


@query("SELECT doc_id, regexp_matches(text, 'theand|ñ|token|über|%%%') AS hit FROM documents")
def txt_keyword_many(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.many_keywords(["theand", "ñ", "token", "über", "%%%"])(F.col("text")).alias("hit"))


@query("SELECT p_partkey, list_filter(['red', 'widget', 'small ring'], lambda p: contains(' ' || p_name || ' ', ' ' || p || ' ')) AS found FROM part")
def udf_token_matcher(spark, d):
    match = text.token_matcher(["red", "widget", "small ring"], split=str.split)
    return views.table(spark, d, "part").select("p_partkey", match(F.col("p_name")).alias("found"))


@query("""WITH q AS (SELECT n_nationkey AS query_id, substr(n_name, 1 + n_nationkey % 5, 1 + n_nationkey % 7) AS query FROM nation UNION ALL SELECT 100 + p_partkey, substr(p_name, 2, 4) FROM part WHERE p_partkey % 100 = 0),
    names AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_brand) AS name FROM part), h AS (SELECT DISTINCT query_id, id FROM q JOIN names ON contains(name, lower(query)) WHERE query <> '')
    SELECT CAST(query_id AS BIGINT) AS query_id, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM h) WHERE rank <= 20""")
def txt_substring_search(spark, d):
    n, p = views.table(spark, d, "nation"), views.table(spark, d, "part")
    k = F.col("n_nationkey")
    asked = n.select(k.cast("long").alias("query_id"), F.substring(F.col("n_name"), 1 + k % 5, 1 + k % 7).alias("query"))
    more = p.where("p_partkey % 100 = 0").select((100 + F.col("p_partkey")).alias("query_id"), F.substring("p_name", 2, 4).alias("query"))
    return text.substring_search(p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name")), asked.unionByName(more))
