"""Queries over prices and their dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import dimensions as dims
from ..operators import prices
from ..sources import history
from ..sources.snapshots import Snapshot
from ..storage import scratch
from ..views import BRIDGE, HISTORY_ORDER, PRICES, TICKS
from .registry import query

START, END, CUT = 820454400, 915148800, 946684800
SYMBOLS = "symbols AS (SELECT DISTINCT symbol_id, 'SYM' || symbol_id AS symbol FROM bridge)"


def symbols(spark, d):
    return views.bridge(spark, d).select("symbol_id", F.concat(F.lit("SYM"), F.col("symbol_id").cast("string")).alias("symbol")).distinct()


BROKERS = "brokers AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey // 3 END AS alias FROM supplier)"
LIMITS = """limits AS (SELECT s_suppkey AS broker_id, CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS guest_invisible,
    CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 7 * 30 END AS guest_max_history_days FROM supplier WHERE s_suppkey % 4 < 3)"""


def brokers(spark, d):
    s = views.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.floor(F.col("s_suppkey") / 3)).alias("alias"))


def limits(spark, d):
    s, k = views.table(spark, d, "supplier"), F.col("s_suppkey")
    hidden = F.when(k % 4 == 0, True).when(k % 4 == 1, False)
    return s.where(k % 4 < 3).select(k.alias("broker_id"), hidden.alias("guest_invisible"), F.when(k % 5 > 0, k % 7 * 30).alias("guest_max_history_days"))


@query(f"WITH {BROKERS} SELECT b.name, coalesce(r.name, b.name) AS real FROM brokers b LEFT JOIN brokers r ON b.alias = r.id")
def jn_broker_alias(spark, d):
    return dims.real_brokers(brokers(spark, d))


@query(f"""WITH {BROKERS}, mapping AS (SELECT id AS broker_id, '1D' AS resolution, '1d' AS spelling FROM brokers WHERE id % 2 = 0 UNION ALL SELECT id, '1H', 'H1' FROM brokers WHERE id % 3 = 0),
    wanted AS (SELECT DISTINCT s_name AS broker, r.resolution FROM supplier, (SELECT unnest(['1D', '1H']) AS resolution) r),
    known AS (SELECT name AS broker, resolution, spelling FROM mapping JOIN brokers ON id = broker_id) SELECT broker, resolution, spelling FROM wanted LEFT JOIN known USING (broker, resolution)""")
def jn_broker_resolution(spark, d):
    b = brokers(spark, d)
    day = b.where("id % 2 = 0").select(F.col("id").alias("broker_id"), F.lit("1D").alias("resolution"), F.lit("1d").alias("spelling"))
    hour = b.where("id % 3 = 0").select(F.col("id").alias("broker_id"), F.lit("1H").alias("resolution"), F.lit("H1").alias("spelling"))
    wanted = b.select(F.col("name").alias("broker"), F.explode(F.array(F.lit("1D"), F.lit("1H"))).alias("resolution"))
    return dims.broker_resolution(wanted, b, day.unionByName(hour))


@query(f"WITH {BROKERS}, {LIMITS} SELECT id, name FROM brokers LEFT JOIN limits ON id = broker_id WHERE guest_invisible IS NULL OR NOT guest_invisible")
def flt_broker_visible(spark, d):
    return dims.visible_brokers(brokers(spark, d), limits(spark, d)).select("id", "name")


@query(f"WITH {BRIDGE}, {LIMITS} SELECT product_id, store_id FROM bridge LEFT JOIN limits ON store_id = broker_id WHERE guest_invisible IS NULL OR NOT guest_invisible")
def flt_symbol_visible(spark, d):
    rows = views.bridge(spark, d).select("product_id", F.col("store_id").alias("broker_id"))
    return dims.visible_symbols(rows, limits(spark, d)).select("product_id", F.col("broker_id").alias("store_id"))


@query(f"""WITH {TICKS}, {LIMITS}, r AS (SELECT event_id AS id, (SELECT min(s_suppkey) FROM supplier) + event_id % (SELECT count(*) FROM supplier) AS broker_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id, ts_us // 1000000 AS start FROM ticks)
    SELECT id, broker_id, user_id, start, CASE WHEN user_id IS NULL AND start < 1706600000 - guest_max_history_days * 86400 THEN 'denied' ELSE 'allowed' END AS access FROM r LEFT JOIN limits USING (broker_id)""")
def flt_history_limit(spark, d):
    s = views.table(spark, d, "supplier").agg(F.min("s_suppkey").alias("low"), F.count("*").alias("n"))
    t = views.ticks(spark, d).join(F.broadcast(s))
    r = t.select(F.col("event_id").alias("id"), (F.col("low") + F.col("event_id") % F.col("n")).alias("broker_id"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id"), F.floor(F.col("ts_us") / 1000000).alias("start"))
    return dims.history_access(r, limits(spark, d), F.lit(1706600000).cast("long"))


PRODUCTS = "products AS (SELECT p_partkey AS id, p_name AS name, p_brand AS broker, CASE WHEN p_size % 7 > 0 THEN p_size % 2 = 0 END AS enabled FROM part)"


def products(spark, d):
    p = views.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("broker"), F.when(F.col("p_size") % 7 > 0, F.col("p_size") % 2 == 0).alias("enabled"))


@query(f"WITH {PRODUCTS} SELECT id, name FROM products WHERE enabled")
def flt_product_enabled(spark, d):
    return dims.enabled_products(products(spark, d)).select("id", "name")


@query(f"WITH {BRIDGE} SELECT store_id, s_name AS store, product_id, symbol_id FROM bridge JOIN supplier ON s_suppkey = store_id WHERE scope = 1")
def jn_products_of_broker(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"))
    return views.bridge(spark, d).where("scope = 1").join(s, "store_id").select("store_id", "store", "product_id", "symbol_id")


SCRAPED = "scraped AS (SELECT l_suppkey AS store_id, 'Product ' || (l_partkey % 25) AS product_name, l_extendedprice AS price FROM lineitem)"


def scraped(spark, d):
    li = views.table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("store_id"), F.concat(F.lit("Product "), (F.col("l_partkey") % 25).cast("string")).alias("product_name"), F.col("l_extendedprice").alias("price"))


@query(f"WITH {BRIDGE}, {SCRAPED} SELECT store_id, product_name, price, product_id, symbol_id FROM scraped JOIN bridge USING (store_id, product_name)")
def jn_product_to_symbol(spark, d):
    return dims.product_symbols(scraped(spark, d), views.bridge(spark, d))


@query(f"""WITH {BRIDGE}, {SCRAPED}, n AS (SELECT DISTINCT store_id, product_name FROM scraped ANTI JOIN bridge USING (store_id, product_name))
    SELECT store_id, product_name, 'UNK' AS symbol, (SELECT max(product_id) FROM bridge) + row_number() OVER (ORDER BY store_id, product_name) AS product_id FROM n""")
def jn_new_products_anti(spark, d):
    return dims.new_products(scraped(spark, d), views.bridge(spark, d))


@query(f"{PRICES}, {SYMBOLS} SELECT b.symbol_id, symbol, b.product_id, coalesce(buy, 0) AS buy, coalesce(sell, 0) AS sell FROM bridge b JOIN symbols USING (symbol_id) LEFT JOIN current c ON c.product_id = b.product_id AND b.product_id % 7 > 0 WHERE scope IN (1, 2)")
def jn_current_price_star(spark, d):
    return prices.current_star(views.bridge(spark, d), views.price_current(spark, d).where("product_id % 7 > 0"), symbols(spark, d), (1, 2))


@query(f"{PRICES} SELECT store_id, product_id, product_name, buy, sell FROM bridge JOIN current USING (product_id)")
def jn_store_price(spark, d):
    return prices.store_prices(views.bridge(spark, d), views.price_current(spark, d))


def landed_history(spark, d):
    """The price history as it lies by month."""
    path = scratch(spark, "history")
    history.land(views.price_history(spark, d), path)
    return history.read(spark, path)


@query(f"{PRICES} SELECT h.product_id, buy, sell, ts, h.id, b.symbol_id FROM history h JOIN bridge b USING (product_id) WHERE scope IN (0, 1) AND ts BETWEEN {START} AND {END}")
def jn_history_star(spark, d):
    return prices.history_star(landed_history(spark, d), views.bridge(spark, d), (0, 1), START, END)


@query(f"""{PRICES}, asked AS (SELECT product_id * 10 + k AS id, product_id, {START} + (product_id % 5 + k * 12) * 2592000 AS start, {START} + (product_id % 5 + k * 12 + 1) * 2592000 AS "end" FROM bridge, (SELECT unnest([0, 1]) AS k) WHERE scope = 2 AND symbol_id = 5)
    SELECT a.id, h.product_id, buy, sell, ts, h.id AS row_id FROM history h JOIN asked a ON h.product_id = a.product_id AND ts BETWEEN start AND "end" """)
def jn_history_requests(spark, d):
    """Ranges of time from a table of requests: the months to read are known when the requests are."""
    asked = views.bridge(spark, d).where("scope = 2 and symbol_id = 5").select("product_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    start = F.lit(START) + (F.col("product_id") % 5 + F.col("k") * 12) * 2592000
    asked = asked.select((F.col("product_id") * 10 + F.col("k")).alias("id"), "product_id", start.alias("start"), (start + 2592000).alias("end"))
    rows = landed_history(spark, d).withColumnRenamed("id", "row_id").select("product_id", "buy", "sell", "ts", "row_id", "month")
    return history.asked(rows, asked, "product_id")


@query(f"""{PRICES}, old AS (SELECT product_id, last(buy ORDER BY {HISTORY_ORDER}) AS b, last(sell ORDER BY {HISTORY_ORDER}) AS s FROM history WHERE ts <= {CUT} GROUP BY product_id)
    SELECT product_id, buy, sell, ts, round(coalesce(buy - b, 0), 6) AS buy_diff, round(coalesce(sell - s, 0), 6) AS sell_diff FROM current LEFT JOIN old USING (product_id)""")
def jn_asof_price(spark, d):
    return prices.as_of(views.price_current(spark, d), views.price_history(spark, d), CUT)


BUCKETS = f"buckets AS (SELECT symbol_id, product_id, (ts + 25200) // 86400 AS bucket, last(buy ORDER BY {HISTORY_ORDER}) AS buy, last(sell ORDER BY {HISTORY_ORDER}) AS sell FROM history GROUP BY ALL)"


@query(f"{PRICES}, {BUCKETS} SELECT * FROM buckets")
def agg_bucket_last(spark, d):
    return prices.bucket_last(views.price_history(spark, d))


@query(f"{PRICES} SELECT product_id, ts, (ts + 25200) // 86400 AS day, (ts + 25200) // 3600 AS hour FROM history")
def fn_bucket_local(spark, d):
    h = views.price_history(spark, d)
    return h.select("product_id", "ts", prices.local_bucket(F.col("ts")).alias("day"), prices.local_bucket(F.col("ts"), 3600).alias("hour"))


@query(f"""{PRICES}, {BUCKETS}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY bucket DESC) AS n FROM buckets JOIN (SELECT symbol_id, min(product_id) AS product_id FROM buckets GROUP BY symbol_id) USING (symbol_id, product_id)),
    g AS (SELECT symbol_id, product_id, list(buy ORDER BY bucket) AS b, list(sell ORDER BY bucket) AS s FROM f WHERE n <= 7 GROUP BY ALL)
    SELECT symbol_id, product_id, b[-1] AS buy, s[-1] AS sell, CASE WHEN len(s) > 1 THEN s[-2] END AS yesterday, round(coalesce(s[-1] - CASE WHEN len(s) > 1 THEN s[-2] END, 0), 6) AS diff,
    round(CASE WHEN s[1] <> 0 THEN (s[-1] - s[1]) / s[1] * 100 ELSE 0 END, 6) AS trend_pct, s AS trend FROM g""")
def agg_market_board(spark, d):
    return prices.market_board(prices.bucket_last(views.price_history(spark, d)))


@query(f"{PRICES} SELECT product_id, rank, buy, sell, ts FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ts DESC, id DESC, buy DESC, sell DESC) AS rank FROM history) WHERE rank <= 5")
def win_history_topn(spark, d):
    return prices.top_history(views.price_history(spark, d), 5)


LOCATIONS = "locations AS (SELECT c_custkey AS location_id, (SELECT min(s_suppkey) FROM supplier) + c_custkey % (SELECT count(*) FROM supplier) AS store_id, c_mktsegment AS district, n_name AS province, c_name AS address FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def locations(spark, d):
    s = views.table(spark, d, "supplier").agg(F.min("s_suppkey").alias("low"), F.count("*").alias("n"))
    n = views.table(spark, d, "nation")
    c = views.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(s))
    return c.select(F.col("c_custkey").alias("location_id"), (F.col("low") + F.col("c_custkey") % F.col("n")).alias("store_id"), F.col("c_mktsegment").alias("district"), F.col("n_name").alias("province"), F.col("c_name").alias("address"))


@query(f"""{PRICES}, {LOCATIONS}, l AS (SELECT store_id, province, district, arg_min(address, location_id) AS address FROM locations GROUP BY ALL),
    p AS (SELECT store_id, list({{'province': province, 'district': district, 'address': address}} ORDER BY province, district, address) AS locations FROM l GROUP BY store_id),
    g AS (SELECT store_id, list({{'product_id': product_id, 'product_name': product_name, 'buy': coalesce(buy, 0), 'sell': coalesce(sell, 0)}} ORDER BY product_id) AS products FROM bridge LEFT JOIN current USING (product_id) GROUP BY store_id)
    SELECT store_id, store, locations, products FROM stores JOIN p USING (store_id) JOIN g USING (store_id)""")
def agg_store_document(spark, d):
    return prices.store_documents(views.stores(spark, d), locations(spark, d), views.bridge(spark, d), views.price_current(spark, d))


@query(f"""{PRICES}, {SYMBOLS} SELECT symbol_id, symbol, list({{'product_id': product_id, 'store': store, 'buy': coalesce(buy, 0), 'sell': coalesce(sell, 0)}} ORDER BY product_id, store) AS stores
    FROM bridge JOIN symbols USING (symbol_id) JOIN stores USING (store_id) LEFT JOIN current USING (product_id) GROUP BY ALL""")
def agg_symbol_document(spark, d):
    return prices.symbol_documents(symbols(spark, d), views.bridge(spark, d), views.stores(spark, d), views.price_current(spark, d))


@query(f"WITH {LOCATIONS} SELECT DISTINCT province FROM locations")
def agg_distinct_provinces(spark, d):
    return locations(spark, d).select("province").distinct()


PLACED = "placed AS (SELECT product_id, n_name AS province FROM bridge JOIN nation ON n_nationkey = product_id % 25 WHERE product_id % 3 = 0)"
SOLD = f"""{PRICES}, {PLACED}, w AS (SELECT * FROM bridge WHERE scope IN (0, 1)),
    sold AS (SELECT DISTINCT * FROM (SELECT p.province, product_id, symbol_id, store FROM w JOIN placed p USING (product_id) JOIN stores USING (store_id)
        UNION ALL SELECT province, product_id, symbol_id, store FROM (SELECT * FROM w ANTI JOIN placed USING (product_id)) JOIN stores USING (store_id)) WHERE province IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'FRANCE', 'CHINA'))"""
PROVINCES = ("NATION_1", "NATION_2", "NATION_3", "NATION_4", "FRANCE", "CHINA")


def sold(spark, d):
    b = views.bridge(spark, d)
    placed = b.where("product_id % 3 = 0").select("product_id", (F.col("product_id") % 25).cast("int").alias("n_nationkey")).join(views.table(spark, d, "nation"), "n_nationkey").select("product_id", F.col("n_name").alias("province"))
    return prices.province_products(b, placed, views.stores(spark, d), (0, 1), PROVINCES)


@query(f"{SOLD} SELECT * FROM sold")
def jn_province_products(spark, d):
    return sold(spark, d)


@query(f"{SOLD} SELECT * FROM sold ORDER BY product_id, province, symbol_id, store LIMIT 50")
def set_located_union(spark, d):
    return sold(spark, d).orderBy("product_id", "province", "symbol_id", "store").limit(50)


@query(f"""{SOLD}, x AS (SELECT province, store, arg_max(buy, product_id) AS buy, arg_max(sell, product_id) AS sell FROM sold JOIN current USING (product_id) GROUP BY ALL)
    SELECT province, len(list(store)) AS stores, list(buy ORDER BY store) AS buys FROM x GROUP BY province""")
def agg_province_map(spark, d):
    m = prices.province_map(sold(spark, d), views.price_current(spark, d))
    # maps compare by their sorted entries
    entries = F.array_sort(F.map_entries("prices"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return m.select("province", F.size("prices").cast("long").alias("stores"), F.transform(entries, lambda e: e["value"]["buy"]).alias("buys"))


@query(f"WITH {views.STORES} SELECT coalesce(CASE WHEN store_id % 4 > 0 THEN province END, 'Tỉnh thành khác') AS province, list(store ORDER BY store) AS stores FROM stores GROUP BY ALL")
def agg_branches_by_province(spark, d):
    return prices.branches(views.stores(spark, d).withColumn("province", F.when(F.col("store_id") % 4 > 0, F.col("province"))))


@query(f"{PRICES} SELECT product_id, round(buy / 1000000.0, 6) AS buy, round(sell / 1000000.0, 6) AS sell, ts FROM current")
def prj_degree(spark, d):
    return prices.scaled(views.price_current(spark, d), 1_000_000)


#: Rates by day: a currency for each nation, some without a number.
FX = """fx AS (SELECT n_name AS code, ts // 86400 AS date, CASE WHEN ts // 86400 % 11 = 0 THEN '-' ELSE CAST(CAST(round(max(buy)) AS BIGINT) AS VARCHAR) END AS cash, CAST(CAST(round(max(sell)) AS BIGINT) AS VARCHAR) AS sell
    FROM history JOIN nation ON n_nationkey = product_id % 25 GROUP BY n_name, ts // 86400)"""


def fx(spark, d):
    h = views.price_history(spark, d).withColumn("n_nationkey", (F.col("product_id") % 25).cast("int")).join(views.table(spark, d, "nation"), "n_nationkey")
    g = h.groupBy(F.col("n_name").alias("code"), F.floor(F.col("ts") / 86400).alias("date")).agg(F.max("buy").alias("b"), F.max("sell").alias("s"))
    text = lambda c: F.round(c).cast("long").cast("string")
    return g.select("code", "date", F.when(F.col("date") % 11 == 0, "-").otherwise(text("b")).alias("cash"), text("s").alias("sell"))


@query(f"{PRICES}, {FX} SELECT code, date, TRY_CAST(cash AS DOUBLE) AS cash, TRY_CAST(sell AS DOUBLE) AS sell FROM fx WHERE TRY_CAST(cash AS DOUBLE) <> 0")
def flt_fx_valid(spark, d):
    return prices.valid_fx(fx(spark, d))


@query(f"""{PRICES}, {FX}, v AS (SELECT code, date, TRY_CAST(cash AS DOUBLE) AS cash, TRY_CAST(sell AS DOUBLE) AS sell, dense_rank() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM fx WHERE TRY_CAST(cash AS DOUBLE) <> 0)
    SELECT code, list({{'date': date, 'cash': cash, 'sell': sell}} ORDER BY date) AS rates FROM v WHERE n <= 30 GROUP BY code""")
def agg_fx_history(spark, d):
    return prices.fx_history(fx(spark, d))


@query("SELECT s_name AS store, count(*) AS total, count(*) FILTER (p_size % 5 > 0) AS success, count(*) FILTER (p_size % 5 = 0) AS failed, coalesce(list('bad ' || l_linenumber ORDER BY 'bad ' || l_linenumber) FILTER (p_size % 5 = 0), []) AS errors, count(*) FILTER (p_size % 5 = 0) = 0 AS ok FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name")
def agg_load_summary(spark, d):
    li, p, s = (views.table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    rows = li.join(p, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return prices.load_summary(rows.select(F.col("s_name").alias("store"), (F.col("p_size") % 5 > 0).alias("ok"), F.concat(F.lit("bad "), F.col("l_linenumber").cast("string")).alias("message")))


@query(f"""{PRICES}, {FX}, rates AS (SELECT date + 8750 AS day, max(TRY_CAST(sell AS DOUBLE)) AS sell FROM fx GROUP BY date), {TICKS}, days AS (SELECT DISTINCT ts_us // 1000000 // 86400 AS day FROM ticks),
    f AS (SELECT day, (SELECT arg_max(r.sell, r.day) FROM rates r WHERE r.day <= days.day) AS sell FROM days), p AS (SELECT event_id AS id, symbol, ts_us, price * 1.205 * f.sell / 1e6 AS parity FROM ticks JOIN f ON f.day = ts_us // 1000000 // 86400),
    b AS (SELECT *, lag(parity) OVER (PARTITION BY symbol ORDER BY ts_us, id) AS before FROM p)
    SELECT id, round(parity, 6) AS parity, round(coalesce(parity - before, 0), 6) AS change, round(CASE WHEN coalesce(before, 0) <> 0 THEN (parity - before) / before * 100 ELSE 0 END, 6) AS change_pct FROM b""")
def fn_gold_parity(spark, d):
    rates = fx(spark, d).groupBy((F.col("date") + 8750).alias("day")).agg(F.max(F.expr("try_cast(sell AS DOUBLE)")).alias("sell"))
    t = views.ticks(spark, d).select(F.col("event_id").alias("id"), "symbol", F.floor(F.col("ts_us") / 86400000000).alias("day"), F.col("ts_us").alias("ts"), F.col("price").alias("usd"))
    return prices.gold_parity(t, rates)


META = "meta AS (SELECT n_nationkey AS rank, CASE WHEN n_nationkey % 2 = 0 THEN 'Supplier#' || n_nationkey ELSE 'Shop-' || n_name END AS key, CASE WHEN n_nationkey % 3 = 0 THEN '#' || n_nationkey ELSE 'zz' || n_name END AS short, 'L' || n_nationkey AS label FROM nation)"


@query(f"""WITH {META}, st AS (SELECT s_name AS store FROM supplier UNION ALL SELECT DISTINCT 'Shop-' || n_name || '' FROM nation), e AS (SELECT store, (SELECT min(label) FROM meta WHERE key = store) AS exact FROM st),
    x AS (SELECT store, coalesce(exact, (SELECT arg_min(label, rank) FROM meta WHERE contains(lower(store), lower(short)) OR contains(lower(key), lower(store))), substr(trim(split_part(store, '-', 1)), 1, 25)) AS label FROM e) SELECT * FROM x""")
def jn_store_meta_fuzzy(spark, d):
    n, s = views.table(spark, d, "nation"), views.table(spark, d, "supplier")
    k = F.col("n_nationkey")
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    meta = n.select(k.alias("rank"), F.when(k % 2 == 0, text("Supplier#", k)).otherwise(text("Shop-", F.col("n_name"))).alias("key"), F.when(k % 3 == 0, text("#", k)).otherwise(text("zz", F.col("n_name"))).alias("short"), text("L", k).alias("label"))
    stores = s.select(F.col("s_name").alias("store")).unionByName(n.select(text("Shop-", F.col("n_name")).alias("store")).distinct())
    return dims.store_meta(stores, meta)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'X' THEN 'x' ELSE o_orderstatus END AS code, coalesce(n_name, o_orderstatus) AS name FROM orders LEFT JOIN (SELECT substr(n_name, 1, 1) AS k, min(n_name) AS n_name FROM nation GROUP BY 1) ON k = o_orderstatus")
def jn_code_name(spark, d):
    o, n = views.table(spark, d, "orders"), views.table(spark, d, "nation")
    names = n.groupBy(F.substring("n_name", 1, 1).alias("code")).agg(F.min("n_name").alias("name"))
    return dims.code_names(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("code")), names)


SUBS = "subs AS (SELECT DISTINCT 'c' || user_id % 7 AS client, CASE WHEN user_id % 5 = 0 THEN 'other' ELSE 'sim' END AS broker, event_type AS symbol FROM events WHERE user_id % 3 = 0 AND event_type < 'r')"


def subs(spark, d):
    e = views.table(spark, d, "events").where("user_id % 3 = 0 and event_type < 'r'")
    return e.select(F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("client"), F.when(F.col("user_id") % 5 == 0, "other").otherwise("sim").alias("broker"), F.col("event_type").alias("symbol")).distinct()


@query(f"WITH {TICKS}, {SUBS} SELECT event_id, broker, symbol, price FROM ticks SEMI JOIN subs USING (broker, symbol)")
def jn_tick_subscription(spark, d):
    return dims.subscribed(views.ticks(spark, d), subs(spark, d)).select("event_id", "broker", "symbol", "price")


@query(f"WITH {SUBS} SELECT client, broker, symbol, CASE WHEN broker = 'sim' THEN NULL ELSE 'unknown broker ' || broker END AS message FROM subs")
def jn_broker_enabled(spark, d):
    known = views.ticks(spark, d).select(F.col("broker").alias("name")).distinct()
    ok, bad = dims.accepted_subscriptions(subs(spark, d), known)
    return ok.withColumn("message", F.lit(None).cast("string")).unionByName(bad)


@query("SELECT s_suppkey AS store_id, s_name AS store FROM supplier WHERE contains(lower(s_name), 'r#') AND s_nationkey % 2 = 0")
def flt_store_directory(spark, d):
    s = views.table(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store"), F.array(F.when(F.col("s_nationkey") % 2 == 0, "Huế").otherwise("Vinh")).alias("provinces"))
    return dims.directory(rows, "R#", "HUẾ").select("store_id", "store")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def srt_keyset_page(spark, d):
    return dims.page_after(views.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 50)


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer), p AS (SELECT c_custkey, n // 40 AS page FROM r),
    f AS (SELECT page, CASE WHEN count(*) = 40 THEN max(c_custkey) END AS next_after FROM p GROUP BY page) SELECT c_custkey, page, next_after FROM p JOIN f USING (page)""")
def srt_keyset_pages(spark, d):
    return dims.pages(views.table(spark, d, "customer").select("c_custkey"), "c_custkey", 40)


@query(f"{PRICES} SELECT product_id, product_name, buy, sell FROM bridge JOIN current USING (product_id) ORDER BY abs(sell - buy) DESC, product_id")
def srt_user_column(spark, d):
    return dims.sorted_products(prices.store_prices(views.bridge(spark, d), views.price_current(spark, d)), "spread", False).select("product_id", "product_name", "buy", "sell")


RATES = "rates AS (SELECT o_custkey AS bank, CASE WHEN o_orderpriority < '3' THEN 'online' ELSE 'counter' END AS channel, CAST(o_orderdate AS DATE) AS day, o_totalprice AS rate, o_orderkey AS id FROM orders)"


@query(f"WITH {RATES} SELECT bank, channel, day, rate, id FROM rates WHERE channel = 'online' AND day = (SELECT max(day) FROM rates WHERE channel = 'online')")
def srt_latest_report(spark, d):
    o = views.table(spark, d, "orders")
    rates = o.select(F.col("o_custkey").alias("bank"), F.when(F.col("o_orderpriority") < "3", "online").otherwise("counter").alias("channel"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("rate"), F.col("o_orderkey").alias("id"))
    return dims.latest_report(rates)


@query("SELECT s_suppkey AS store_id FROM supplier ANTI JOIN (SELECT l_suppkey AS s_suppkey FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.08 AND l_suppkey % 3 > 0) USING (s_suppkey)")
def set_missing_stores(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_id"))
    return dims.missing_stores(s, views.table(spark, d, "lineitem").where("l_quantity > 45 and l_discount > 0.08 and l_suppkey % 3 > 0").select(F.col("l_suppkey").alias("store_id")))


@query("""WITH b AS (SELECT p_partkey AS id, p_name || '!' AS name, p_brand AS brand, p_size AS size FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey + 1000000, p_name, p_brand, p_size FROM part WHERE p_partkey % 5 = 0)
    SELECT coalesce(t.p_partkey, b.id) AS id, coalesce(b.name, t.p_name) AS name, coalesce(t.p_brand, b.brand) AS brand FROM part t FULL JOIN b ON t.p_partkey = b.id""")
def snk_upsert_by_key(spark, d):
    p = views.table(spark, d, "part")
    target = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    changed = target.where("id % 3 = 0").select("id", F.concat("name", F.lit("!")).alias("name"), F.lit("none").alias("brand"), F.lit(1).alias("seq"))
    old = changed.withColumns({"name": F.lit("stale"), "seq": F.lit(0)})
    new = target.where("id % 5 = 0").select((F.col("id") + 1000000).alias("id"), "name", "brand", F.lit(1).alias("seq"))
    table = Snapshot(spark, scratch(spark, "parts"), "id long, name string, brand string", ["id"])
    table.rewrite(target, lambda _, batch: batch, 1)
    table.rewrite(changed.unionByName(old).unionByName(new), lambda held, batch: dims.upsert(held, batch, ["id"], ["name"], "seq"), 2)
    return table.read()


@query(f"{PRICES}, x AS (SELECT *, lag(buy) OVER w AS b, lag(sell) OVER w AS s FROM history WINDOW w AS (PARTITION BY product_id ORDER BY ts, id, buy, sell)) SELECT product_id, ts, id, buy, sell FROM x WHERE b IS NULL OR b <> buy OR s <> sell")
def price_changes(spark, d):
    return prices.changes(views.price_history(spark, d))


@query(f"""{PRICES}, asked AS (SELECT DISTINCT product_id, {CUT} - product_id % 1000 * 86400 AS cut FROM bridge)
    SELECT product_id, cut, (SELECT last(buy ORDER BY {HISTORY_ORDER}) FROM history h WHERE h.product_id = a.product_id AND ts <= cut) AS buy, (SELECT last(sell ORDER BY {HISTORY_ORDER}) FROM history h WHERE h.product_id = a.product_id AND ts <= cut) AS sell FROM asked a""")
def jn_asof_each(spark, d):
    asked = views.bridge(spark, d).select("product_id", (F.lit(CUT) - F.col("product_id") % 1000 * 86400).alias("cut"))
    return prices.as_of_each(asked, views.price_history(spark, d))
