"""Queries of the column functions, over texts and numbers of the given tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import views
from ..functions import scalars as fn
from .registry import query


def events(spark, d):
    return views.table(spark, d, "events")


def pick(*values) -> Column:
    """One of the values (columns or texts) by event_id."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (F.col("event_id") % len(values) + 1).cast("int"))


#: The number in an event's props, in SQL.
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def number() -> Column:
    """K in Spark."""
    return F.get_json_object("props", "$.k").cast("long")


def said(form: str, *values) -> Column:
    return F.format_string(form, *values)


@query(f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN {K} WHEN 4 THEN -100 * ({K} + 1) ELSE 0 END AS number FROM events")
def fn_lossy_num(spark, d):
    text = pick(F.col("value").cast("string"), said(" %d ", number()), F.col("event_type"), "", said("-%de2", number() + 1), said("%d,000", number()))
    return events(spark, d).select("event_id", fn.lossy_number(text).alias("number"))


#: What each of twelve kinds of JSON, by event_id, is as each type, in SQL.
BIG, PART = "2147483648 + event_id", "printf('%.2f5', value)"
I32 = {1: f"-1 - {K}", 2: K, 3: 1, 5: f"{K} + 1", 11: 0}
I64 = I32 | {7: BIG}
U64 = {k: v for k, v in I64.items() if k != 1}
F64 = {0: f"CAST({PART} AS DOUBLE)", 11: 0.0} | {k: f"CAST({v} AS DOUBLE)" for k, v in I64.items() if k != 11}
BOOL = {0: "true", 1: "true", 2: f"CASE {K} WHEN 1 THEN true WHEN 0 THEN false END", 3: "true", 4: "true", 5: "true", 6: "false", 7: "true", 8: "false", 11: "false"}
TEXT = {0: PART, 1: f"CAST(-1 - {K} AS VARCHAR)", 2: f"' ' || {K} || ' '", 3: "'true'", 4: "'on'", 5: f"CAST({K} + 1 AS VARCHAR)", 6: "'null'", 7: f"CAST({BIG} AS VARCHAR)", 8: "'off'", 9: "event_type", 10: f"'[' || {K} || ']'", 11: "'0'"}


def case(values: dict) -> str:
    return "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


@query(f"""SELECT event_id, CAST({case(I32)} AS INTEGER) AS i32, CAST({case(I64)} AS BIGINT) AS i64, CAST({case(U64)} AS BIGINT) AS u64, CAST({case(F64)} AS DOUBLE) AS f64,
    {case(BOOL)} AS bool, {case(TEXT)} AS string FROM events""")
def fn_strict_cast(spark, d):
    json = pick(
        said("%.2f5", F.col("value")), said("-%d", number() + 1), said('" %d "', number()), "true", '"on"', said("%d", number() + 1), "null", said("%d", F.col("event_id") + 2147483648), '"off"', said('"%s"', F.col("event_type")), said("[%d]", number()), "0",
    )
    v = F.parse_json(json)
    casts = {k: fn.strict_cast(v, k) for k in ("i32", "i64", "f64", "bool", "string")}
    return events(spark, d).select("event_id", *(c.alias(k) for k, c in casts.items()), fn.strict_cast(v, "u64").cast("long").alias("u64"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000000 ELSE epoch_us(ts) // 1000 END AS t FROM events")
def fn_epoch_unit(spark, d):
    t = F.floor(views.epoch_us(F.col("ts")) / 1000)
    return events(spark, d).select("event_id", fn.epoch_seconds(t, F.when(F.col("event_id") % 3 == 0, "binance").otherwise("ssi")).alias("t"))


@query(f"""SELECT event_id, d AS digits, coalesce(d, 0) AS zero, nullif(d, 0) AS some
    FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN {K} * 1000 + 150 WHEN 1 THEN event_id * 1000 + 750 WHEN 3 THEN 0 WHEN 5 THEN user_id * 100000 + 50050 END AS d FROM events)""")
def fn_price_digits(spark, d):
    s = pick(said("%d.150", number()), said("%d.750 đ", F.col("event_id")), "liên hệ", "0", "", said("%d,500.50", F.col("user_id")))
    return events(spark, d).select("event_id", fn.price_digits(s).alias("digits"), fn.price_digits(s, 0).alias("zero"), fn.price_digits(s, None, True).alias("some"))


RULES = ("always", "below 100000", "below 200000", "as is")


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AND floor(o_totalprice) < 100000 OR o_orderkey % 4 = 2 AND floor(o_totalprice) < 200000 THEN 1000 ELSE 1 END AS price FROM orders")
def fn_price_scale(spark, d):
    rule = F.element_at(F.array(*map(F.lit, RULES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return views.table(spark, d, "orders").select("o_orderkey", fn.price_scale(F.floor("o_totalprice"), rule).alias("price"))


@query("SELECT p_partkey, p_brand || ' ' || upper(p_name) || ' 24K' AS name, p_name || ' A B' AS plain FROM part")
def fn_name_clean(spark, d):
    messy = F.concat(F.lit("- "), F.upper("p_name"), F.lit("  (LẦN 2)/"))
    plain = F.concat(F.lit("  "), F.col("p_name"), F.lit(" (lần 1) A/B  "))
    return views.table(spark, d, "part").select("p_partkey", fn.clean_name(messy, F.col("p_brand"), F.lit("24K")).alias("name"), fn.clean_name(plain).alias("plain"))


@query("SELECT p_partkey, 'Vàng ' || p_name AS fixed, 'Vàng ' || p_name AS kept, '{\"a\":\"' || p_name || '<\"}' AS json FROM part")
def fn_encoding_repair(spark, d):
    right = F.concat(F.lit("Vàng "), "p_name")
    wrong = F.decode(F.encode(right, "UTF-8"), "ISO-8859-1")
    json = F.get_json_object(fn.repaired_json(F.concat(F.lit('{"a":"'), F.col("p_name"), F.lit('\\x3c\\q"}'))), "$.a")
    back = F.concat(F.lit('{"a":"'), F.rtrim(json, F.lit("q")), F.lit('"}'))
    return views.table(spark, d, "part").select("p_partkey", fn.repaired(wrong).alias("fixed"), fn.repaired(right).alias("kept"), back.alias("json"))


@query("SELECT doc_id, trim(regexp_replace(translate(strip_accents(text), 'đĐ', 'dD'), '[\\x{0300}-\\x{036F}]', '', 'g')) AS plain FROM documents")
def fn_remove_tones(spark, d):
    return views.table(spark, d, "documents").select("doc_id", fn.remove_tones(F.col("text")).alias("plain"))


CENTS = "CAST(round(value * 100) AS BIGINT)"


@query(f"SELECT event_id, CASE WHEN c > 500 THEN '▲' WHEN c < 500 THEN '▼' ELSE '●' END || ' ' || CAST(abs(c - 500) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(c - 500) % 100 AS VARCHAR), 2, '0') AS said FROM (SELECT event_id, {CENTS} AS c FROM events)")
def fn_diff_text(spark, d):
    return events(spark, d).select("event_id", fn.diff_text((F.round(F.col("value") * 100) - 500).cast("double"), 100).alias("said"))


@query(f"SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '0%' WHEN c >= 0 THEN '+' || CAST(c // 10 AS VARCHAR) || '.' || CAST(c % 10 AS VARCHAR) || '%' END AS said FROM (SELECT event_id, {CENTS} AS c FROM events)")
def fn_trend_text(spark, d):
    c = F.round(F.col("value") * 100).cast("double")
    first = F.when(F.col("event_id") % 10 > 0, F.lit(1000.0))
    return events(spark, d).select("event_id", fn.trend_text(first, 1000 + c).alias("said"))


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '0%' ELSE CASE WHEN event_id % 4 = 1 AND c > 0 THEN '-' ELSE '' END || CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '%' END AS said FROM (SELECT event_id, {CENTS} AS c FROM events)")
def fn_pct_from_diff(spark, d):
    c = F.round(F.col("value") * 100).cast("long")
    down = F.col("event_id") % 4 == 1
    diff = F.when(F.col("event_id") % 4 == 3, "n/a").otherwise(F.concat(F.when(down, "▼ ").otherwise("▲ +"), c.cast("string")))
    return events(spark, d).select("event_id", fn.pct_from_diff(diff, F.when(down, 10000 - c).otherwise(10000 + c).cast("double")).alias("said"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '—' ELSE replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') END AS money,
    CASE WHEN o_orderkey % 9 = 0 THEN '---' ELSE CAST(floor(o_totalprice) AS BIGINT) // 1000 || '.00K' END AS volume FROM orders""")
def fn_money_format(spark, d):
    o = views.table(spark, d, "orders")
    there = F.when(F.col("o_orderkey") % 9 > 0, F.floor("o_totalprice"))
    return o.select("o_orderkey", fn.money(there).alias("money"), fn.short_volume(F.floor(there / 1000) * 1000).alias("volume"))


@query(f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN ({K} + 1)::DOUBLE / 60 WHEN 1 THEN {K} + 1 WHEN 2 THEN ({K} + 1) * 24 ELSE 1 END AS hours FROM events")
def fn_res_hours(spark, d):
    unit = pick("m", "H", "d", "D", "W", "", "M")
    return events(spark, d).select("event_id", fn.resolution_hours(F.concat((number() + 1).cast("string"), unit)).alias("hours"))


@query(f"""SELECT event_id, list_sort(list_transform(string_split(l, ','), lambda x: trim(x))) AS sorted, CASE WHEN event_id % 4 = 1 THEN [CAST({K} AS INTEGER), CAST(user_id AS INTEGER)] END AS scopes
    FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN event_type || ', a' WHEN 1 THEN {K} || ', ' || user_id WHEN 2 THEN event_type ELSE user_id || ',z' END AS l FROM events)""")
def fn_split_list(spark, d):
    lists = pick(said("%s, a", F.col("event_type")), said("%d, %d", number(), F.col("user_id")), F.col("event_type"), said("%d,z", F.col("user_id")))
    return events(spark, d).select("event_id", fn.split_list(lists).alias("sorted"), fn.split_scopes(lists).alias("scopes"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substr(c, 1, 9) WHEN length(c) < 8 THEN substr(c, 1, 3) ELSE substr(c, 1, 8) END AS symbol, CASE WHEN event_id % 3 = 0 THEN substr(c, 10) WHEN length(c) < 8 THEN substr(c, 4) ELSE substr(c, 9) END AS index,
    value AS change FROM (SELECT event_id, value, upper(event_type) || event_id AS c FROM events)""")
def fn_delta_key(spark, d):
    cell = F.concat(F.upper("event_type"), F.col("event_id").cast("string"))
    symbol, index = fn.delta_key(cell, F.col("event_id") % 3 == 0)
    return events(spark, d).select("event_id", symbol.alias("symbol"), index.alias("index"), fn.delta_value(F.concat(F.lit("+"), F.col("value").cast("string"), F.lit(" %"))).alias("change"))


@query("SELECT doc_id, nfc_normalize(text) || CAST(doc_id % 10 AS VARCHAR) || 'fi 12 kg' AS plain FROM documents")
def fn_nfkc(spark, d):
    """Texts with a full-width digit, a ligature, circled digits and a unit's sign behind them."""
    digit = F.translate((F.col("doc_id") % 10).cast("string"), "0123456789", "".join(chr(0xFF10 + k) for k in range(10)))
    return views.table(spark, d, "documents").select("doc_id", fn.nfkc(F.concat("text", digit, F.lit("\ufb01 \u2460\u2461 \u338f"))).alias("plain"))
