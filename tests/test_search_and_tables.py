"""Names found by pieces, page tables found by what they hold, products in users' orders, profiles called from SQL."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.operators import dimensions as dims
from tickloom.operators import profile, text
from tickloom.sources import pages


def test_names_that_contain_queries(spark):
    r = random.Random(1)
    names = ["", "the", "a", "the red ring", None, *("the " + "".join(r.choice("abc ") for _ in range(r.randrange(12))) for _ in range(80))]
    queries = ["", "the", "th", "a", "zzz", "the zzz", None, *("".join(r.choice("abc ") for _ in range(r.randrange(1, 5))) for _ in range(40))]
    n, q = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((names, "name"), (queries, "query")))
    want = {(a, b) for a in names for b in queries if a is not None and b and b in a}
    got = [tuple(x) for x in text.containing(n, q).select("name", "query").collect()]
    assert set(got) == want and len(got) == len(want)
    only_long = q.where(F.length("query") >= 3)
    assert {tuple(x) for x in text.containing(n, only_long).select("name", "query").collect()} == {x for x in want if len(x[1]) >= 3}
    assert text.containing(n.limit(0), q).count() == 0 and text.containing(n, q.limit(0)).count() == 0


def test_first_of_each(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("g"), "id")
    assert sorted((r.g, r.id) for r in text.first_of_each(rows, "g", "id", 4).collect()) == [(g, g + 3 * k) for g in range(3) for k in range(4)]


def test_store_labels(spark):
    stores = spark.createDataFrame([(s,) for s in ["Exact", "The Gold Shop", "ring", "Unknown name - of some length", "", None]], "store string")
    meta = [(1, "Exact", "zz", "L1"), (2, "Big Ringers", "qq", "L2"), (3, "k3", "gold", "L3"), (4, "k4", "shop", "L4"), (5, None, None, "L5")]
    got = {r.store: r.label for r in dims.store_meta(stores, spark.createDataFrame(meta, "rank long, key string, short string, label string")).collect()}
    assert got == {"Exact": "L1", "The Gold Shop": "L3", "ring": "L2", "Unknown name - of some length": "Unknown name", "": "L1", None: None}
    every = spark.createDataFrame([*meta, (0, "k", "", "all")], "rank long, key string, short string, label string")
    assert {r.store: r.label for r in dims.store_meta(stores, every).collect()}["Unknown name - of some length"] == "all"
    plan = dims.store_meta(stores, every)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 2 and "contains(lower(store" not in plan  # one-row sides alone


def test_tables_by_what_they_hold():
    page = "<table><tr><td>menu<table><tr><th>Mua </th><th>BÁN</th></tr><tr><td>1</td><td>2</td></tr></table></td></tr></table><table><tr><td>Giá vàng</td></tr><tr><td>3<td>4</tr>"
    rows = lambda what, html=page: pages.rows_of(html, "table", what, "tr", "td", "")
    assert rows("header~=bán,mua") == [["1", "2"]] and rows("text~=giá VÀNG") == [["Giá vàng"], ["3", "4"]]
    assert rows("text~=2") == [["1", "2"]] and rows("text~=nothing") == [] and rows("header~=bán,x") == [] and rows("text~=x", None) == []


def test_products_in_users_orders(spark):
    made = [(1, "Đồng", 5.0, 9.0), (2, "Dây", 7.0, 7.5), (3, "ấm", 1.0, 9.5), (4, "an", 7.0, 6.0), (5, "Bạc", 2.0, 2.0)]
    rows = spark.createDataFrame(made, "product_id long, product_name string, buy double, sell double").repartition(3)
    order = lambda by, up=True: [r.product_id for r in dims.sorted_products(rows, by, up).collect()]
    assert order("name") == [4, 3, 5, 2, 1] and order("name", False) == [1, 2, 5, 3, 4]
    assert order("buy") == [3, 5, 1, 2, 4] and order("sell") == [5, 4, 2, 1, 3] and order("spread", False) == [3, 1, 4, 2, 5]
    with pytest.raises(ValueError):
        dims.sorted_products(rows, "colour")


def test_profile_from_sql(spark):
    bars = [(s, k, "x", 10.0 + k % 5, 10.5 + k % 5 + k % 3, 2.0, k) for s in ("a", None) for k in range(40)] + [("flat", 0, "x", 5.0, 5.0, 1.0, 0)]
    spark.createDataFrame(bars, "symbol string, t long, venue string, l double, h double, v double, o long").createOrReplaceTempView("bars")
    profile.register_profile(spark)
    got = spark.sql("SELECT * FROM volume_profile(TABLE(SELECT symbol, t, l, h, v FROM bars) PARTITION BY (symbol) ORDER BY (t), 6)")
    assert got.columns == ["symbol", "level", "price", "volume"]
    want = profile.volume_profile(spark.table("bars").where("symbol = 'a'").select("symbol", "t", "l", "h", "v"), 6)
    plain = lambda df: sorted((r.level, round(r.price, 6), round(r.volume, 6) + 0.0) for r in df.collect())
    assert plain(got.where("symbol = 'a'")) == plain(want) == plain(got.where("symbol is null")) and got.where("symbol = 'flat'").count() == 0
    for bad in ("volume_profile(TABLE(bars) PARTITION BY (symbol), 0)", "volume_profile(TABLE(SELECT symbol FROM bars) PARTITION BY (symbol), 3)"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_profile_from_sql_at_the_edges_of_levels(spark):
    """Prices whose quotient by a level's width rounds to a level's edge, and bars without a price or volume."""
    bars = [(f"s{k}", t, low / 100, low / 100, 1.0) for k in range(1, 40) for t, low in enumerate([0, *range(k, 10 * k, k), 10 * k])]
    bars += [("n", 0, 1.0, 2.0, 3.0), ("n", 2, 1.5, None, 2.0), ("n", 3, 1.0, 1.2, None)]
    spark.createDataFrame(bars, "symbol string, t long, l double, h double, v double").createOrReplaceTempView("edges")
    profile.register_profile(spark)
    got = spark.sql("SELECT * FROM volume_profile(TABLE(edges) PARTITION BY (symbol) ORDER BY (t), 10)")
    want = profile.volume_profile(spark.table("edges"), 10)
    plain = lambda df: sorted((r.symbol, r.level, round(r.price, 6), round(r.volume, 6) + 0.0) for r in df.collect())
    assert plain(got) == plain(want)
