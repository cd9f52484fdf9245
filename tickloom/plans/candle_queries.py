"""Queries over candles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import candles as bars
from ..operators import indicators, patterns, profile
from ..sources import history
from ..storage import scratch
from ..views import CANDLES, TICKS, candles_sql
from .registry import query, rounded

#: Bars of four hours for every user: many series.
USERS = f"WITH {TICKS}, {candles_sql(key='user_id')}"
W = "(PARTITION BY symbol ORDER BY t)"


def users(spark, d):
    return views.candles(spark, d, 14400, "user_id")


def frame(p: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


@query(f"{CANDLES} SELECT * FROM candles")
def agg_tick_ohlc(spark, d):
    return views.candles(spark, d)


PROFILE = """edges AS (SELECT symbol, min(l) AS low, max(h) AS high FROM candles GROUP BY symbol HAVING max(h) > min(l)),
    b AS (SELECT symbol, t, v, low, (high - low) / 10 AS bin FROM candles JOIN edges USING (symbol)),
    p AS (SELECT c.symbol, c.t, c.v, low, bin, least(CAST(floor((c.l - low) / bin) AS BIGINT), 9) AS a, least(CAST(floor((c.h - low) / bin) AS BIGINT), 9) AS z
        FROM candles c JOIN b USING (symbol, t)),
    e AS (SELECT symbol, t, low, bin, unnest(generate_series(a, z)) AS level, v / (z - a + 1) AS v FROM p),
    grid AS (SELECT DISTINCT symbol, low, bin, g.level FROM p, (SELECT unnest(generate_series(0, 9)) AS level) g)"""


@query(f"""{USERS}, {PROFILE} SELECT grid.symbol, grid.level, round(grid.low + grid.level * grid.bin, 6) AS price, round(coalesce(sum(e.v), 0), 6) AS volume
    FROM grid LEFT JOIN e ON grid.symbol = e.symbol AND grid.level = e.level GROUP BY ALL""")
def agg_volume_profile(spark, d):
    return profile.volume_profile(users(spark, d), 10)


HEAT = f"""{PROFILE}, pins AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY t // 86400) - 1 AS p FROM e),
    n AS (SELECT symbol, max(p) + 1 AS pins FROM pins GROUP BY symbol HAVING max(p) + 1 >= 3),
    wins AS (SELECT symbol, unnest(generate_series(0, pins - 3)) AS "window" FROM n),
    heat AS (SELECT w.symbol, w."window", g.level, round(coalesce(sum(x.v), 0), 6) AS volume FROM wins w CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS level) g
        LEFT JOIN pins x ON x.symbol = w.symbol AND x.level = g.level AND x.p BETWEEN w."window" AND w."window" + 2 GROUP BY ALL)"""


def heat(spark, d):
    return profile.heatmap(users(spark, d), 10, 24, 3)


@query(f"{USERS}, {HEAT} SELECT * FROM heat")
def agg_heatmap_windows(spark, d):
    return heat(spark, d)


TOTALS = f"{HEAT}, totals AS (SELECT symbol, level, round(sum(volume), 6) AS total FROM heat GROUP BY ALL)"


@query(f"{USERS}, {TOTALS} SELECT symbol, level, round(total, 4) AS total FROM totals")
def agg_level_totals(spark, d):
    return rounded(profile.level_totals(heat(spark, d)), "total", digits=4)


@query(f"""{USERS}, {HEAT} SELECT symbol, level, list(volume ORDER BY "window") AS volumes FROM heat GROUP BY ALL""")
def agg_heatmap_matrix(spark, d):
    return profile.matrix(heat(spark, d))


@query(f"""{USERS}, {TOTALS} SELECT symbol, level, round(avg(total) OVER (PARTITION BY symbol ORDER BY level ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS total FROM totals""")
def win_smooth_levels(spark, d):
    return rounded(profile.smoothed(profile.level_totals(heat(spark, d)), 3), "total", digits=4)


def level_ranges(spark, d):
    return profile.level_ranges(profile.smoothed(profile.level_totals(heat(spark, d)), 1))


#: Levels by volume join the range that they touch, of two the one of the lower center, or start one: a step for each level.
RANGES = f"""WITH RECURSIVE {USERS.removeprefix("WITH ")}, {TOTALS}, o AS (SELECT symbol, level, row_number() OVER (PARTITION BY symbol ORDER BY total DESC, level) AS n FROM totals),
    g AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(b BIGINT, c BIGINT, e BIGINT)[]) AS r FROM o
        UNION ALL SELECT symbol, n, CASE WHEN c IS NULL THEN list_append(r, {{'b': level, 'c': level, 'e': level}})
            ELSE list_transform(r, lambda x: CASE WHEN x.c = c THEN {{'b': least(x.b, level), 'c': x.c, 'e': greatest(x.e, level)}} ELSE x END) END
        FROM (SELECT g.symbol, o.n, g.r, o.level, list_min(list_transform(list_filter(g.r, lambda x: o.level = x.b - 1 OR o.level = x.e + 1), lambda x: x.c)) AS c FROM g JOIN o ON o.symbol = g.symbol AND o.n = g.n + 1)),
    last AS (SELECT symbol, r FROM g WHERE n = 10),
    ranges AS (SELECT symbol, i - 1 AS range, r[i].b AS "begin", r[i].c AS center, r[i].e AS "end" FROM (SELECT symbol, r, unnest(generate_series(1, len(r))) AS i FROM last))"""


@query(f'{RANGES} SELECT symbol, CAST(range AS BIGINT) AS range, "begin", center, "end" FROM ranges')
def win_level_ranges(spark, d):
    return level_ranges(spark, d)


@query(f"""{RANGES} SELECT symbol, CAST(range AS BIGINT) AS range, "begin", center, "end", round(CASE WHEN count(*) OVER s = 1 THEN 1.0 ELSE 1 - (row_number() OVER (PARTITION BY symbol ORDER BY range) - 1) / (count(*) OVER s - 1) END, 6) AS intensity
    FROM ranges WINDOW s AS (PARTITION BY symbol)""")
def win_range_intensity(spark, d):
    return profile.intensity(level_ranges(spark, d))


SPANS = f"""{RANGES}, inside AS (SELECT h.symbol, r.range, h."window", sum(h.volume) AS v FROM heat h JOIN ranges r ON h.symbol = r.symbol AND h.level BETWEEN r."begin" AND r."end" GROUP BY ALL),
    live AS (SELECT * FROM (SELECT *, v > greatest(max(v) OVER (PARTITION BY symbol, range) * 0.01, 2.220446049250313e-16) AS live FROM inside) WHERE live),
    i AS (SELECT *, "window" - row_number() OVER (PARTITION BY symbol, range ORDER BY "window") AS island FROM live),
    spans AS (SELECT symbol, CAST(range AS BIGINT) AS range, min("window") AS start, max("window") + 1 AS "end" FROM i GROUP BY symbol, range, island HAVING count(*) >= 2)"""


@query(f"{SPANS} SELECT * FROM spans")
def win_timeline_islands(spark, d):
    return profile.profile_tables(users(spark, d), 10, 24, 3)[2]


@query(f"""{USERS}, {PROFILE} SELECT grid.symbol, grid.level, round(grid.low + grid.level * grid.bin, 6) AS price, round(coalesce(sum(e.v), 0), 4) AS volume
    FROM grid LEFT JOIN e ON grid.symbol = e.symbol AND grid.level = e.level GROUP BY ALL""")
def udtf_volume_profile_sql(spark, d):
    """The profile as a table function, called from SQL."""
    profile.register_profile(spark)
    users(spark, d).createOrReplaceTempView("profiled_candles")
    return spark.sql("SELECT symbol, level, round(price, 6) AS price, abs(round(volume, 4)) AS volume FROM volume_profile(TABLE(profiled_candles) PARTITION BY (symbol) ORDER BY (t), 10)")


@query(f"""{SPANS} SELECT 'heat' AS kind, symbol, level AS a, "window" AS b, CAST(NULL AS BIGINT) AS c, volume AS v FROM heat
    UNION ALL SELECT 'range', symbol, range, "begin", "end", CAST(center AS DOUBLE) FROM ranges UNION ALL SELECT 'span', symbol, range, start, "end", NULL FROM spans""")
def udtf_volume_profile(spark, d):
    """The three tables, one below the other."""
    cells, ranges, times = profile.profile_tables(users(spark, d), 10, 24, 3)
    none = F.lit(None)
    cells = cells.select(F.lit("heat").alias("kind"), "symbol", F.col("level").alias("a"), F.col("window").alias("b"), none.cast("long").alias("c"), F.col("volume").alias("v"))
    ranges = ranges.select(F.lit("range"), "symbol", "range", "begin", "end", F.col("center").cast("double"))
    return cells.union(ranges).union(times.select(F.lit("span"), "symbol", "range", "start", "end", none.cast("double")))


@query(f"""{USERS}, x AS (SELECT *, lag(c) OVER {W} AS p, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS n FROM candles),
    g AS (SELECT symbol, max(h) AS high, min(l) AS low, round(sum(v), 6) AS volume FROM candles GROUP BY symbol)
    SELECT symbol, c AS last, round(coalesce(c - p, 0), 6) AS change, round(CASE WHEN coalesce(p, 0) = 0 THEN 0 ELSE (c - p) / p * 100 END, 6) AS change_pct, high, low, volume
    FROM x JOIN g USING (symbol) WHERE n = 1""")
def agg_series_stats(spark, d):
    return bars.series_stats(users(spark, d))


@query(f"{USERS} SELECT symbol, t, round(sma, 6) AS sma FROM (SELECT symbol, t, avg(c) OVER {frame(5)} AS sma, row_number() OVER {W} AS n FROM candles) WHERE n >= 5")
def win_sma(spark, d):
    return rounded(indicators.sma(users(spark, d), 5), "sma")


@query(f"""{USERS} SELECT symbol, t, round(m, 6) AS mid, round(m + 2 * s, 6) AS upper, round(m - 2 * s, 6) AS lower FROM
    (SELECT symbol, t, avg(c) OVER {frame(5)} AS m, stddev_pop(c) OVER {frame(5)} AS s, row_number() OVER {W} AS n FROM candles) WHERE n >= 5""")
def win_bollinger(spark, d):
    return rounded(indicators.bollinger(users(spark, d), 5, 2.0), "mid", "upper", "lower")


def wma_sql(value: str, name: str, source: str, p: int) -> str:
    return f"""(SELECT * EXCLUDE (wl, wn) FROM (SELECT *, list_sum(list_transform(wl, lambda x, i: x * i)) / {p * (p + 1) / 2} AS {name}
        FROM (SELECT *, list({value}) OVER {frame(p)} AS wl, row_number() OVER {W} AS wn FROM {source})) WHERE wn >= {p})"""


@query(f"{USERS} SELECT symbol, t, round(wma, 6) AS wma FROM {wma_sql('c', 'wma', 'candles', 5)}")
def win_wma(spark, d):
    return rounded(indicators.wma(users(spark, d), 5).select("symbol", "t", "wma"), "wma")


RRG = f"""{CANDLES}, bench AS (SELECT t, c AS bench FROM candles WHERE symbol = 'view'),
    r0 AS (SELECT symbol, t, 100 * c / bench AS rs FROM candles JOIN bench USING (t)), r1 AS {wma_sql('rs', 'once', 'r0', 6)}, r2 AS {wma_sql('once', 'ratio', 'r1', 6)},
    r3 AS (SELECT * FROM (SELECT *, lag(ratio, 6) OVER {W} AS old FROM r2) WHERE old IS NOT NULL), r4 AS (SELECT *, 100 + 100 * (ratio / old - 1) AS roc FROM r3)
    SELECT symbol, t, round(ratio, 6) AS ratio, round(momentum, 6) AS momentum FROM {wma_sql('roc', 'momentum', 'r4', 6)}"""


@query(RRG)
def win_rrg(spark, d):
    c = views.candles(spark, d)
    return rounded(indicators.relative_rotation(c, c.where("symbol = 'view'"), 6), "ratio", "momentum")


@query(f"""{CANDLES}, b AS (SELECT t FROM candles WHERE symbol = 'view') SELECT symbol, count(*) AS bars, count(b.t) AS paired, count(*) = (SELECT count(*) FROM b) AND count(b.t) = (SELECT count(*) FROM b) AS valid
    FROM candles LEFT JOIN b USING (t) GROUP BY symbol""")
def jn_rrg_benchmark(spark, d):
    c = views.candles(spark, d)
    return indicators.unpaired(c, c.where("symbol = 'view'"))


LISTS = f"{USERS}, x AS (SELECT symbol, t, list(c) OVER (PARTITION BY symbol ORDER BY t) AS l FROM candles)"


def ema_sql(values: str, p: int, seed: int) -> str:
    a = 2 / (p + 1)
    start = f"list_concat([list_avg({values}[1:{seed}])], {values}[{seed + 1}:])"
    return f"list_reduce({start}, lambda a, x: {a!r} * x + {1 - a!r} * a)"


@query(f"{LISTS} SELECT symbol, t, round({ema_sql('l', 5, 1)}, 6) AS ema FROM x")
def win_ema_first(spark, d):
    return rounded(indicators.ema_first(users(spark, d), 5), "ema")


@query(f"{LISTS} SELECT symbol, t, round({ema_sql('l', 5, 5)}, 6) AS ema FROM x WHERE len(l) >= 5")
def win_ema_sma(spark, d):
    return rounded(indicators.ema_sma(users(spark, d), 5), "ema")


@query(f"""{LISTS}, m AS (SELECT symbol, t, {ema_sql('l', 4, 4)} - {ema_sql('l', 8, 8)} AS macd FROM x WHERE len(l) >= 8),
    s AS (SELECT symbol, t, macd, list(macd) OVER (PARTITION BY symbol ORDER BY t) AS ml FROM m),
    q AS (SELECT symbol, t, macd, CASE WHEN len(ml) >= 3 THEN {ema_sql('ml', 3, 3)} END AS signal FROM s)
    SELECT symbol, t, round(macd, 6) AS macd, round(signal, 6) AS signal, round(macd - signal, 6) AS histogram FROM q""")
def win_macd(spark, d):
    return rounded(indicators.macd(users(spark, d), 4, 8, 3), "macd", "signal", "histogram")


def wilder(values: str, p: int) -> str:
    return f"list_reduce(list_concat([list_avg({values}[1:{p}])], {values}[{p + 1}:]), lambda a, x: (a * {p - 1} + x) / {p})"


@query(f"""{USERS}, y AS (SELECT symbol, t, c - lag(c) OVER {W} AS dc FROM candles), z AS (SELECT symbol, t, list(dc) FILTER (dc IS NOT NULL) OVER (PARTITION BY symbol ORDER BY t) AS l FROM y),
    g AS (SELECT symbol, t, list_transform(l, lambda x: greatest(x, 0)) AS up, list_transform(l, lambda x: greatest(-x, 0)) AS down FROM z WHERE len(l) >= 6),
    r AS (SELECT symbol, t, CASE WHEN {wilder('down', 5)} = 0 THEN 100 ELSE {wilder('up', 5)} / {wilder('down', 5)} END AS rs FROM g)
    SELECT symbol, t, round(100 - 100 / (1 + rs), 6) AS rsi, 100 - 100 / (1 + rs) > 70 AS overbought, 100 - 100 / (1 + rs) < 30 AS oversold FROM r""")
def win_rsi(spark, d):
    return rounded(indicators.rsi(users(spark, d), 5), "rsi")


INDEXED = f"{USERS}, x AS (SELECT *, row_number() OVER {W} - 1 AS i FROM candles)"


@query(f"""{INDEXED}, y AS (SELECT *, lag(o) OVER {W} AS p, lead(o) OVER {W} AS n FROM x)
    SELECT symbol, t, i, o, CASE WHEN o > p AND o > n THEN 'top' ELSE 'bottom' END AS kind FROM y WHERE o > p AND o > n OR o < p AND o < n""")
def win_reverse_points(spark, d):
    return patterns.reverse_points(users(spark, d))


@query(f"""{INDEXED}, y AS (SELECT *, lag(h) OVER {W} AS ph, lag(l) OVER {W} AS pl FROM x)
    SELECT symbol, t, i, CASE WHEN o > ph THEN 'up' ELSE 'down' END AS kind, round(CASE WHEN o > ph THEN o - ph ELSE o - pl END, 6) AS size FROM y WHERE o > ph OR o < pl""")
def win_gaps(spark, d):
    return patterns.gaps(users(spark, d))


@query(f"""{INDEXED}, y AS (SELECT symbol, t, i, count(*) OVER (PARTITION BY symbol) AS n,
    h > max(h) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND h > max(h) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS high,
    l < min(l) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND l < min(l) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS low FROM x)
    SELECT symbol, t, i, high, low FROM y WHERE i >= 3 AND i < n - 3 AND (high OR low)""")
def win_swings(spark, d):
    return patterns.swings(users(spark, d), 3)


@query(f"""{USERS}, y AS (SELECT symbol, t, c, count(*) OVER (PARTITION BY symbol) AS n, list(c) OVER {frame(2)} AS l2, list(c) OVER {frame(5)} AS l5, list(c) OVER {frame(10)} AS l10 FROM candles),
    z AS (SELECT symbol, t, n, 2 AS size, len(list_filter(l2, lambda x: x > c)) AS rank FROM y UNION ALL SELECT symbol, t, n, 5, len(list_filter(l5, lambda x: x > c)) FROM y
        UNION ALL SELECT symbol, t, n, 10, len(list_filter(l10, lambda x: x > c)) FROM y)
    SELECT symbol, t, CAST(size AS INTEGER) AS size, rank FROM z WHERE size <= n / 2""")
def win_pivot_rank(spark, d):
    return patterns.pivot_ranks(users(spark, d), [2, 5, 10])


@query(f"""{USERS}, y AS (SELECT symbol, t, c, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER {W} AS i, list(c) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS l FROM candles),
    z AS (SELECT *, unnest(generate_series(0, n // 3)) AS size FROM y)
    SELECT symbol, t, CAST(size AS INTEGER) AS size, CAST(len(list_filter(list_slice(l, greatest(i - size + 1, 1), i), lambda x: x > c)) AS BIGINT) AS rank FROM z""")
def win_pivot_rank_all(spark, d):
    """All sizes from 0 to a third of the series."""
    return patterns.pivot_ranks_all(users(spark, d))


@query(f"""{USERS}, y AS (SELECT *, list(c) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, list(c) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS b FROM candles),
    z AS (SELECT symbol, t, (c - o) / CASE WHEN h <> l THEN h - l END AS s, coalesce(len(list_filter(a, lambda x: x > c)), 0) AS p, coalesce(len(list_filter(b, lambda x: x > c)), 0) AS q FROM y)
    SELECT symbol, t, round(s, 6) AS spread, round(1 - p * q / 16.0, 6) AS peak FROM z""")
def win_pivot_shape(spark, d):
    return patterns.pivot_shape(users(spark, d), 4)


STORED = f"{USERS}, stored AS (SELECT * FROM candles WHERE t < 1705276800 + 86400), fetched AS (SELECT symbol, t, o, h + 1 AS h, l, c, v, last_qty FROM candles WHERE t >= 1705276800)"


def halves(spark, d):
    c = users(spark, d)
    return c.where(F.col("t") < 1705276800 + 86400), c.where("t >= 1705276800").withColumn("h", F.col("h") + 1)


@query(f"{STORED} SELECT * FROM stored UNION ALL SELECT f.* FROM fetched f ANTI JOIN stored s USING (symbol, t)")
def win_candle_dedup(spark, d):
    return bars.merged_bars(*halves(spark, d))


@query(f"{STORED} SELECT * FROM fetched UNION ALL SELECT s.* FROM stored s ANTI JOIN fetched f USING (symbol, t)")
def jn_backfill_anti(spark, d):
    stored, fetched = halves(spark, d)
    return bars.backfill(fetched, stored)


@query(f"{USERS} SELECT * FROM candles WHERE t BETWEEN 1704672000 AND 1705276800")
def flt_time_range(spark, d):
    """Of bars that have landed by month."""
    path = scratch(spark, "bars")
    history.land(users(spark, d), path, "t")
    return bars.in_range(history.read(spark, path), 1704672000, 1705276800)


@query(f"{USERS} SELECT *, c >= o AS up FROM candles")
def win_candle_color(spark, d):
    return bars.heat_colour(users(spark, d))


@query(f"""{USERS} SELECT symbol, t, x, y FROM (SELECT symbol, t, (row_number() OVER {W} - 1) / (count(*) OVER (PARTITION BY symbol) - 1) AS x, count(*) OVER (PARTITION BY symbol) AS n,
    round(CASE WHEN max(c) OVER (PARTITION BY symbol) = min(c) OVER (PARTITION BY symbol) THEN 0 ELSE (c - min(c) OVER (PARTITION BY symbol)) / (max(c) OVER (PARTITION BY symbol) - min(c) OVER (PARTITION BY symbol)) END, 6) AS y FROM candles) WHERE n > 1""")
def win_spark_norm(spark, d):
    return rounded(indicators.normalised(users(spark, d), "c", ("symbol",), "t"), "y")


@query(f"{USERS} SELECT symbol, t * 1000 AS t, o, h, l, c, v, last_qty FROM candles ORDER BY symbol, t")
def srt_candles(spark, d):
    return users(spark, d).orderBy("symbol", "t").withColumn("t", F.col("t") * 1000)


FETCHED = f"{USERS}, fetched AS (SELECT symbol, t AS start, t + 3 * 86400 AS \"end\" FROM candles WHERE t // 14400 % 5 = 0)"
BLOCKS = """SELECT {keys}, block, greatest(start, block * 604800) AS start, least("end", (block + 1) * 604800) AS "end" FROM (SELECT *, unnest(generate_series(start // 604800, "end" // 604800)) AS block FROM {source})"""


def fetched_ranges(spark, d):
    return users(spark, d).where("floor(t / 14400) % 5 = 0").select("symbol", F.col("t").alias("start"), (F.col("t") + 3 * 86400).alias("end"))


COVER = f"""{FETCHED}, cover AS (SELECT symbol, block, min(start) AS cov_from, max("end") AS cov_to FROM ({BLOCKS.format(keys='symbol', source='fetched')}) GROUP BY ALL)"""


@query(f"{COVER} SELECT * FROM cover")
def agg_coverage(spark, d):
    return bars.coverage(fetched_ranges(spark, d))


@query(f"""{COVER}, asked AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS symbol, ts_us // 1000000 AS start, ts_us // 1000000 + 86400 * (1 + event_id % 10) AS "end" FROM ticks),
    need AS (SELECT id, symbol, block, coalesce(n.start >= cov_from AND n."end" <= cov_to, false) AS ok FROM ({BLOCKS.format(keys='id, symbol', source='asked')}) n LEFT JOIN cover USING (symbol, block))
    SELECT id, symbol, bool_and(ok) AS hit, coalesce(list(block ORDER BY block) FILTER (NOT ok), []) AS missing FROM need GROUP BY id, symbol""")
def jn_coverage_range(spark, d):
    t = views.ticks(spark, d)
    start = F.floor(F.col("ts_us") / 1000000)
    asked = t.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("symbol"), start.alias("start"), (start + 86400 * (1 + F.col("event_id") % 10)).alias("end"))
    return bars.coverage_of(asked, bars.coverage(fetched_ranges(spark, d)))


RESOLUTIONS = ("1", "5", "1D", "1m", "4h")
NOW = 1706600000


@query(f"""{USERS}, r AS (SELECT DISTINCT symbol, ['1', '5', '1D', '1m', '4h'][1 + CAST(symbol AS BIGINT) % 5] AS resolution FROM candles),
    u AS (SELECT symbol, resolution, max(t) AS updated_at FROM candles JOIN r USING (symbol) WHERE CAST(symbol AS BIGINT) % 7 > 0 GROUP BY ALL)
    SELECT symbol, resolution, updated_at, coalesce({NOW} - updated_at > CASE WHEN resolution IN ('1', '5') THEN 60 WHEN resolution IN ('1D', '1W', '1M') THEN 3600 ELSE 300 END, true) AS stale FROM r LEFT JOIN u USING (symbol, resolution)""")
def agg_freshness(spark, d):
    c = users(spark, d)
    res = F.element_at(F.array(*map(F.lit, RESOLUTIONS)), (F.col("symbol").cast("long") % 5 + 1).cast("int"))
    c = c.withColumn("resolution", res)
    loaded = c.where("CAST(symbol AS BIGINT) % 7 > 0").select("symbol", "resolution", F.col("t").alias("updated_at"))
    return bars.freshness(c.select("symbol", "resolution").distinct(), loaded, F.lit(NOW))


@query(f"""WITH {TICKS}, r AS (SELECT event_id AS id, ['1H', '1D', '1W', '4h'][1 + event_id % 4] AS resolution, CAST(quantity AS BIGINT) AS look_back FROM ticks)
    SELECT id, resolution, look_back, CASE resolution WHEN '1H' THEN '1m' WHEN '1D' THEN '1H' ELSE '1D' END AS source, {NOW} - look_back * CASE resolution WHEN '1H' THEN 3600 WHEN '1D' THEN 86400 ELSE 604800 END AS start FROM r WHERE resolution <> '4h'""")
def prj_lookback(spark, d):
    t = views.ticks(spark, d)
    res = F.element_at(F.array(*map(F.lit, ("1H", "1D", "1W", "4h"))), (F.col("event_id") % 4 + 1).cast("int"))
    return bars.lookback(t.select(F.col("event_id").alias("id"), res.alias("resolution"), F.col("quantity").cast("long").alias("look_back")), F.lit(NOW))


@query(f"{USERS} SELECT symbol, t, round(sma, 6) AS sma FROM (SELECT symbol, t, avg(c) OVER {frame(7)} AS sma, row_number() OVER {W} AS n FROM candles) WHERE n >= 7")
def udf_indicator_registry(spark, d):
    return rounded(users(spark, d).transform(indicators.indicator("MA", period=7)), "sma")


@query(f"{USERS}, {HEAT} SELECT * FROM heat")
def udf_indicator_heatmap(spark, d):
    return users(spark, d).transform(indicators.indicator("HEATMAP", levels=10, hours=24, overlap=3))
