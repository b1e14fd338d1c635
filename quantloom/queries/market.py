"""Bars, resampling, calendars and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins
from ..plans import strategies
from ..sources import bars, calendars
from .base import query, r6, rounded

C = F.col


@query("SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM mkt", "mkt")
def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bars.market_bars(spark, sf))


@query("SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM brand", "brand")
def bars_brand(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bars.brand_bars(spark, sf))


@query("SELECT symbol, date AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM evt_h", "evt_h")
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bars.event_bars(spark, sf, "hour").withColumnRenamed("date", "ts"))


@query("""
SELECT upper(p_brand) AS symbol, l_shipdate::DATE AS date, round(px, 6) AS open, round(px * 2, 6) AS high, NULL::DOUBLE AS low, round(CASE WHEN l_quantity % 7 <> 0 THEN px END, 6) AS close, l_quantity::DOUBLE AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem JOIN part ON l_partkey = p_partkey)
QUALIFY row_number() OVER (PARTITION BY p_brand, l_shipdate::DATE ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")
def bars_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as raw rows of a source: late in the evening with an offset, NaN for some closes, several a day."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = bars.read_table(spark, sf, "lineitem").select(*keys, "l_quantity", "l_shipdate")
    parts = bars.read_table(spark, sf, "part").select(C("p_partkey").alias("l_partkey"), F.concat(F.lit(" "), F.lower("p_brand")).alias("Symbol"))
    px = C("l_extendedprice") / C("l_quantity")
    stamp = F.concat(C("l_shipdate").cast("date").cast("string"), F.lit("T23:30:00-05:00"))
    raw = lines.join(parts, "l_partkey").select("Symbol", stamp.alias("Date"), px.alias("Open"), (px * 2).alias("HIGH"), F.when(C("l_quantity") % 7 == 0, float("nan")).otherwise(px).alias("close"), C("l_quantity").alias("Volume"), F.lit("x").alias("Dividends"), *keys)
    return rounded(bars.normalise(raw, keys))


_RESAMPLE = """
SELECT symbol, max(date) AS date, round(arg_min(open, date), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, date), 6) AS close, sum(volume)::BIGINT AS volume
FROM brand GROUP BY symbol, date_trunc('{}', date)"""


@query(_RESAMPLE.format("week"), "brand")
def resample_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bars.resample(bars.brand_bars(spark, sf), "week"))


@query(_RESAMPLE.format("month"), "brand")
def resample_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bars.resample(bars.brand_bars(spark, sf), "month"))


@query("""
WITH wk AS (SELECT symbol, max(date) AS date, arg_max(close, date) AS c FROM brand GROUP BY symbol, date_trunc('week', date))
SELECT b.symbol, b.date, round(b.close, 6) AS close, round(last_value(w.c IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date), 6) AS weekly_close
FROM brand b LEFT JOIN wk w ON b.symbol = w.symbol AND b.date = w.date""", "brand")
def resample_ffill_daily(spark: SparkSession, sf: str) -> DataFrame:
    daily = bars.brand_bars(spark, sf).select("symbol", "date", "close")
    weekly = bars.resample(bars.brand_bars(spark, sf), "week").select("symbol", "date", C("close").alias("weekly_close"))
    return rounded(joins.exact_join_ffill(daily, weekly, ["weekly_close"], by=["symbol"]))


@query("""
WITH span AS (SELECT symbol, min(date) AS f, max(date) AS l FROM brand GROUP BY symbol),
cal AS (SELECT d::DATE AS date FROM (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6),
g AS (SELECT symbol, date FROM span JOIN cal ON date BETWEEN f AND l),
x AS (SELECT g.symbol, g.date, last_value(b.open IGNORE NULLS) OVER w AS open, last_value(b.close IGNORE NULLS) OVER w AS close, last_value(b.volume IGNORE NULLS) OVER w AS volume
  FROM g LEFT JOIN brand b USING (symbol, date) WINDOW w AS (PARTITION BY g.symbol ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT symbol, date, round(open, 6) AS open, round(close, 6) AS close, volume FROM x WHERE close IS NOT NULL""", "brand")
def calendar_reindex_ffill5(spark: SparkSession, sf: str) -> DataFrame:
    out = bars.reindex(bars.brand_bars(spark, sf), bars.weekdays(spark, "1994-01-01", "2002-12-31"))
    return rounded(out.select("symbol", "date", "open", "close", "volume"))


@query("""
WITH o AS (SELECT symbol, date, close FROM brand WHERE date <= DATE '1997-06-30'), n AS (SELECT symbol, date, close * 2 AS close FROM brand WHERE date >= DATE '1997-01-01')
SELECT symbol, date, round(coalesce(n.close, o.close), 6) AS close FROM o FULL JOIN n USING (symbol, date)""", "brand")
def cache_upsert_dedup(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.brand_bars(spark, sf).select("symbol", "date", "close")
    old, new = b.where("date <= DATE'1997-06-30'"), b.where("date >= DATE'1997-01-01'").withColumn("close", C("close") * 2)
    return rounded(bars.upsert(old, new, ["symbol", "date"]))


@query("""
WITH s AS (SELECT symbol, min(date) AS f, max(date) AS l, count(*) AS n_bars FROM brand GROUP BY symbol),
cal AS (SELECT d::DATE AS date FROM (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6)
SELECT symbol, n_bars, count(*) AS n_sessions, n_bars < 0.90 * count(*) AS stale FROM s JOIN cal ON date BETWEEN f AND l GROUP BY symbol, n_bars""", "brand")
def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    return bars.coverage(bars.brand_bars(spark, sf), bars.weekdays(spark, "1994-01-01", "2002-12-31"))


@query("""
SELECT symbol, date, coalesce(weekofyear(date) <> lag(weekofyear(date)) OVER w, true) AS weekly, coalesce(month(date) <> lag(month(date)) OVER w, true) AS monthly,
  coalesce(quarter(date) <> lag(quarter(date)) OVER w, true) AS quarterly FROM mkt WINDOW w AS (PARTITION BY symbol ORDER BY date)""", "mkt")
def rebalance_days(spark: SparkSession, sf: str) -> DataFrame:
    return calendars.rebalance_flags(bars.market_bars(spark, sf).select("symbol", "date"), {s: s for s in ("weekly", "monthly", "quarterly")})


def _nth_sql(month: int, weekday: int, n: int) -> str:
    """The n-th weekday (1 Monday) of a month of year y."""
    return f"make_date(y, {month}, 1) + ((7 + {weekday} - isodow(make_date(y, {month}, 1))) % 7 + {7 * (n - 1)})::INTEGER"


def _moved_sql(month: int, day: int) -> str:
    d = f"make_date(y, {month}, {day})"
    return f"{d} + (CASE isodow({d}) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END)"


@query(f"""
WITH y AS (SELECT unnest(generate_series(1992, 2030))::INTEGER AS y), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a), k AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM h),
n AS (SELECT y, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS n FROM k),
x AS (SELECT make_date(y, n // 31, n % 31 + 1) - 2 AS date FROM n UNION SELECT CASE WHEN isodow(make_date(y, 1, 1)) = 6 THEN NULL ELSE {_moved_sql(1, 1)} END FROM y
  UNION SELECT {_nth_sql(1, 1, 3)} FROM y WHERE y >= 1998 UNION SELECT {_nth_sql(2, 1, 3)} FROM y UNION SELECT make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INTEGER FROM y
  UNION SELECT {_moved_sql(6, 19)} FROM y WHERE y >= 2022 UNION SELECT {_moved_sql(7, 4)} FROM y UNION SELECT {_nth_sql(9, 1, 1)} FROM y UNION SELECT {_nth_sql(11, 4, 4)} FROM y UNION SELECT {_moved_sql(12, 25)} FROM y)
SELECT date, m.volume FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM mkt) LEFT JOIN mkt m USING (date) WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM x WHERE date IS NOT NULL)""", "mkt")
def calendar_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Exchange sessions by rule over the market's span, with what was traded on them; checked in the tests against known
    closing days."""
    m = bars.market_bars(spark, sf).select("date", "volume")
    return calendars.sessions(spark, *bars.span(m)).join(m, "date", "left")


_FILINGS = "fil AS (SELECT c_mktsegment AS symbol, o_orderdate::DATE AS filed, o_orderpriority AS metric, o_totalprice AS value, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""
WITH {_FILINGS}, l AS (SELECT symbol, filed, arg_max(value, (filed, o_orderkey, value)) AS value FROM fil GROUP BY symbol, filed),
d AS (SELECT s.symbol, m.date FROM mkt m, (SELECT DISTINCT symbol FROM fil) s)
SELECT d.symbol, d.date, round(l.value, 6) AS value, l.filed FROM d ASOF LEFT JOIN l ON d.symbol = l.symbol AND d.date >= l.filed""", "mkt")
def asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    f = _filings(spark, sf)
    last = f.groupBy("symbol", C("filed_date").alias("date")).agg(F.max_by("value", F.struct("o_orderkey", "value")).alias("value")).withColumn("filed", C("date"))
    probes = f.select("symbol").distinct().crossJoin(bars.market_bars(spark, sf).select("date"))  # a row a segment and day
    return rounded(joins.asof_join(probes, last, on="date", by=["symbol"]))


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    orders = bars.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    customers = bars.read_table(spark, sf, "customer").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("symbol"))
    return orders.join(customers, "o_custkey").select("symbol", C("o_orderdate").cast("date").alias("filed_date"), C("o_orderpriority").alias("metric"), C("o_totalprice").alias("value"), "o_orderkey")


@query(f"""
WITH {_FILINGS}, l AS (SELECT symbol, metric, filed, arg_max(value, (o_orderkey, value)) AS value FROM fil GROUP BY ALL),
p AS (SELECT s.symbol, m.metric, a.as_of FROM (SELECT DISTINCT symbol FROM fil) s, (SELECT DISTINCT metric FROM fil) m, (SELECT unnest([DATE '1996-06-30', DATE '1998-12-31', DATE '2000-03-15']) AS as_of) a)
SELECT p.symbol, p.metric, p.as_of, round(l.value, 6) AS value FROM p ASOF LEFT JOIN l ON p.symbol = l.symbol AND p.metric = l.metric AND p.as_of >= l.filed""")
def asof_pit_kv(spark: SparkSession, sf: str) -> DataFrame:
    """The latest value of each (symbol, field) known on some days."""
    f = _filings(spark, sf)
    days = spark.sql("SELECT explode(array(DATE'1996-06-30', DATE'1998-12-31', DATE'2000-03-15')) AS as_of")
    known = f.join(days, C("filed_date") <= C("as_of")).groupBy("symbol", "metric", "as_of").agg(F.max_by("value", F.struct("filed_date", "o_orderkey", "value")).alias("value"))
    keys = f.select("symbol").distinct().crossJoin(f.select("metric").distinct()).crossJoin(days)
    return rounded(keys.join(known, ["symbol", "metric", "as_of"], "left"))


@query(f"""
WITH {_FILINGS}, l AS (SELECT symbol, filed AS date, round(avg(value), 6) AS value FROM fil GROUP BY symbol, filed), s AS (SELECT DISTINCT symbol FROM fil)
SELECT s.symbol, m.date, round(m.close, 6) AS close, last_value(l.value IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY m.date) AS value FROM mkt m CROSS JOIN s LEFT JOIN l ON l.symbol = s.symbol AND l.date = m.date""", "mkt")
def exact_join_ffill(spark: SparkSession, sf: str) -> DataFrame:
    f = _filings(spark, sf)
    daily = f.groupBy("symbol", C("filed_date").alias("date")).agg(r6(F.avg("value")).alias("value"))
    m = f.select("symbol").distinct().crossJoin(bars.market_bars(spark, sf).select("date", "close"))  # a row a segment and day
    return rounded(joins.exact_join_ffill(m, daily, ["value"], by=["symbol"]))


@query("""
WITH s AS (SELECT symbol, coalesce(lead(symbol) OVER (ORDER BY symbol), first_value(symbol) OVER (ORDER BY symbol)) AS other FROM (SELECT DISTINCT symbol FROM brand)),
b AS (SELECT s.symbol, date, close AS vix_3m FROM brand JOIN s ON s.other = brand.symbol),
j AS (SELECT symbol, date, a.close AS vix_close, vix_3m FROM brand a FULL JOIN b USING (symbol, date)),
f AS (SELECT symbol, date, last_value(vix_close IGNORE NULLS) OVER w AS vix_close, last_value(vix_3m IGNORE NULLS) OVER w AS vix_3m FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, round(vix_close, 6) AS vix_close, round(vix_3m, 6) AS vix_3m, round(vix_close / nullif(vix_3m, 0), 6) AS vix_ratio,
  CASE WHEN vix_close / nullif(vix_3m, 0) < 1 THEN 'contango' WHEN vix_close / nullif(vix_3m, 0) >= 1 THEN 'backwardation' END AS vix_regime FROM f""", "brand")
def outer_align_ffill(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's series with the next one's, each without the days on which nothing of its brand was sold."""
    a = bars.brand_bars(spark, sf).select("symbol", "date", C("close").alias("vix_close"))
    in_turn = Window.orderBy("symbol")  # a row a symbol
    pairs = a.select("symbol").distinct().withColumn("other", F.coalesce(F.lead("symbol").over(in_turn), F.first("symbol").over(in_turn)))
    b = a.select(C("symbol").alias("other"), "date", C("vix_close").alias("vix_3m")).join(F.broadcast(pairs), "other").drop("other")
    return rounded(joins.term_structure(joins.outer_align([a, b], "date", ["symbol"])))


@query("""
WITH d AS (SELECT DISTINCT date FROM evt), t AS (SELECT ts::DATE AS filed, CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'error' THEN -value END AS shares FROM events WHERE event_type IN ('purchase', 'error'))
SELECT d.date, round(coalesce(sum(shares) FILTER (filed >= d.date - 30), 0), 6) AS net_shares_30d, count(*) FILTER (shares > 0)::BIGINT AS buys_90d, count(*) FILTER (shares < 0)::BIGINT AS sells_90d
FROM d LEFT JOIN t ON filed BETWEEN d.date - 90 AND d.date GROUP BY d.date""", "evt")
def range_window_30_90d(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar-day windows, both ends counted, over daily sums: no row meets more than its own day."""
    e = bars.read_table(spark, sf, "events").where("event_type in ('purchase', 'error')")
    shares = F.when(C("event_type") == "purchase", C("value")).otherwise(-C("value"))
    daily = e.select(C("ts").cast("date").alias("filed_date"), shares.alias("shares")).groupBy("filed_date").agg(
        F.sum("shares").alias("net"), F.count(F.when(C("shares") > 0, 1)).alias("b"), F.count(F.when(C("shares") < 0, 1)).alias("s")
    )
    days = bars.event_bars(spark, sf).select("date").distinct()
    out = joins.interval_sums(days, daily, {"net_shares_30d": ("net", 30), "buys_90d": ("b", 90), "sells_90d": ("s", 90)}, "date", "filed_date")
    return rounded(out.select("date", "net_shares_30d", C("buys_90d").cast("long").alias("buys_90d"), C("sells_90d").cast("long").alias("sells_90d")))


@query("SELECT symbol, date, round(close, 6) AS close FROM brand WHERE symbol IN (SELECT p_brand FROM part WHERE p_size <= 10 GROUP BY p_brand HAVING count(*) > (SELECT count(*) FROM part WHERE p_size <= 10) / 25.0)", "brand")
def semi_universe(spark: SparkSession, sf: str) -> DataFrame:
    """The brands with more small parts than a brand has on average."""
    members = bars.read_table(spark, sf, "part").where("p_size <= 10").groupBy(C("p_brand").alias("symbol")).count()
    members = members.crossJoin(members.agg(F.sum("count").alias("all"))).where("count > all / 25.0")
    return rounded(bars.brand_bars(spark, sf).select("symbol", "date", "close").join(members, "symbol", "left_semi"))


@query("""
WITH snap AS (SELECT DISTINCT date_trunc('month', date)::DATE AS snap FROM brand WHERE month(date) IN (1, 7)), mem AS (SELECT snap, symbol FROM (SELECT date_trunc('month', date)::DATE AS snap, symbol, sum(volume) AS v FROM brand WHERE month(date) IN (1, 7) AND day(date) <= 10 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY snap ORDER BY v DESC, symbol) <= 15),
d AS (SELECT b.symbol, b.date, b.close, s.snap FROM brand b ASOF LEFT JOIN snap s ON b.date >= s.snap)
SELECT symbol, date, round(close, 6) AS close FROM d WHERE snap IS NULL OR EXISTS (SELECT 1 FROM mem WHERE mem.snap = d.snap AND mem.symbol = d.symbol)""", "brand")
def historical_universe(spark: SparkSession, sf: str) -> DataFrame:
    """An index of the 15 brands most traded in the first ten days of each half-year."""
    b = bars.brand_bars(spark, sf).select("symbol", "date", "close", "volume")
    named = b.where("month(date) in (1, 7)").withColumn("snap", F.trunc("date", "month"))
    traded = named.where("day(date) <= 10").groupBy("snap", "symbol").agg(F.sum("volume").alias("v"))
    place = F.row_number().over(Window.partitionBy("snap").orderBy(F.desc("v"), "symbol"))
    members = traded.withColumn("place", place).where("place <= 15").select("snap", "symbol")
    return rounded(joins.universe_filter(b.drop("volume"), members, named.select("snap").distinct()))


@query("SELECT DISTINCT symbol FROM brand WHERE symbol NOT IN (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5)", "brand")
def anti_holdings(spark: SparkSession, sf: str) -> DataFrame:
    top = bars.read_table(spark, sf, "part").groupBy(C("p_brand").alias("symbol")).count().orderBy(F.desc("count"), "symbol").limit(5)
    return bars.brand_bars(spark, sf).select("symbol").distinct().join(top, "symbol", "left_anti")


@query("""
WITH s AS (SELECT p_brand AS symbol, arg_max(p_type, p_partkey) AS sector FROM part WHERE p_size > 25 GROUP BY p_brand)
SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS n_bars, round(sum(close * volume), 2) AS value FROM brand LEFT JOIN s USING (symbol) GROUP BY 1""", "brand")
def broadcast_sector(spark: SparkSession, sf: str) -> DataFrame:
    sectors = bars.read_table(spark, sf, "part").where("p_size > 25").groupBy(C("p_brand").alias("symbol")).agg(F.max_by("p_type", "p_partkey").alias("sector"))
    b = bars.brand_bars(spark, sf).join(sectors, "symbol", "left")
    return b.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.count(F.lit(1)).alias("n_bars"), F.round(F.sum(C("close") * C("volume")), 2).alias("value"))


@query("""WITH g AS (SELECT f AS fast, s AS slow, a AS alloc, (row_number() OVER (ORDER BY f, s, a) - 1)::BIGINT AS combo FROM (SELECT unnest([5, 10, 20]) AS f), (SELECT unnest([50, 100]) AS s), (SELECT unnest([0.1, 0.25]::DOUBLE[]) AS a))
SELECT symbol, n_bars, fast, slow, alloc, combo FROM g CROSS JOIN (SELECT symbol, count(*) AS n_bars FROM brand GROUP BY symbol) WHERE n_bars >= slow""", "brand")
def cross_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of a search: every combination for each brand that has as many bars as its slow mean needs."""
    from ..operators.research import parameter_grid

    grid = parameter_grid(spark, {"fast": [5, 10, 20], "slow": [50, 100], "alloc": [0.1, 0.25]})
    held = bars.brand_bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    return held.crossJoin(F.broadcast(grid)).where("n_bars >= slow").select("symbol", "n_bars", "fast", "slow", "alloc", "combo")


@query("SELECT date FROM mkt INTERSECT SELECT date FROM evt UNION SELECT date FROM mkt EXCEPT SELECT date FROM evt", "mkt", "evt")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    m, e = bars.market_bars(spark, sf).select("date"), bars.event_bars(spark, sf).select("date")
    return m.intersect(e).union(m).distinct().exceptAll(e.distinct())


@query("""
SELECT symbol, round(avg(close), 6) AS close, round(max(volume), 6)::BIGINT AS volume, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY close DESC, date) AS rank FROM brand) WHERE rank <= 3 GROUP BY symbol, rank""", "brand")
def topk_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("close"), "date")
    return rounded(bars.brand_bars(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("symbol", "close", "volume", "rank"))


@query("""
WITH x AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS t, row_number() OVER (PARTITION BY date ORDER BY close, symbol) AS b FROM brand)
SELECT 'top' AS side, symbol, date, round(close, 6) AS close, t::INTEGER AS rank FROM x WHERE t <= 3 UNION ALL SELECT 'bottom', symbol, date, round(close, 6), b::INTEGER FROM x WHERE b <= 3""", "brand")
def rank_extremes(spark: SparkSession, sf: str) -> DataFrame:
    b = bars.brand_bars(spark, sf).select("symbol", "date", "close")
    sides = [strategies.ranked(b, "close", 3, side == "top").select(F.lit(side).alias("side"), "symbol", "date", "close", "rank") for side in ("top", "bottom")]
    return rounded(sides[0].unionByName(sides[1]))
