"""Fundamentals and macro enrichment on the mapped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fundamentals as U
from ..operators.joins import asof_join
from ..plans import strategies
from ..session import shared_dir
from ..sources import bars
from ..sources import filings as files
from .base import query, rounded
from .indicators import _roll

C = F.col
METRICS = {"1-URGENT": "revenue", "2-HIGH": "net_income", "3-MEDIUM": "total_assets", "4-NOT SPECIFIED": "total_debt", "5-LOW": "operating_cf"}
_NAMES = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRICS.items()) + " END"
_FIL = f"fil AS (SELECT c_mktsegment AS symbol, {_NAMES} AS metric, o_orderdate::DATE AS period_end, o_orderdate::DATE + 30 AS filed_date, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def filings(spark: SparkSession, sf: str) -> DataFrame:
    orders = bars.read_table(spark, sf, "orders").select("o_custkey", C("o_orderdate").cast("date").alias("period_end"), "o_orderpriority", "o_totalprice")
    customers = bars.read_table(spark, sf, "customer").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("symbol"))
    name = F.coalesce(*[F.when(C("o_orderpriority") == k, v) for k, v in METRICS.items()])
    rows = orders.join(customers, "o_custkey").groupBy("symbol", name.alias("metric"), "period_end").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return rows.withColumn("filed_date", F.date_add("period_end", 30))


_STATE = f"{_FIL}, p AS (SELECT symbol, filed_date, " + ", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in METRICS.values()) + " FROM fil GROUP BY symbol, filed_date), st AS (SELECT symbol, filed_date, " + ", ".join(f"last_value({m} IGNORE NULLS) OVER w AS fund_{m}" for m in METRICS.values()) + " FROM p WINDOW w AS (PARTITION BY symbol ORDER BY filed_date))"


@query(f"WITH {_STATE} SELECT symbol, filed_date, {', '.join(f'fund_{m}' for m in METRICS.values())} FROM st")
def fund_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return U.pivot_state(filings(spark, sf), list(METRICS.values()))


@query(f"""WITH {_FIL}, ro AS (SELECT symbol, metric, period_end, sum(value) OVER (PARTITION BY symbol, metric ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ttm FROM fil),
d AS (SELECT s.symbol, m.metric, s.filed_date FROM (SELECT DISTINCT symbol, filed_date FROM fil) s JOIN (SELECT DISTINCT symbol, metric FROM fil) m USING (symbol))
SELECT d.symbol, d.metric, d.filed_date, round(ro.ttm, 2) AS ttm FROM d ASOF LEFT JOIN ro ON d.symbol = ro.symbol AND d.metric = ro.metric AND d.filed_date >= ro.period_end""")
def fund_ttm(spark: SparkSession, sf: str) -> DataFrame:
    return U.trailing_sums(filings(spark, sf)).select("symbol", "metric", "filed_date", F.round("ttm", 2).alias("ttm"))


@query(f"""WITH {_STATE}, b AS (SELECT s.symbol, m.date, m.close FROM mkt m, (SELECT DISTINCT symbol FROM fil) s)
SELECT b.symbol, b.date, round(b.close, 6) AS close, {', '.join(f'st.fund_{m}' for m in METRICS.values())} FROM b ASOF LEFT JOIN st ON b.symbol = st.symbol AND b.date >= st.filed_date""", "mkt")
def fund_asof_daily(spark: SparkSession, sf: str) -> DataFrame:
    f = filings(spark, sf)
    m = bars.market_bars(spark, sf).select("date", "close").crossJoin(f.select("symbol").distinct())
    state = U.pivot_state(f, list(METRICS.values())).withColumnRenamed("filed_date", "date")
    out = asof_join(m.select("symbol", "date", "close"), state, on="date", by=["symbol"])
    return out.withColumn("close", F.round("close", 6))


#: A balance sheet derived from each bar, in words that both engines read alike.
SHEET = {
    "fund_revenue": "CAST(volume AS DOUBLE) * 100", "fund_net_income": "CAST(volume % 29 AS DOUBLE) * 60 - 300", "fund_total_assets": "CAST(volume % 31 AS DOUBLE) * 400", "fund_total_debt": "CAST(volume % 17 AS DOUBLE) * 90",
    "fund_total_equity": "CAST(volume % 19 AS DOUBLE) * 120", "fund_operating_cf_ttm": "CASE WHEN volume % 9 > 0 THEN CAST(volume % 23 AS DOUBLE) * 80 - 400 END", "fund_net_income_ttm": "CAST(volume % 27 AS DOUBLE) * 150 - 700",
    "fund_current_assets": "CAST(volume % 13 AS DOUBLE) * 70", "fund_current_liabilities": "CAST(volume % 11 AS DOUBLE) * 60", "fund_shares_outstanding": "CAST(volume % 37 AS DOUBLE) * 10", "fund_gross_profit": "CAST(volume AS DOUBLE) * 35",
    "fund_retained_earnings": "CAST(volume % 21 AS DOUBLE) * 50 - 200", "fund_operating_income": "CAST(volume % 25 AS DOUBLE) * 65 - 250", "fund_total_liabilities": "CAST(volume % 15 AS DOUBLE) * 300", "fund_revenue_ttm": "CAST(volume AS DOUBLE) * 400",
    "fund_free_cash_flow_ttm": "CAST(volume % 33 AS DOUBLE) * 45 - 500", "fund_stock_repurchased_ttm": "CASE WHEN volume % 4 > 0 THEN CAST(volume % 41 AS DOUBLE) * 12 END", "fund_dividends_paid_ttm": "CAST(volume % 35 AS DOUBLE) * 9",
    "fund_stock_comp_ttm": "CAST(volume % 39 AS DOUBLE) * 3", "fund_dividends_per_share": "CAST(volume % 6 AS DOUBLE) / 4",
}
_SHEET = "sh AS (SELECT *, " + ", ".join(f"{sql} AS {c}" for c, sql in SHEET.items()) + " FROM brand)"
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    return bars.brand_bars(spark, sf).selectExpr("*", *[f"{sql} AS {c}" for c, sql in SHEET.items()])


def _yoy(c: str) -> str:
    return f"({c} - lag({c}, 252) OVER w) / nullif(abs(lag({c}, 252) OVER w), 0)"


@query(f"""WITH {_SHEET} SELECT symbol, date, close / nullif(fund_net_income_ttm / nullif(fund_shares_outstanding, 0), 0) AS fund_pe_ratio, close * fund_shares_outstanding / nullif(fund_total_equity, 0) AS fund_pb_ratio,
close * fund_shares_outstanding / nullif(fund_revenue_ttm, 0) AS fund_ps_ratio, fund_free_cash_flow_ttm / nullif(close * fund_shares_outstanding, 0) AS fund_fcf_yield, fund_current_assets / nullif(fund_current_liabilities, 0) AS fund_current_ratio,
{_yoy('fund_revenue')} AS fund_revenue_growth_yoy, {_yoy('fund_net_income')} AS fund_earnings_growth_yoy, fund_net_income / nullif(fund_total_assets, 0) AS fund_roa FROM sh {_W}""", "brand")
def fund_ratios(spark: SparkSession, sf: str) -> DataFrame:
    out = U.statement_ratios(U.price_ratios(sheet(spark, sf)))
    return out.select("symbol", "date", "fund_pe_ratio", "fund_pb_ratio", "fund_ps_ratio", "fund_fcf_yield", "fund_current_ratio", "fund_revenue_growth_yoy", "fund_earnings_growth_yoy", "fund_roa")


_F = """x AS (SELECT *, fund_net_income_ttm / nullif(fund_total_assets, 0) AS roa, fund_operating_cf_ttm / nullif(fund_total_assets, 0) AS cfo, fund_total_debt / nullif(fund_total_assets, 0) AS lev, fund_current_assets / nullif(fund_current_liabilities, 0) AS cur,
fund_gross_profit / nullif(fund_revenue, 0) AS gm, fund_revenue / nullif(fund_total_assets, 0) AS turn FROM sh)"""
_TESTS = ["roa > 0", "fund_operating_cf_ttm > 0", "roa > lag(roa, 252) OVER w", "cfo > roa", "lev < lag(lev, 252) OVER w", "cur > lag(cur, 252) OVER w", "fund_shares_outstanding <= lag(fund_shares_outstanding, 252) OVER w", "gm > lag(gm, 252) OVER w", "turn > lag(turn, 252) OVER w"]


@query(f"WITH {_SHEET}, {_F} SELECT symbol, date, CASE WHEN coalesce({', '.join(_TESTS)}) IS NOT NULL THEN ({' + '.join(f'coalesce(({t})::INT, 0)' for t in _TESTS)})::DOUBLE END AS fund_piotroski_f FROM x {_W}", "brand")
def fund_piotroski(spark: SparkSession, sf: str) -> DataFrame:
    return U.piotroski(sheet(spark, sf)).select("symbol", "date", "fund_piotroski_f")


_Z = "coalesce(1.2::DOUBLE * ((fund_current_assets - fund_current_liabilities) / nullif(fund_total_assets, 0)), 0) + coalesce(1.4::DOUBLE * (fund_retained_earnings / nullif(fund_total_assets, 0)), 0) + coalesce(3.3::DOUBLE * (fund_operating_income / nullif(fund_total_assets, 0)), 0) + coalesce(0.6::DOUBLE * (close * fund_shares_outstanding / nullif(fund_total_liabilities, 0)), 0) + coalesce(fund_revenue / nullif(fund_total_assets, 0), 0)"


@query(f"WITH {_SHEET}, z AS (SELECT symbol, date, CASE WHEN nullif(fund_total_assets, 0) IS NOT NULL OR nullif(fund_total_liabilities, 0) IS NOT NULL THEN {_Z} END AS z FROM sh) SELECT symbol, date, z AS fund_altman_z, CASE WHEN z > 2.99 THEN 'safe' WHEN z >= 1.8 THEN 'grey' WHEN z < 1.8 THEN 'distress' END AS fund_altman_zone FROM z", "brand")
def fund_altman(spark: SparkSession, sf: str) -> DataFrame:
    return U.altman(sheet(spark, sf)).select("symbol", "date", "fund_altman_z", "fund_altman_zone")


@query(f"WITH {_SHEET} SELECT symbol, date, round(coalesce(fund_stock_repurchased_ttm, 0) / nullif(close * fund_shares_outstanding, 0), 6) AS fund_buyback_yield, round((coalesce(fund_stock_repurchased_ttm, 0) + fund_dividends_paid_ttm - fund_stock_comp_ttm) / nullif(close * fund_shares_outstanding, 0), 6) AS fund_shareholder_yield FROM sh", "brand")
def fund_yield(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.payouts(sheet(spark, sf)).select("symbol", "date", "fund_buyback_yield", "fund_shareholder_yield"))


@query(f"WITH {_SHEET} SELECT symbol, date, round({_yoy('fund_dividends_per_share')}, 6) AS fund_div_growth_yoy, round(fund_dividends_paid_ttm / nullif(fund_net_income_ttm, 0), 6) AS fund_payout_ratio FROM sh {_W}", "brand")
def fund_dividend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.payouts(sheet(spark, sf)).select("symbol", "date", "fund_div_growth_yoy", "fund_payout_ratio"))


@query("""WITH h AS (SELECT c_mktsegment AS symbol, date_trunc('quarter', o_orderdate)::DATE AS filed_date, count(DISTINCT o_custkey) AS total_holders, round(sum(o_totalprice), 2) AS total_shares FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT symbol, filed_date, total_holders, total_holders - lag(total_holders) OVER w AS inst_holders_change_qoq, round((total_shares - lag(total_shares) OVER w) / nullif(lag(total_shares) OVER w, 0), 6) AS inst_shares_change_pct FROM h WINDOW w AS (PARTITION BY symbol ORDER BY filed_date)""")
def inst_qoq(spark: SparkSession, sf: str) -> DataFrame:
    orders = bars.read_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = bars.read_table(spark, sf, "customer").select(C("c_custkey").alias("o_custkey"), C("c_mktsegment").alias("symbol"))
    h = orders.join(customers, "o_custkey").groupBy("symbol", F.trunc("o_orderdate", "quarter").alias("filed_date")).agg(F.countDistinct("o_custkey").alias("total_holders"), F.round(F.sum("o_totalprice"), 2).alias("total_shares"))
    return rounded(U.holdings_changes(h).select("symbol", "filed_date", "total_holders", "inst_holders_change_qoq", "inst_shares_change_pct"))


_INS = "t AS (SELECT ts::DATE AS filed, CASE WHEN event_type = 'purchase' THEN value ELSE -value END AS shares, 2.5::DOUBLE AS price, CASE WHEN user_id % 3 = 0 THEN 'Chief Executive Officer' WHEN user_id % 3 = 1 THEN 'Director' END AS title FROM events WHERE event_type IN ('purchase', 'error'))"


@query(f"""WITH {_INS}, d AS (SELECT DISTINCT date FROM mkt), e AS (SELECT date + 9496 AS day, date FROM d),
g AS (SELECT date, round(coalesce(sum(shares) FILTER (filed >= day - 30), 0), 6) AS insider_net_shares_30d, count(*) FILTER (shares > 0)::DOUBLE AS b, count(*) FILTER (shares < 0)::DOUBLE AS s,
round(coalesce(sum(shares * price) FILTER (filed >= day - 30), 0), 6) AS insider_net_value_30d, count(*) FILTER (shares > 0 AND lower(title) LIKE '%chief executive%')::DOUBLE AS insider_officer_buys_90d FROM e LEFT JOIN t ON filed BETWEEN day - 90 AND day GROUP BY date)
SELECT date, insider_net_shares_30d, b AS insider_buy_count_90d, s AS insider_sell_count_90d, insider_net_value_30d, insider_officer_buys_90d, round(b / nullif(b + s, 0), 6) AS insider_buy_ratio_90d FROM g""", "mkt")
def insider_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every market day, the trades moved back to their years."""
    e = bars.read_table(spark, sf, "events").where("event_type in ('purchase', 'error')")
    title = F.when(C("user_id") % 3 == 0, "Chief Executive Officer").when(C("user_id") % 3 == 1, "Director")
    trades = e.select(C("ts").cast("date").alias("filed_date"), F.when(C("event_type") == "purchase", C("value")).otherwise(-C("value")).alias("shares"), F.lit(2.5).alias("price"), title.alias("insider_title"))
    days = bars.market_bars(spark, sf).select(F.date_add("date", 9496).alias("date")).distinct()
    return rounded(U.insider_windows(days, trades).withColumn("date", F.date_sub("date", 9496)))


@query("""WITH f AS (SELECT ts::DATE AS filed, event_type FROM events), d AS (SELECT unnest(generate_series(min(filed), max(filed) + 425, INTERVAL 1 DAY))::DATE AS date FROM f)
SELECT date, (count(*) FILTER (event_type = 'signup' AND filed >= date - 7) > 0)::INT::DOUBLE AS event_earnings_recent, (count(*) FILTER (event_type = 'purchase' AND filed >= date - 14) > 0)::INT::DOUBLE AS event_acquisition_recent,
(count(*) FILTER (event_type = 'click' AND filed >= date - 28) > 0)::INT::DOUBLE AS event_officer_change_recent, (count(*) FILTER (event_type = 'error') > 0)::INT::DOUBLE AS event_restatement_ever, count(*) FILTER (filed >= date - 90)::DOUBLE AS event_count_90d
FROM d LEFT JOIN f ON filed BETWEEN date - 365 AND date GROUP BY date""")
def event_flags(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"has_earnings": "signup", "has_acquisition": "purchase", "has_officer_change": "click", "has_restatement": "error"}
    e = bars.read_table(spark, sf, "events").select(C("ts").cast("date").alias("filed_date"), *[(C("event_type") == v).alias(k) for k, v in kinds.items()])
    days = e.agg(F.min("filed_date").alias("a"), F.max("filed_date").alias("b")).select(F.explode(F.sequence("a", F.date_add("b", 425))).alias("date"))
    return U.event_windows(days, e)


@query("""WITH m AS (SELECT date, close - 1500 AS ys, CASE WHEN volume % 5 > 0 THEN close / 100 END AS hy, open AS lei, high AS cl FROM mkt)
SELECT date, ((coalesce((ys > 0)::INT, 0) + coalesce((hy < CASE WHEN count(hy) OVER w >= 21 THEN quantile_cont(hy, 0.5) OVER w END)::INT, 0) + coalesce((lei > lag(lei, 21) OVER (ORDER BY date))::INT, 0) + coalesce((cl < lag(cl, 21) OVER (ORDER BY date))::INT, 0)) / 4)::DOUBLE AS fred_macro_regime
FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""", "mkt")
def macro_regime(spark: SparkSession, sf: str) -> DataFrame:
    m = bars.market_bars(spark, sf)
    macro = m.select("date", (C("close") - 1500).alias("fred_yield_spread_10y2y"), F.when(C("volume") % 5 > 0, C("close") / 100).alias("fred_credit_spread_hy"), C("open").alias("fred_lei"), C("high").alias("fred_claims"))
    return U.macro_regime(macro).select("date", "fred_macro_regime")


@query("""WITH m AS (SELECT date, low / nullif(high, 0) AS p FROM mkt) SELECT date, round(p, 6) AS sentiment_pcr, round(CASE WHEN count(p) OVER w >= 10 THEN avg(p) OVER w END, 6) AS sentiment_pcr_ma10 FROM m WINDOW w AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "mkt")
def pcr_ma(spark: SparkSession, sf: str) -> DataFrame:
    m = bars.market_bars(spark, sf).select("date", C("low").alias("puts"), C("high").alias("calls"))
    return rounded(U.put_call(m).select("date", "sentiment_pcr", "sentiment_pcr_ma10"))


@query("""WITH m AS (SELECT date, close / nullif(open, 0) AS r FROM mkt) SELECT date, round(r, 6) AS intermarket_cu_au_ratio, round(r / nullif(lag(r, 63) OVER (ORDER BY date), 0) - 1, 6) AS intermarket_cu_au_momentum FROM m""", "mkt")
def intermarket(spark: SparkSession, sf: str) -> DataFrame:
    m = bars.market_bars(spark, sf).select("date", C("close").alias("copper"), C("open").alias("gold"))
    return rounded(U.intermarket(m).select("date", "intermarket_cu_au_ratio", "intermarket_cu_au_momentum"))


@query("SELECT date, round(high - low, 6) AS yield_spread_10y2y, round(high - open, 6) AS yield_real_10y FROM mkt", "mkt")
def yield_curve(spark: SparkSession, sf: str) -> DataFrame:
    m = bars.market_bars(spark, sf).select("date", C("high").alias("yield_10y"), C("low").alias("yield_2y"), C("open").alias("yield_breakeven_10y"))
    return rounded(U.yield_curve(m).select("date", "yield_spread_10y2y", "yield_real_10y"))


@query("""WITH s AS (SELECT p_brand AS symbol, count(*) FILTER (p_size > 25) AS up, count(*) FILTER (p_size <= 25) AS down FROM part GROUP BY p_brand), b AS (SELECT symbol, date, date = max(date) OVER (PARTITION BY symbol) AS l FROM brand)
SELECT symbol, date, CASE WHEN l THEN up END AS analyst_rev_up_7d, CASE WHEN l THEN down END AS analyst_rev_down_7d, CASE WHEN l THEN round((up - down)::DOUBLE / nullif(up + down, 0), 6) END AS analyst_rev_breadth FROM b LEFT JOIN s USING (symbol)""", "brand")
def analyst_revisions(spark: SparkSession, sf: str) -> DataFrame:
    s = bars.read_table(spark, sf, "part").groupBy(C("p_brand").alias("symbol")).agg(F.count(F.when(C("p_size") > 25, 1)).alias("up"), F.count(F.when(C("p_size") <= 25, 1)).alias("down"))
    return rounded(U.analyst_revisions(bars.brand_bars(spark, sf).select("symbol", "date"), s))


_TTM = "ro AS (SELECT symbol, period_end, sum(value) OVER (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ttm FROM fil WHERE metric = 'net_income'), dt AS (SELECT DISTINCT symbol, filed_date FROM fil), tt AS (SELECT dt.symbol, dt.filed_date, ttm FROM dt ASOF LEFT JOIN ro ON dt.symbol = ro.symbol AND dt.filed_date >= ro.period_end)"


@query(f"""WITH {_STATE}, {_TTM}, b AS (SELECT s.symbol, m.date, m.close FROM mkt m, (SELECT DISTINCT symbol FROM fil) s),
x AS (SELECT b.*, fund_revenue, fund_net_income, close / nullif(ttm / nullif(fund_total_assets / 100, 0), 0) AS pe FROM b ASOF LEFT JOIN st ON b.symbol = st.symbol AND b.date >= st.filed_date ASOF LEFT JOIN tt ON b.symbol = tt.symbol AND b.date >= tt.filed_date),
y AS (SELECT symbol, date, pe, {_yoy('fund_revenue')} AS rg, {_yoy('fund_net_income')} AS eg, close > {_roll('avg', 'close', 50)} AS up FROM x {_W})
SELECT symbol, date, round(pe, 6) AS fund_pe_ratio, round(rg, 6) AS fund_revenue_growth_yoy, round(eg, 6) AS fund_earnings_growth_yoy, coalesce(eg >= 0.1 AND rg >= 0.05 AND up AND pe < 40, false) AS buy,
coalesce(eg IS NOT NULL AND rg IS NOT NULL AND up IS NOT NULL AND pe IS NOT NULL AND (eg < 0 OR NOT up), false) AS sell FROM y""", "mkt")
def sig_enriched_earnings(spark: SparkSession, sf: str) -> DataFrame:
    """From filings to signals: state and trailing sums as filed, joined as of each day, ratios and growth, the
    earnings_growth strategy. A share stands for 100 of total assets."""
    f = filings(spark, sf)
    ttm = U.trailing_sums(f).where("metric = 'net_income'").select("symbol", "filed_date", C("ttm").alias("fund_net_income_ttm"))
    state = U.pivot_state(f, list(METRICS.values())).join(ttm, ["symbol", "filed_date"]).withColumn("fund_shares_outstanding", C("fund_total_assets") / 100)
    b = bars.market_bars(spark, sf).select("date", "close").crossJoin(f.select("symbol").distinct())
    out = strategies.get_strategy("earnings_growth").signals(U.enrich(b, state))
    return rounded(out.select("symbol", "date", "fund_pe_ratio", "fund_revenue_growth_yoy", "fund_earnings_growth_yoy", "buy", "sell"))


@query(f"""WITH {_FIL}, n AS (SELECT symbol, metric, period_end, filed_date + 10 AS filed_date, round(value + 1, 2) AS value FROM fil WHERE metric = 'revenue')
SELECT symbol, metric, period_end, filed_date, value FROM n UNION ALL SELECT symbol, metric, period_end, filed_date, value FROM fil WHERE metric <> 'revenue'""")
def filings_cache(spark: SparkSession, sf: str) -> DataFrame:
    """All filings, then restated revenues, merged into a cache and read back."""
    path, f = shared_dir(spark, "filings-cache"), filings(spark, sf)
    restated = f.where("metric = 'revenue'").withColumns({"filed_date": F.date_add("filed_date", 10), "value": F.round(C("value") + 1, 2)})
    for part in (f, restated):
        files.merge_into_cache(spark, path, "financials", part)
    symbols = f.select("symbol").distinct().withColumn("_key", F.upper("symbol"))
    kept = files.read_cache(spark, path, "financials").withColumnRenamed("symbol", "_key")
    return kept.join(symbols, "_key").select("symbol", "metric", "period_end", "filed_date", "value")
