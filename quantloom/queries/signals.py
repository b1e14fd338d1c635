"""Strategies' signals, the rule language, and the formulas of execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import execution
from ..plans import rules, strategies
from ..sources import bars
from .base import ORACLE_SQL, QUERIES, CTE, query, r6, rounded
from .indicators import _RSI, _TR, _roll

C = F.col

#: Enrichment columns derived from the bar, in words that both engines read alike.
ENRICHED = {
    "fund_net_income": "CAST(volume % 11 AS DOUBLE) - 2", "fund_pe_ratio": "CAST(volume % 37 AS DOUBLE)", "fund_revenue_growth_yoy": "CAST(volume % 13 AS DOUBLE) / 50 - 0.05",
    "fund_earnings_growth_yoy": "CAST(volume % 17 AS DOUBLE) / 40 - 0.1", "fund_debt_to_equity": "CAST(volume % 7 AS DOUBLE) / 3", "fund_net_margin": "CAST(volume % 9 AS DOUBLE) / 40",
    "fund_piotroski_f": "CASE WHEN volume % 5 > 0 THEN CAST(volume % 10 AS DOUBLE) END", "fund_altman_z": "CAST(volume % 8 AS DOUBLE) / 2", "insider_buy_ratio_90d": "CASE WHEN volume % 3 > 0 THEN CAST(volume % 21 AS DOUBLE) / 20 END",
    "insider_officer_buys_90d": "CAST(volume % 4 AS DOUBLE)", "insider_net_shares_30d": "(CAST(volume % 23 AS DOUBLE) - 18) * 5000", "inst_shares_change_pct": "CAST(volume % 19 AS DOUBLE) / 100 - 0.08",
    "fred_yield_spread_10y2y": "CASE WHEN volume % 6 > 0 THEN CAST(volume % 15 AS DOUBLE) / 10 - 0.4 END", "fred_credit_spread_hy": "CAST(volume % 14 AS DOUBLE) / 2", "vix_ratio": "CAST(volume % 12 AS DOUBLE) / 10 + 0.5",
    "analyst_rev_breadth": "CAST(volume % 25 AS DOUBLE) / 12 - 1",
}


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return bars.brand_bars(spark, sf).selectExpr("*", *[f"{sql} AS {c}" for c, sql in ENRICHED.items()])


_E = f"e AS (SELECT *, close > sma AS up FROM (SELECT *, {_roll('avg', 'close', 50)} AS sma, {', '.join(f'{sql} AS {c}' for c, sql in ENRICHED.items())} FROM brand))"
_CONDITIONS = {
    "value_quality": (
        {"sma_period": 50, "max_pe": 30.0},
        "fund_net_income > 0 AND fund_pe_ratio > 0 AND fund_pe_ratio < 30 AND fund_revenue_growth_yoy >= 0 AND fund_debt_to_equity <= 1.5 AND fund_net_margin >= 0.05 AND up",
        "fund_net_income <= 0 OR fund_pe_ratio > 45 OR NOT up", "sma IS NOT NULL",
    ),
    "earnings_growth": ({}, "fund_earnings_growth_yoy >= 0.1 AND fund_revenue_growth_yoy >= 0.05 AND up AND fund_pe_ratio < 40", "fund_earnings_growth_yoy < 0 OR NOT up", "sma IS NOT NULL"),
    "insider_following": (
        {}, "(coalesce(insider_officer_buys_90d >= 2, false) OR coalesce(insider_buy_ratio_90d >= 0.7, false)) AND up", "coalesce(insider_net_shares_30d < -50000, false) OR NOT up", "sma IS NOT NULL"
    ),
    "smart_money": (
        {}, "inst_shares_change_pct >= 0.02 AND coalesce(insider_buy_ratio_90d > 0.5, false) AND fund_net_income > 0 AND fund_revenue_growth_yoy >= 0 AND up",
        "(inst_shares_change_pct < -0.02 AND insider_net_shares_30d < 0) OR fund_net_income <= 0 OR NOT up", "sma IS NOT NULL",
    ),
    "macro_aware_value": (
        {"sma_period": 50},
        "fund_piotroski_f >= CASE WHEN g THEN 5 ELSE 7 END AND fund_pe_ratio < CASE WHEN g THEN 25 ELSE 15 END AND fund_altman_z >= 1.8 AND up", "fund_piotroski_f < 3 OR fund_altman_z < 1.8 OR NOT up",
        "sma IS NOT NULL AND fund_piotroski_f IS NOT NULL",
    ),
    "sentiment_momentum": (
        {}, "(analyst_rev_breadth > 0)::INT + coalesce(insider_buy_ratio_90d > 0.6, false)::INT + up::INT >= 2",
        "(analyst_rev_breadth < 0)::INT + coalesce(insider_buy_ratio_90d < 0.3, false)::INT + (close < sma)::INT >= 2", "sma IS NOT NULL",
    ),
    "risk_regime": (
        {"sma_period": 50, "use_trend": True}, "s = n AND n > 0 AND coalesce(fund_piotroski_f >= 5, true)", "s = 0 AND n > 0", "true",
    ),
}
_EXTRA = (
    "*, coalesce(fred_yield_spread_10y2y > 0 AND fred_credit_spread_hy < 5, false) AS g, "
    "(vix_ratio < 1)::INT + coalesce(fred_yield_spread_10y2y > 0, false)::INT + (fred_credit_spread_hy < 5)::INT + coalesce(up, false)::INT AS s, "
    "2 + (fred_yield_spread_10y2y IS NOT NULL)::INT + (sma IS NOT NULL)::INT AS n"
)


def _strategy(name: str, params: dict, buy: str, sell: str, given: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return strategies.get_strategy(name, params).signals(_enriched(spark, sf)).select("symbol", "date", "buy", "sell")

    QUERIES[f"sig_{name}"] = run
    ORACLE_SQL[f"sig_{name}"] = f"WITH {CTE['brand']}, {_E}, x AS (SELECT {_EXTRA} FROM e) SELECT symbol, date, coalesce({given} AND ({buy}), false) AS buy, coalesce({given} AND ({sell}), false) AS sell FROM x"


for _n, _c in _CONDITIONS.items():
    _strategy(_n, *_c)


@query(f"WITH s AS (SELECT symbol, date, {_roll('avg', 'close', 20)} AS f, {_roll('avg', 'close', 50)} AS s FROM brand) SELECT symbol, date, coalesce(f > s, false) AS buy, coalesce(f < s, false) AS sell FROM s", "brand")
def sig_sma_cross(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.get_strategy("sma_crossover").signals(bars.brand_bars(spark, sf)).select("symbol", "date", "buy", "sell")


@query(f"""WITH {_RSI}, x AS (SELECT symbol, date, CASE WHEN al = 0 AND ag > 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi FROM e),
s AS (SELECT symbol, date, close, {_roll('avg', 'close', 30)} AS trend FROM brand)
SELECT symbol, date, coalesce(rsi < 45 AND close > trend, false) AS buy, coalesce(rsi > 65, false) AS sell FROM x JOIN s USING (symbol, date)""", "brand")
def sig_rule_dsl(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"indicators": {"rsi": {"fn": "rsi", "period": 14}, "trend": {"fn": "sma", "period": 30}}, "buy_when": [["rsi", "<", 45], ["close", ">", "trend"]], "sell_when": [["rsi", ">", 65]]}
    return strategies.get_strategy("rule_based", spec).signals(bars.brand_bars(spark, sf)).select("symbol", "date", "buy", "sell")


@query(f"WITH {_E} SELECT symbol, date, coalesce(fund_pe_ratio < 20 AND fund_piotroski_f <> 3, false) AS buy, coalesce(close < sma, false) AS sell FROM e", "brand")
def sig_screener(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"rules": [["fund_pe_ratio", "<", 20], ["fund_piotroski_f", "!=", 3], ["broken"], ["close", "~", 1]], "sma_period": 50}
    return strategies.get_strategy("fundamental_screener", spec).signals(_enriched(spark, sf)).select("symbol", "date", "buy", "sell")


@query("""WITH m AS (SELECT date, avg(close) OVER (ORDER BY date) AS ref, close AS c FROM mkt)
SELECT symbol, b.date, coalesce(b.close > m.ref, false) AS above FROM brand b LEFT JOIN m ON b.date = m.date""", "brand", "mkt")
def sig_benchmark_context(spark: SparkSession, sf: str) -> DataFrame:
    """A rule that compares with a benchmark's column."""
    from pyspark.sql import Window

    m = bars.market_bars(spark, sf).withColumn("ref", F.avg("close").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).select("symbol", "date", "ref")
    both = rules.with_benchmark(bars.brand_bars(spark, sf), m)
    return both.select("symbol", "date", rules.compile_rules([["close", ">", "bm_ref"]], both.columns).alias("above"))


@query("""WITH r AS (SELECT symbol, date, (close - lag(close, 20) OVER w) / nullif(lag(close, 20) OVER w, 0) * 100 AS roc FROM brand WINDOW w AS (PARTITION BY symbol ORDER BY date)),
k AS (SELECT symbol, date, roc, row_number() OVER (PARTITION BY date ORDER BY roc DESC, symbol) AS rank FROM r WHERE roc > 0)
SELECT symbol, date, round(roc, 6) AS roc, rank::INTEGER AS rank FROM k WHERE rank <= 5""", "brand")
def sig_momentum_topn(spark: SparkSession, sf: str) -> DataFrame:
    out = strategies.get_strategy("momentum_rotation", {"roc_period": 20}).signals(bars.brand_bars(spark, sf))
    return out.where("buy").select("symbol", "date", r6("roc").alias("roc"), "rank")


@query(f"""WITH wk AS (SELECT symbol, max(date) AS date, arg_max(close, date) AS c FROM brand GROUP BY symbol, date_trunc('week', date)),
d AS (SELECT b.symbol, b.date, last_value(w.c IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date) AS wc FROM brand b LEFT JOIN wk w USING (symbol, date)),
m AS (SELECT symbol, date, {_roll('avg', 'wc', 10)} AS f, {_roll('avg', 'wc', 30)} AS s FROM d), {_RSI},
x AS (SELECT symbol, date, CASE WHEN al = 0 AND ag > 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END AS rsi FROM e)
SELECT symbol, date, coalesce(f > s AND rsi < 40, false) AS buy, coalesce(f IS NOT NULL AND s IS NOT NULL AND rsi > 70, false) AS sell FROM m JOIN x USING (symbol, date)""", "brand")
def sig_multi_tf(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.get_strategy("multi_tf_trend").signals(bars.brand_bars(spark, sf)).select("symbol", "date", "buy", "sell")


@query(f"WITH s AS (SELECT date, {_roll('avg', 'close', 50)} AS f, {_roll('avg', 'close', 200)} AS s FROM mkt) SELECT date, coalesce(f > s, true) AS regime_on FROM s", "mkt")
def regime_filter(spark: SparkSession, sf: str) -> DataFrame:
    return strategies.regime_filter(bars.market_bars(spark, sf))


# Execution formulas, on line items as orders.
_O = "o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice AS px0, l_extendedprice / l_quantity AS px, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_tax * 100000 AS v FROM lineitem)"
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey, px0"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    lines = bars.read_table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C("l_quantity").alias("q"), C("l_extendedprice").alias("px0"), (C("l_extendedprice") / C("l_quantity")).alias("px"),
        F.when(C("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), (C("l_tax") * 100000).alias("v"),
    )


def _formula(name: str, column, sql: str, whole: bool = False) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _orders(spark, sf).select(*_K.split(", "), (column().cast("long") if whole else column()).alias("x"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {_O} SELECT {_K}, {f'({sql})::BIGINT' if whole else sql} AS x FROM o"


_SIGN = "CASE WHEN side = 'BUY' THEN 1 ELSE -1 END"
_TIERS = [(0.0, 10.0), (10_000.0, 5.0), (50_000.0, 2.0)]
_formula("slip_fixed", lambda: costs.fixed_slippage(C("px"), C("side"), 10), f"px + {_SIGN} * px * 10 / 10000")
_formula("slip_volume", lambda: costs.volume_slippage(C("px"), C("side"), C("q"), C("v")), f"CASE WHEN v > 0 THEN px + {_SIGN} * px * 0.1::DOUBLE * q / v ELSE px END")
_formula("slip_sqrt", lambda: costs.sqrt_slippage(C("px"), C("side"), C("q"), C("v")), f"CASE WHEN v > 0 THEN px + {_SIGN} * 0.1::DOUBLE * 0.02::DOUBLE * sqrt(q / v) * px ELSE px END")
_formula("fee_percentage", lambda: costs.percentage_fee(C("px"), C("q")), "px * q * 5 / 10000")
_formula("fee_tiered", lambda: costs.tiered_fee(C("px"), C("q"), _TIERS), "greatest(0, least(px * q, 10000)) * 10 / 10000 + greatest(0, least(px * q, 50000) - 10000) * 5 / 10000 + greatest(0, px * q - 50000) * 2 / 10000")
_formula("fee_composite", lambda: costs.composite_fee(C("px"), C("q"), C("side")), "px * q * 5 / 10000 + CASE WHEN side = 'SELL' THEN px * q * 0.000008::DOUBLE + least(q * 0.000119::DOUBLE, 5.95) ELSE 0 END")
_EQ, _CASH = "(px0 * 7)", "(px0 * 1.5::DOUBLE)"
_eq, _cash, _atr = (lambda: C("px0") * 7), (lambda: C("px0") * 1.5), (lambda: F.when(C("q") > 5, C("px") * C("q") / 1000))
_FIXED = f"floor(least({_EQ} * 0.1::DOUBLE, {_CASH}) / px)"
_ATR = "(CASE WHEN q > 5 THEN px * q / 1000 END)"
_formula("size_fixed", lambda: costs.fixed_fractional(_eq(), _cash(), C("px"), 0.1), _FIXED, whole=True)
_formula("size_atr", lambda: costs.atr_size(_eq(), _cash(), C("px"), _atr(), 0.1), f"CASE WHEN {_ATR} > 0 THEN least(floor({_EQ} * 0.01::DOUBLE / ({_ATR} * 2)), {_FIXED}) ELSE {_FIXED} END", whole=True)
_formula(
    "size_kelly", lambda: costs.kelly_size(_eq(), _cash(), C("px"), C("q") / 60, C("q") / 20, 0.25),
    f"CASE WHEN (q / 60 * (q / 20) - (1 - q / 60)) / (q / 20) > 0 THEN floor(least({_EQ} * least((q / 60 * (q / 20) - (1 - q / 60)) / (q / 20) * 0.5::DOUBLE, 0.25), {_CASH}) / px) ELSE 0 END", whole=True,
)
_formula("size_risk_parity", lambda: costs.volatility_size(_eq(), _cash(), C("px"), _atr(), 0.1), f"CASE WHEN {_ATR} > 0 THEN floor(least({_EQ} * least(0.1::DOUBLE / ({_ATR} / px * sqrt(252)), 0.1::DOUBLE), {_CASH}) / px) ELSE {_FIXED} END", whole=True)


@query("""
WITH o AS (SELECT symbol, date, open, high, low, close, CASE volume % 4 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'STOP' ELSE 'STOP_LIMIT' END AS kind, CASE WHEN volume % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side,
  lag(close) OVER (PARTITION BY symbol ORDER BY date) AS l, lag(open) OVER (PARTITION BY symbol ORDER BY date) AS s FROM brand),
t AS (SELECT *, CASE WHEN side = 'BUY' THEN low <= l ELSE high >= l END AS reached, CASE WHEN side = 'BUY' THEN high >= s ELSE low <= s END AS hit FROM o)
SELECT symbol, date, kind, side, round(CASE WHEN kind = 'MARKET' THEN (high + low + close) / 3 WHEN kind = 'LIMIT' AND reached THEN l WHEN kind = 'STOP' AND hit THEN s WHEN kind = 'STOP_LIMIT' AND hit AND reached THEN l END, 6) AS price FROM t""", "brand")
def fill_price_models(spark: SparkSession, sf: str) -> DataFrame:
    before = lambda c: F.lag(c).over(bars.by_symbol())
    kind = F.element_at(F.array(*[F.lit(k) for k in ("MARKET", "LIMIT", "STOP", "STOP_LIMIT")]), (C("volume") % 4 + 1).cast("int"))
    o = bars.brand_bars(spark, sf).withColumns({"kind": kind, "side": F.when(C("volume") % 3 == 0, "SELL").otherwise("BUY"), "l": before("close"), "s": before("open")})
    return o.select("symbol", "date", "kind", "side", r6(costs.fill_price(C("kind"), C("side"), C("l"), C("s"), "vwap")).alias("price"))


@query(f"""WITH {_TR}, a AS (SELECT symbol, date, close, {_roll('avg', 'tr', 14)} AS atr FROM t)
SELECT symbol, date, round(CASE WHEN atr IS NULL THEN close * (1 - 0.0512877::DOUBLE) ELSE greatest(close * (1 - 0.0512877::DOUBLE), close - atr * 2) END, 6) AS stop, round(close * (1 + 0.1012877::DOUBLE), 6) AS target FROM a""", "brand")
def stop_levels(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.indicators import with_indicators

    out = with_indicators(bars.brand_bars(spark, sf), {"ATR": {"fn": "atr", "period": 14}})
    levels = costs.stop_levels(C("close"), C("ATR"), 0.0512877, 2.0, 0.1012877)
    return out.select("symbol", "date", *[r6(x).alias(n) for n, x in levels.items()])


_LOTS = "b AS (SELECT user_id, event_id AS seq, ceil(value)::BIGINT AS q, value AS price, event_type FROM events WHERE event_type IN ('purchase', 'error') AND value > 0), r AS (SELECT *, sum(q) OVER (PARTITION BY user_id, event_type ORDER BY seq) AS e FROM b)"


@query(f"""WITH {_LOTS} SELECT x.user_id, x.seq AS buy_seq, y.seq AS sell_seq, (least(x.e, y.e) - greatest(x.e - x.q, y.e - y.q))::BIGINT AS quantity, round((least(x.e, y.e) - greatest(x.e - x.q, y.e - y.q)) * (y.price - x.price), 6)::DOUBLE AS pnl
FROM r x JOIN r y ON x.user_id = y.user_id AND x.event_type = 'purchase' AND y.event_type = 'error' AND x.e - x.q < y.e AND y.e - y.q < x.e""")
def lots_fifo_match(spark: SparkSession, sf: str) -> DataFrame:
    e = bars.read_table(spark, sf, "events").where("value > 0")
    side = lambda t: e.where(C("event_type") == t).select("user_id", C("event_id").alias("seq"), F.ceil("value").alias("quantity"), C("value").alias("price"))
    return rounded(execution.match_lots(side("purchase"), side("error"), "user_id"))


@query("""
WITH p AS (SELECT symbol, max(close) AS price FROM brand GROUP BY symbol), h AS (SELECT p_brand AS symbol, (count(*) % 7 * 10)::BIGINT AS quantity FROM part WHERE p_size % 2 = 0 GROUP BY p_brand),
t AS (SELECT p_brand AS symbol, round(count(*) / 100.0::DOUBLE, 4) AS weight FROM part WHERE p_size < 5 GROUP BY p_brand),
x AS (SELECT symbol, coalesce(h.quantity, 0) AS q, coalesce(t.weight, 0) AS w, price, 1000000.0::DOUBLE AS e FROM h FULL JOIN t USING (symbol) JOIN p USING (symbol))
SELECT symbol, CASE WHEN w - q * price / e < 0 THEN 'SELL' ELSE 'BUY' END AS side, floor(abs(w - q * price / e) * e / price)::BIGINT AS quantity FROM x WHERE floor(abs(w - q * price / e) * e / price) > 0""", "brand")
def rebalance_orders(spark: SparkSession, sf: str) -> DataFrame:
    parts = bars.read_table(spark, sf, "part")
    run = F.lit(0).alias("run_id")
    held = parts.where("p_size % 2 = 0").groupBy(C("p_brand").alias("symbol")).agg((F.count(F.lit(1)) % 7 * 10).alias("quantity")).select(run, "symbol", "quantity", F.lit(1_000_000.0).alias("equity"))
    wanted = parts.where("p_size < 5").groupBy(C("p_brand").alias("symbol")).agg(F.round(F.count(F.lit(1)) / 100.0, 4).alias("weight")).select(run, "symbol", "weight")
    prices = bars.brand_bars(spark, sf).groupBy("symbol").agg(F.max("close").alias("price"))
    return execution.rebalance_orders(held, wanted, prices).drop("run_id")


_TRADES = f"""s AS (SELECT *, {_roll('avg', 'close', 20)} AS f, {_roll('avg', 'close', 50)} AS s FROM mkt),
w AS (SELECT *, coalesce(last_value(CASE WHEN f > s THEN 1 WHEN f < s THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), 0) AS want FROM s),
m AS (SELECT symbol, want, coalesce(lag(want) OVER o, 0) AS prior, lead(date) OVER o AS fd, lead(open) OVER o AS fp, max(date) OVER (PARTITION BY symbol) AS ed, last_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ec, date FROM w WINDOW o AS (PARTITION BY symbol ORDER BY date)),
fills AS (SELECT *, coalesce(lead(fd) OVER o, ed) AS xd, coalesce(lead(fp) OVER o, ec) AS xp FROM m WHERE want <> prior AND fd IS NOT NULL WINDOW o AS (PARTITION BY symbol ORDER BY date)),
trades AS (SELECT symbol, fd AS entry_date, xd AS exit_date, fp AS entry_price, xp AS exit_price, xp / fp - 1 AS pnl_pct, (xd - fd)::INTEGER AS holding_days FROM fills WHERE want = 1)"""


def crossover_trades(spark: SparkSession, sf: str) -> DataFrame:
    return execution.single_position_trades(strategies.get_strategy("sma_crossover").signals(bars.market_bars(spark, sf)))


@query(f"WITH {_TRADES} SELECT symbol, entry_date, exit_date, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(pnl_pct, 6) AS pnl_pct, holding_days FROM trades", "mkt")
def vec_backtest_sma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(crossover_trades(spark, sf))
