"""Summaries of runs, paths and regimes, and filings resolved and aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import fundamentals as U
from ..operators import metrics as M
from ..operators import research
from ..sources import bars
from . import signals
from .analytics import _E, _GROWTH, _LCG, _MR, _R, _SERIES, _VOL, BY, _equity, _market, _returns, _series
from .base import query, rounded
from .indicators import _roll
from .signals import _TRADES, crossover_trades

C = F.col


@query(f"""WITH {_R}, x AS (SELECT symbol, date, count(*) OVER w AS n, exp(sum(ln(1 + r)) OVER w) - 1 AS g, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT symbol, date, round(g, 6) AS rolling_return, round(m / nullif(s, 0) * sqrt(252), 6) AS rolling_sharpe FROM x WHERE n >= 252""", "brand")
def met_rolling_252(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.rolling_year(_returns(spark, sf), BY))


@query(f"""WITH {_VOL}, ml AS (SELECT date, close / nullif({_roll("avg", "close", 200)}, 0) AS x FROM mkt), la AS (SELECT symbol, date, r, regime, 'volatility' AS kind FROM lab UNION ALL
SELECT r.symbol, date, r.r, CASE WHEN x > 1.02 THEN 'bull' WHEN x < 0.98 THEN 'bear' WHEN x IS NOT NULL THEN 'sideways' ELSE 'unknown' END, 'market' FROM r JOIN ml USING (date)),
l AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, kind, regime ORDER BY date)) AS lv FROM la), d AS (SELECT *, lv / max(lv) OVER (PARTITION BY symbol, kind, regime ORDER BY date) - 1 AS dd FROM l),
g AS (SELECT symbol, kind, regime, exp(sum(ln(1 + r))) - 1 AS t, stddev_samp(r) * sqrt(252) AS v, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS s, min(dd) AS m, count(*) AS days FROM d GROUP BY symbol, kind, regime)
SELECT symbol, kind, regime, round(t, 6) AS total_return, round(v, 6) AS volatility, round(s, 6) AS sharpe, round(m, 6) AS max_drawdown, days, round(days / sum(days) OVER (PARTITION BY symbol, kind), 6) AS pct_of_time FROM g""", "brand", "mkt")
def regime_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.regime_summary(_returns(spark, sf), M.market_regime(bars.market_bars(spark, sf)), BY))


@query(f"""WITH {_MR}, {_SERIES}, g AS (SELECT s AS sim, t AS step, {_LCG.format(x="s * 1000003 + t * 7919 + 42")} % n AS i FROM n, (SELECT unnest(generate_series(0, 39)) AS s), (SELECT unnest(generate_series(0, n - 1)) AS t FROM n)),
p AS (SELECT sim, step, r, exp(sum(ln(1 + r)) OVER (PARTITION BY sim ORDER BY step)) AS growth FROM g JOIN ser USING (i)), d AS (SELECT *, growth / max(growth) OVER (PARTITION BY sim ORDER BY step) - 1 AS dd FROM p),
o AS (SELECT sim, arg_max(growth, step) AS final, coalesce(avg(r) FILTER (step > 0) / nullif(stddev_pop(r) FILTER (step > 0), 0) * sqrt(252), 0) AS sharpe, min(dd) AS max_dd FROM d GROUP BY sim), q AS (SELECT *, pow(final, 252.0::DOUBLE / n) - 1 AS cagr FROM o, n)
SELECT count(*) AS n_simulations, {", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS {'median' if p == 50 else f'p{p}'}_{c}" for c, ps in {"cagr": (5, 25, 50, 75, 95), "sharpe": (25, 50, 75), "max_dd": (25, 50, 75), "final": (5, 50, 95)}.items() for p in ps)} FROM q""", "mkt")
def monte_carlo_summary(spark: SparkSession, sf: str) -> DataFrame:
    series = _series(spark, sf)
    return rounded(research.path_summary(research.bootstrap_paths(series, 40), series.count()))


@query(f"""WITH {_E}, {_R}, {_GROWTH}, p AS (SELECT symbol, arg_max(equity, date) - arg_min(equity, date) AS pnl FROM eq GROUP BY symbol), s AS (SELECT symbol, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe FROM r GROUP BY symbol),
w AS (SELECT symbol, count(*) / sum(count(*)) OVER () AS weight FROM brand GROUP BY symbol)
SELECT symbol, round(weight, 6) AS weight, round(cagr, 6) AS cagr, round(coalesce(sharpe, 0), 6) AS sharpe, round(pnl, 6) AS pnl, round(CASE WHEN sum(pnl) OVER () <> 0 THEN pnl / sum(pnl) OVER () ELSE 1 / count(*) OVER () END * 100, 4) AS contribution_pct FROM p JOIN g USING (symbol) LEFT JOIN s USING (symbol) JOIN w USING (symbol)""", "brand")
def strategy_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand as a strategy, weighted by its trading days."""
    equity = _equity(spark, sf)
    n = equity.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    weights = n.crossJoin(n.agg(F.sum("n").alias("all"))).select("symbol", (C("n") / C("all")).alias("weight"))
    out = M.attribution(equity, weights, "symbol").withColumn("contribution_pct", F.round("contribution_pct", 4))
    return rounded(out, "contribution_pct")


@query(f"""WITH {_TRADES}, l AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM mkt),
d AS (SELECT h::INTEGER AS horizon, (b.close - a.close) / a.close AS x FROM trades t JOIN l a ON a.symbol = t.symbol AND a.date = t.entry_date JOIN (SELECT unnest(generate_series(1, 20)) AS h) ON true JOIN l b ON b.symbol = a.symbol AND b.i = a.i + h AND b.date <= t.exit_date),
means AS (SELECT horizon, avg(x) AS mean FROM d GROUP BY horizon), steps AS (SELECT *, mean - lag(mean) OVER (ORDER BY horizon) AS step FROM means),
ends AS (SELECT coalesce(min(step) >= 0, false) AS up, coalesce(max(step) <= 0, false) AS down, max(horizon) AS hi, arg_max(horizon, (mean, -horizon)) AS best, max(mean) AS peak, arg_max(mean, horizon) AS last, arg_min(mean, horizon) AS first FROM steps)
SELECT coalesce(CASE WHEN up THEN hi WHEN down THEN 1 ELSE best END, 0)::INTEGER AS optimal_days, round(coalesce(CASE WHEN up THEN last WHEN down THEN first ELSE peak END, 0), 6) AS peak_return, round(coalesce(last, 0), 6) AS return_at_max_horizon FROM ends""", "mkt")
def decay_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.decay_summary(M.signal_decay(crossover_trades(spark, sf), bars.market_bars(spark, sf), 20)))


_TAGS = ["3-MEDIUM", "1-URGENT", "5-LOW"]


@query(f"""WITH f AS (SELECT o_custkey AS entity, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'us-gaap:' || o_orderpriority END AS concept, o_orderdate::DATE AS period_end, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS value FROM orders),
k AS (SELECT *, list_position({_TAGS}, replace(concept, 'us-gaap:', '')) AS k FROM f WHERE value IS NOT NULL)
SELECT entity, o_orderkey, concept, period_end, round(value, 6) AS value FROM (SELECT *, min(k) OVER (PARTITION BY entity) AS first FROM k WHERE k > 0) WHERE k = first""")
def tag_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as filers, priorities as tags: some facts have no value."""
    o = bars.read_table(spark, sf, "orders")
    concept = F.when(C("o_orderkey") % 2 == 0, C("o_orderpriority")).otherwise(F.concat(F.lit("us-gaap:"), C("o_orderpriority")))
    facts = o.select(C("o_custkey").alias("entity"), "o_orderkey", concept.alias("concept"), C("o_orderdate").cast("date").alias("period_end"), F.when(C("o_orderkey") % 7 > 0, C("o_totalprice")).alias("value"))
    return rounded(U.resolve_tags(facts, _TAGS, ["entity"]))


@query("""SELECT c_mktsegment AS symbol, date_trunc('quarter', o_orderdate)::DATE AS report_date, max(o_orderdate)::DATE AS filed_date, count(DISTINCT o_custkey) AS total_holders, round(sum(o_totalprice / 37), 2) AS total_shares, round(sum(o_totalprice), 2) AS total_value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def inst_by_period(spark: SparkSession, sf: str) -> DataFrame:
    orders = bars.read_table(spark, sf, "orders").select(C("o_custkey").alias("manager_cik"), C("o_orderdate").cast("date").alias("filed_date"), C("o_totalprice").alias("value_held"), (C("o_totalprice") / 37).alias("shares_held"))
    customers = bars.read_table(spark, sf, "customer").select(C("c_custkey").alias("manager_cik"), C("c_mktsegment").alias("symbol"))
    rows = orders.join(customers, "manager_cik").withColumn("report_date", F.trunc("filed_date", "quarter"))
    out = U.holdings_by_period(rows, ["symbol"])
    return out.withColumns({c: F.round(c, 2) for c in ("total_shares", "total_value")})


signals._formula(
    "size_volatility_parity", lambda: costs.volatility_parity(signals._eq(), signals._cash(), C("px"), signals._atr(), 0.1, 0.15),
    f"CASE WHEN {signals._ATR} > 0 THEN floor(least({signals._EQ} * (0.15::DOUBLE / ({signals._ATR} / px * sqrt(252))), {signals._EQ} * 0.1::DOUBLE, {signals._CASH}) / px) ELSE {signals._FIXED} END", whole=True,
)
