"""Performance metrics, calendars, regimes, correlation, decay, costs and research tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import research
from ..sources import bars
from .base import query, r6, rounded
from .indicators import _roll
from .signals import _TRADES, crossover_trades

C = F.col
BY = ["symbol"]
_R = "r AS (SELECT symbol, date, r FROM (SELECT symbol, date, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r FROM brand) WHERE r IS NOT NULL)"
_MR = "mr AS (SELECT date, r AS b FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM mkt) WHERE r IS NOT NULL)"
_E = "eq AS (SELECT symbol, date, close AS equity FROM brand)"
_DD = "dd AS (SELECT symbol, date, equity, peak, (equity - peak) / nullif(peak, 0) AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY date) AS peak FROM eq))"
_RUNS = f"""{_E}, {_DD}, n AS (SELECT *, equity < peak AS under, sum((equity >= peak)::INT) OVER w AS run, lead(date) OVER w AS after, max(date) OVER (PARTITION BY symbol) AS ed FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY date)),
runs AS (SELECT symbol, min(date) AS start, arg_min(date, (drawdown, date)) AS trough, arg_max(struct_pack(a := after), date).a AS recovery, min(drawdown) AS depth, (coalesce(arg_max(struct_pack(a := after), date).a, max(ed)) - min(date))::INTEGER AS days FROM n WHERE under GROUP BY symbol, run)"""


def _equity(spark: SparkSession, sf: str) -> DataFrame:
    return bars.brand_bars(spark, sf).select("symbol", "date", C("close").alias("equity"))


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return M.returns(_equity(spark, sf), BY)


def _market(spark: SparkSession, sf: str) -> DataFrame:
    m = bars.market_bars(spark, sf).select("symbol", "date", C("close").alias("equity"))
    return M.returns(m, BY).select("date", C("r").alias("b"))


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    return crossover_trades(spark, sf).withColumn("pnl", C("exit_price") - C("entry_price"))


@query(f"WITH {_R} SELECT symbol, date, round(r, 6) AS r FROM r", "brand")
def met_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_returns(spark, sf))


@query(f"""WITH {_E}, {_R}, g AS (SELECT symbol, arg_min(equity, date) AS a, arg_max(equity, date) AS b, max(date) - min(date) AS days FROM eq GROUP BY symbol),
s AS (SELECT symbol, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe, avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS sortino FROM r GROUP BY symbol)
SELECT symbol, round(b / a - 1, 6) AS total_return, round(pow(b / a, 365.25 / days) - 1, 6) AS cagr, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino FROM g JOIN s USING (symbol)""", "brand")
def met_cagr_sharpe_sortino(spark: SparkSession, sf: str) -> DataFrame:
    risk = _returns(spark, sf).groupBy("symbol").agg(M.sharpe(C("r")).alias("sharpe"), M.sortino(C("r")).alias("sortino"))
    return rounded(M.growth(_equity(spark, sf), BY).join(risk, "symbol"))


@query(f"WITH {_E}, {_DD} SELECT symbol, date, round(drawdown, 6) AS drawdown FROM dd", "brand")
def met_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.drawdowns(_equity(spark, sf), BY).select("symbol", "date", "drawdown"))


@query(f"WITH {_RUNS} SELECT symbol, max(days) AS days FROM runs GROUP BY symbol", "brand")
def met_dd_duration(spark: SparkSession, sf: str) -> DataFrame:
    return M.drawdown_periods(_equity(spark, sf), BY).groupBy("symbol").agg(F.max("days").alias("days"))


@query(f"WITH {_RUNS} SELECT symbol, start, trough, recovery, round(depth, 6) AS depth, days FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, start) AS k FROM runs) WHERE k <= 5", "brand")
def met_dd_periods(spark: SparkSession, sf: str) -> DataFrame:
    top = F.row_number().over(Window.partitionBy("symbol").orderBy("depth", "start"))
    return rounded(M.drawdown_periods(_equity(spark, sf), BY).withColumn("k", top).where("k <= 5").drop("k"))


_REL = f"WITH {_R}, {_MR}, j AS (SELECT symbol, r, b FROM r JOIN mr USING (date))"


@query(f"{_REL} SELECT symbol, round(covar_samp(r, b) / var_samp(b), 6) AS beta, round((avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252, 6) AS alpha, round(avg(r - b) / stddev_samp(r - b) * sqrt(252), 6) AS information_ratio, round(stddev_samp(r - b) * sqrt(252), 6) AS tracking_error FROM j GROUP BY symbol", "brand", "mkt")
def met_beta_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.relative(_returns(spark, sf), _market(spark, sf), BY).select("symbol", "beta", "alpha", "information_ratio", "tracking_error"))


_GROWTH = "g AS (SELECT symbol, b / a - 1 AS total_return, CASE WHEN a > 0 AND days > 0 THEN pow(b / a, 365.25 / days) - 1 ELSE 0 END AS cagr FROM (SELECT symbol, arg_min(equity, date) AS a, arg_max(equity, date) AS b, max(date) - min(date) AS days FROM eq GROUP BY symbol))"
_CAPTURE = "avg(r) FILTER (b > 0) / avg(b) FILTER (b > 0) * 100 AS up_capture, avg(r) FILTER (b < 0) / avg(b) FILTER (b < 0) * 100 AS down_capture, coalesce(any_value(cagr) / nullif(covar_samp(r, b) / var_samp(b), 0), 0) AS treynor"


@query(f"{_REL}, {_E}, {_GROWTH}, c AS (SELECT symbol, {_CAPTURE} FROM j JOIN g USING (symbol) GROUP BY symbol) SELECT symbol, round(up_capture, 6) AS up_capture, round(down_capture, 6) AS down_capture, round(treynor, 4) AS treynor FROM c", "brand", "mkt")
def met_capture(spark: SparkSession, sf: str) -> DataFrame:
    out = M.treynor(M.relative(_returns(spark, sf), _market(spark, sf), BY), M.growth(_equity(spark, sf), BY), BY)
    return out.select("symbol", r6("up_capture").alias("up_capture"), r6("down_capture").alias("down_capture"), F.round("treynor", 4).alias("treynor"))


@query(f"WITH {_R}, q AS (SELECT symbol, quantile_cont(r, 0.05) AS v FROM r GROUP BY symbol) SELECT symbol, round(v, 6) AS var, round(avg(r) FILTER (r <= v), 6) AS cvar FROM r JOIN q USING (symbol) GROUP BY symbol, v", "brand")
def met_var_cvar(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.value_at_risk(_returns(spark, sf), BY))


_OMEGA = "CASE WHEN sum(greatest(-r, 0)) > 0 THEN sum(greatest(r, 0)) / sum(greatest(-r, 0)) WHEN sum(greatest(r, 0)) > 0 THEN 'infinity'::DOUBLE ELSE 0 END"


@query(f"WITH {_R} SELECT symbol, round({_OMEGA}, 6) AS omega FROM r GROUP BY symbol", "brand")
def met_omega(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_returns(spark, sf).groupBy("symbol").agg(M.omega(C("r")).alias("omega")))


_T = f"WITH {_TRADES}, t AS (SELECT *, exit_price - entry_price AS pnl FROM trades)"
_PAYOFF = "CASE WHEN count(*) FILTER (pnl < 0) > 0 THEN coalesce(avg(pnl) FILTER (pnl > 0), 0) / -avg(pnl) FILTER (pnl < 0) WHEN count(*) FILTER (pnl > 0) > 0 THEN 'infinity'::DOUBLE ELSE 0 END"


@query(f"""{_T} SELECT symbol, count(*) AS n_trades, round(avg((pnl > 0)::INT), 6) AS win_rate, round(sum(pnl) FILTER (pnl > 0) / abs(sum(pnl) FILTER (pnl < 0)), 6) AS profit_factor, round(avg(pnl), 6) AS expectancy,
round({_PAYOFF}, 6) AS payoff, round(avg(holding_days), 6) AS avg_holding, quantile_cont(holding_days::DOUBLE, 0.5) AS median_holding, max(holding_days) AS max_holding FROM t GROUP BY symbol""", "mkt")
def met_trades(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.trade_metrics(_trades(spark, sf), BY).select("symbol", "n_trades", "win_rate", "profit_factor", "expectancy", "payoff", "avg_holding", "median_holding", "max_holding"))


@query(f"""{_T}, sg AS (SELECT symbol, sign(pnl) AS s, row_number() OVER (ORDER BY entry_date) - row_number() OVER (PARTITION BY sign(pnl) ORDER BY entry_date) AS g FROM t), k AS (SELECT symbol, s, count(*) AS n FROM sg GROUP BY symbol, s, g)
SELECT symbol, coalesce(max(n) FILTER (s > 0), 0) AS max_wins, coalesce(max(n) FILTER (s < 0), 0) AS max_losses FROM k GROUP BY symbol""", "mkt")
def met_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return M.streaks(_trades(spark, sf), BY, "entry_date")


@query(f"""{_T}, d AS (SELECT DISTINCT symbol, x::DATE AS date FROM (SELECT symbol, unnest(generate_series(entry_date::TIMESTAMP, exit_date::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM t) WHERE isodow(x) < 6)
SELECT m.symbol, round(count(d.date) / count(*), 6) AS exposure FROM mkt m LEFT JOIN d ON m.symbol = d.symbol AND m.date = d.date GROUP BY m.symbol""", "mkt")
def met_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.exposure(_trades(spark, sf), bars.market_bars(spark, sf).select("symbol", "date"), BY))


_CLAMPED = "least(greatest({x}, -99999), 99999)"
_BUNDLE = [
    "total_return", "cagr", "sharpe", "sortino", "volatility", "omega", "max_drawdown", "max_drawdown_days", "var", "cvar", "n_trades", "win_rate", "profit_factor", "expectancy", "avg_win", "avg_loss", "payoff", "avg_holding", "median_holding",
    "max_holding", "min_holding", "avg_holding_winners", "avg_holding_losers", "max_wins", "max_losses", "exposure", "beta", "alpha", "information_ratio", "tracking_error", "up_capture", "down_capture", "treynor", "calmar",
]
_WHOLE = {"max_drawdown_days", "n_trades", "max_holding", "min_holding", "max_wins", "max_losses"}


@query(f"""{_T}, d0 AS (SELECT m.symbol, m.date, m.close, i.entry_price AS ip, o.exit_price AS op FROM mkt m LEFT JOIN trades i ON i.symbol = m.symbol AND i.entry_date = m.date LEFT JOIN trades o ON o.symbol = m.symbol AND o.exit_date = m.date),
h0 AS (SELECT *, sum((ip IS NOT NULL)::INT - (op IS NOT NULL)::INT) OVER w AS held, lag(close) OVER w AS prior FROM d0 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
g0 AS (SELECT symbol, date, CASE WHEN ip IS NOT NULL AND op IS NULL THEN close / ip WHEN op IS NOT NULL AND ip IS NULL THEN op / prior WHEN held > 0 THEN close / prior ELSE 1 END AS f FROM h0),
eq AS (SELECT symbol, date, round(exp(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY date)), 9) AS equity FROM g0), {_DD}{_RUNS[len(_E) + len(_DD) + 2:]},
r AS (SELECT symbol, date, r FROM (SELECT symbol, date, equity / nullif(lag(equity) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r FROM eq) WHERE r IS NOT NULL), {_GROWTH}, {_MR},
k AS (SELECT symbol, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe, coalesce({_CLAMPED.format(x="avg(r) / nullif(sqrt(avg(pow(least(r, 0), 2))), 0) * sqrt(252)")}, 99999) AS sortino, stddev_samp(r) * sqrt(252) AS volatility, {_CLAMPED.format(x=_OMEGA)} AS omega FROM r GROUP BY symbol),
x AS (SELECT symbol, min(drawdown) AS max_drawdown FROM dd GROUP BY symbol), y AS (SELECT symbol, max(days) AS max_drawdown_days FROM runs GROUP BY symbol),
q AS (SELECT symbol, quantile_cont(r, 0.05) AS "var" FROM r GROUP BY symbol), v AS (SELECT symbol, any_value("var") AS "var", avg(r) FILTER (r <= "var") AS cvar FROM r JOIN q USING (symbol) GROUP BY symbol),
u AS (SELECT symbol, count(*) AS n_trades, avg((pnl > 0)::INT) AS win_rate, CASE WHEN count(*) FILTER (pnl < 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0) WHEN count(*) FILTER (pnl > 0) > 0 THEN 99999 ELSE 0 END AS profit_factor, avg(pnl) AS expectancy,
avg(pnl) FILTER (pnl > 0) AS avg_win, avg(pnl) FILTER (pnl < 0) AS avg_loss, {_CLAMPED.format(x=_PAYOFF)} AS payoff, avg(holding_days) AS avg_holding, quantile_cont(holding_days::DOUBLE, 0.5) AS median_holding, max(holding_days) AS max_holding, min(holding_days) AS min_holding,
avg(holding_days) FILTER (pnl > 0) AS avg_holding_winners, avg(holding_days) FILTER (pnl < 0) AS avg_holding_losers FROM t GROUP BY symbol),
sg AS (SELECT symbol, sign(pnl) AS s, row_number() OVER (ORDER BY exit_date, entry_date) - row_number() OVER (PARTITION BY sign(pnl) ORDER BY exit_date, entry_date) AS g FROM t), sr AS (SELECT symbol, s, count(*) AS n FROM sg GROUP BY symbol, s, g),
st AS (SELECT symbol, max(n) FILTER (s > 0) AS max_wins, max(n) FILTER (s < 0) AS max_losses FROM sr GROUP BY symbol),
hd AS (SELECT DISTINCT symbol, z::DATE AS date FROM (SELECT symbol, unnest(generate_series(entry_date::TIMESTAMP, exit_date::TIMESTAMP, INTERVAL 1 DAY)) AS z FROM t) WHERE isodow(z) < 6),
ex AS (SELECT m.symbol, count(hd.date) / count(*) AS exposure FROM mkt m LEFT JOIN hd ON m.symbol = hd.symbol AND m.date = hd.date GROUP BY m.symbol),
j AS (SELECT symbol, r, b FROM r JOIN mr USING (date)), ca AS (SELECT symbol, covar_samp(r, b) / var_samp(b) AS beta, (avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252 AS alpha, avg(r - b) / stddev_samp(r - b) * sqrt(252) AS information_ratio, stddev_samp(r - b) * sqrt(252) AS tracking_error, {_CAPTURE} FROM j JOIN g USING (symbol) GROUP BY symbol),
al AS (SELECT *, CASE WHEN max_drawdown = 0 THEN CASE WHEN cagr > 0 THEN 99999 ELSE 0 END ELSE cagr / abs(max_drawdown) END AS calmar FROM g LEFT JOIN k USING (symbol) LEFT JOIN x USING (symbol) LEFT JOIN y USING (symbol) LEFT JOIN v USING (symbol) LEFT JOIN u USING (symbol) LEFT JOIN st USING (symbol) LEFT JOIN ex USING (symbol) LEFT JOIN ca USING (symbol))
SELECT symbol, {', '.join(f'coalesce("{c}", 0)::{"BIGINT" if c in _WHOLE else "DOUBLE"} AS "{c}"' if c in _WHOLE else f'round(coalesce("{c}", 0)::DOUBLE, 6) AS "{c}"' for c in _BUNDLE)} FROM al""", "mkt")
def met_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """All headline metrics of one run, with those against the market itself."""
    from ..operators.execution import single_position_equity

    trades = _trades(spark, sf)
    equity = single_position_equity(bars.market_bars(spark, sf), trades).withColumn("equity", F.round("equity", 9))
    out = rounded(M.bundle(equity, trades, BY, _market(spark, sf)))
    return out.select("symbol", *[C(c).cast("long").alias(c) if c in _WHOLE else C(c) for c in _BUNDLE])


@query(f"""WITH {_R}, p AS (SELECT symbol, year(date)::INTEGER AS year, month(date) AS m, exp(sum(ln(1 + r))) - 1 AS x FROM r GROUP BY ALL), y AS (SELECT symbol, year(date)::INTEGER AS year, exp(sum(ln(1 + r))) - 1 AS ytd FROM r GROUP BY ALL)
SELECT symbol, year, {', '.join(f'round(max(x) FILTER (m = {i}), 6) AS "{i}"' for i in range(1, 13))}, round(any_value(ytd), 6) AS ytd FROM p JOIN y USING (symbol, year) GROUP BY symbol, year""", "brand")
def cal_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.monthly_returns(_returns(spark, sf), BY))


@query(f"""WITH {_R}, l AS (SELECT symbol, year(date)::INTEGER AS year, date, r, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, year(date) ORDER BY date)) AS v FROM r),
d AS (SELECT *, v / max(v) OVER (PARTITION BY symbol, year ORDER BY date) - 1 AS dd FROM l)
SELECT symbol, year, round(exp(sum(ln(1 + r))) - 1, 6) AS total, round(min(dd), 6) AS max_dd, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0), 6) AS sharpe, count(*) AS days FROM d GROUP BY symbol, year""", "brand")
def cal_yearly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.yearly_summary(_returns(spark, sf), BY))


@query(f"""WITH m AS (SELECT symbol, date, close / nullif({_roll('avg', 'close', 200)}, 0) AS x FROM brand)
SELECT symbol, date, CASE WHEN x > 1.02 THEN 'bull' WHEN x < 0.98 THEN 'bear' WHEN x IS NOT NULL THEN 'sideways' ELSE 'unknown' END AS regime FROM m""", "brand")
def regime_market(spark: SparkSession, sf: str) -> DataFrame:
    return M.market_regime(bars.brand_bars(spark, sf))


_VOL = f"""{_R}, v AS (SELECT symbol, date, r, {_roll('stddev_samp', 'r', 63)} * sqrt(252) AS vol FROM r), q AS (SELECT symbol, quantile_cont(vol, 0.33) AS lo, quantile_cont(vol, 0.67) AS hi FROM v GROUP BY symbol),
lab AS (SELECT symbol, date, r, CASE WHEN vol IS NULL THEN 'unknown' WHEN vol <= lo THEN 'low_vol' WHEN vol > hi THEN 'high_vol' ELSE 'medium_vol' END AS regime FROM v JOIN q USING (symbol))"""


@query(f"WITH {_VOL} SELECT symbol, date, regime FROM lab", "brand")
def regime_vol(spark: SparkSession, sf: str) -> DataFrame:
    return M.volatility_regime(_returns(spark, sf), BY).select("symbol", "date", "regime")


@query(f"""WITH {_VOL}, l AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, regime ORDER BY date)) AS lv FROM lab), d AS (SELECT *, lv / max(lv) OVER (PARTITION BY symbol, regime ORDER BY date) - 1 AS dd FROM l),
g AS (SELECT symbol, regime, exp(sum(ln(1 + r))) - 1 AS t, stddev_samp(r) * sqrt(252) AS v, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS s, min(dd) AS m, count(*) AS days FROM d GROUP BY symbol, regime)
SELECT symbol, regime, round(t, 6) AS total_return, round(v, 6) AS volatility, round(s, 6) AS sharpe, round(m, 6) AS max_drawdown, days, round(days / sum(days) OVER (PARTITION BY symbol), 6) AS pct_of_time FROM g""", "brand")
def regime_perf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.regime_performance(M.volatility_regime(_returns(spark, sf), BY), BY))


@query("""WITH r AS (SELECT symbol, date, r FROM (SELECT symbol, date, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r FROM evt) WHERE r IS NOT NULL),
f AS (SELECT date FROM r GROUP BY date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM r)), x AS (SELECT * FROM r WHERE date IN (SELECT date FROM f))
SELECT p.symbol AS a, q.symbol AS b, round(corr(p.r, q.r), 6) AS corr FROM x p JOIN x q USING (date) GROUP BY ALL""", "evt")
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    e = bars.event_bars(spark, sf).select("symbol", "date", C("close").alias("equity"))
    return rounded(M.correlation_matrix(M.returns(e, BY)))


@query(f"""{_REL.replace('SELECT symbol, r, b', 'SELECT symbol, date, r, b')}
SELECT symbol, date, round(CASE WHEN count(*) OVER w >= 63 THEN corr(r, b) OVER w END, 5) + 0.0 AS corr FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""", "brand", "mkt")
def corr_rolling(spark: SparkSession, sf: str) -> DataFrame:
    j = _returns(spark, sf).join(_market(spark, sf), "date")
    w = bars.by_symbol().rowsBetween(-62, 0)
    return j.select("symbol", "date", (F.round(F.when(F.count(F.lit(1)).over(w) >= 63, F.corr("r", "b").over(w)), 5) + 0.0).alias("corr"))


_W = "w AS (SELECT date, symbol, close * volume / sum(close * volume) OVER (PARTITION BY date) AS weight FROM brand)"


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    value = C("close") * C("volume")
    return bars.brand_bars(spark, sf).select("date", "symbol", (value / F.sum(value).over(Window.partitionBy("date"))).alias("weight"))


@query(f"WITH {_W} SELECT date, round(sum(weight * weight), 6) AS hhi, round(1 / sum(weight * weight), 6) AS effective_n, arg_max(symbol, (weight, symbol)) AS largest FROM w GROUP BY date", "brand")
def hhi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.concentration(_weights(spark, sf), ["date"]))


@query(f"""WITH {_W}, s AS (SELECT p_brand AS symbol, arg_max(p_type, p_partkey) AS sector FROM part GROUP BY p_brand)
SELECT date, coalesce(sector, 'Unknown') AS sector, count(*) AS n, round(sum(weight), 6) AS weight FROM w LEFT JOIN s USING (symbol) GROUP BY ALL""", "brand")
def sector_exposure(spark: SparkSession, sf: str) -> DataFrame:
    sectors = bars.read_table(spark, sf, "part").groupBy(C("p_brand").alias("symbol")).agg(F.max_by("p_type", "p_partkey").alias("sector"))
    j = _weights(spark, sf).join(sectors, "symbol", "left")
    return rounded(j.groupBy("date", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")))


@query(f"""WITH {_TRADES}, l AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM mkt),
d AS (SELECT h::INTEGER AS horizon, (b.close - a.close) / a.close AS x FROM trades t JOIN l a ON a.symbol = t.symbol AND a.date = t.entry_date JOIN (SELECT unnest(generate_series(1, 10)) AS h) ON true JOIN l b ON b.symbol = a.symbol AND b.i = a.i + h AND b.date <= t.exit_date)
SELECT horizon, count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_samp(x), 6) AS std FROM d GROUP BY horizon""", "mkt")
def decay_horizons(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.signal_decay(crossover_trades(spark, sf), bars.market_bars(spark, sf), 10))


@query(f"""WITH {_TRADES}, g AS (SELECT t.symbol, entry_date, entry_price, pnl_pct, min(low) AS lo, max(high) AS hi FROM trades t JOIN mkt b ON b.symbol = t.symbol AND b.date BETWEEN entry_date AND exit_date GROUP BY ALL)
SELECT symbol, entry_date, round(lo / entry_price - 1, 6) AS mae, round(hi / entry_price - 1, 6) AS mfe, round(pnl_pct / nullif(hi / entry_price - 1, 0), 6) AS efficiency FROM g""", "mkt")
def mae_mfe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.excursions(crossover_trades(spark, sf), bars.market_bars(spark, sf)).select("symbol", "entry_date", "mae", "mfe", "efficiency"))


@query(f"""WITH {_TRADES}, e AS (SELECT avg(close) AS a, (max(date) - min(date)) / 365.25::DOUBLE AS y FROM mkt)
SELECT round(sum(100 * entry_price) / any_value(a) / any_value(y), 6) AS turnover, round(sum(100 * entry_price * 0.0005::DOUBLE), 6) AS total_fees, round(sum(100 * entry_price * 0.0005::DOUBLE) / any_value(a), 6) AS cost_pct_equity FROM trades, e""", "mkt")
def tca_turnover(spark: SparkSession, sf: str) -> DataFrame:
    e = bars.market_bars(spark, sf).agg(F.avg("close").alias("a"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("y"))
    t = crossover_trades(spark, sf).agg(F.sum(100 * C("entry_price")).alias("v"), F.sum(100 * C("entry_price") * 0.0005).alias("f"))
    return t.crossJoin(F.broadcast(e)).select(r6(C("v") / C("a") / C("y")).alias("turnover"), r6("f").alias("total_fees"), r6(C("f") / C("a")).alias("cost_pct_equity"))


@query(f"WITH {_TRADES} SELECT round(coalesce(min(x) FILTER (x > 0), 0), 6) AS capacity FROM (SELECT floor(volume * 0.01::DOUBLE) * close AS x FROM trades t JOIN mkt b ON b.symbol = t.symbol AND b.date = t.entry_date)", "mkt")
def tca_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.capacity(crossover_trades(spark, sf), bars.market_bars(spark, sf)))


_SV = f"{_R}, g AS (SELECT symbol, count(*)::DOUBLE AS n, avg(r) / stddev_pop(r) AS s, skewness(r) AS k3, kurtosis(r) AS k4 FROM r GROUP BY symbol), v AS (SELECT symbol, n, s * sqrt(252) AS sharpe, (1 + 0.5 * s * s - k3 * s + k4 / 4 * s * s) / (n - 1) * 252 AS variance, k3, k4 FROM g)"


@query(f"WITH {_SV} SELECT symbol, n, round(sharpe, 6) AS sharpe, round(k3, 6) AS skew, round(k4, 6) AS excess_kurtosis, round(variance, 6) AS variance FROM v", "brand")
def sharpe_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.sharpe_variance(_returns(spark, sf), BY))


_BEST = (1 - 0.5772156649) * M.normal_quantile(1 - 1 / 20) + 0.5772156649 * M.normal_quantile(1 - 1 / (20 * 2.718281828459045))


@query(f"""WITH {_SV}, x AS (SELECT symbol, (sharpe - sqrt(variance) * {_BEST!r}) / sqrt(variance) AS x FROM v), t AS (SELECT symbol, x, abs(x) / sqrt(2) AS z, 1 / (1 + 0.3275911::DOUBLE * abs(x) / sqrt(2)) AS t FROM x),
e AS (SELECT symbol, x, 1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-z * z) AS f FROM t)
SELECT symbol, round(CASE WHEN x >= 0 THEN 0.5::DOUBLE * (1 + f) ELSE 0.5::DOUBLE * (1 - f) END, 6) AS dsr FROM e""", "brand")
def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.deflated_sharpe(M.sharpe_variance(_returns(spark, sf), BY), BY, 20))


_SPAN = "SELECT min(date) AS a, max(date) AS b FROM mkt"


@query(f"""WITH w AS (SELECT i::INTEGER AS "window", (a + to_months(i * 6))::DATE AS s, b FROM ({_SPAN}), (SELECT unnest(generate_series(0, 40))::INTEGER AS i)),
x AS (SELECT "window", s AS is_start, (s + to_months(24))::DATE AS is_end, b FROM w), y AS (SELECT *, is_end + 1 AS oos_start FROM x)
SELECT "window", is_start, is_end, oos_start, least((oos_start + to_months(6))::DATE, b) AS oos_end FROM y WHERE oos_start < b""", "mkt")
def walk_forward_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Over the span of the market's bars."""
    return research.walk_forward_windows(spark, *bars.span(bars.market_bars(spark, sf)), 24, 6)


@query(f"""WITH c AS (SELECT a, b, (b - a) // 5 AS z FROM ({_SPAN})), f AS (SELECT unnest(generate_series(0, 4))::INTEGER AS i),
p AS (SELECT i, (a + (i * z)::INTEGER) AS s, CASE WHEN i = 4 THEN b ELSE (a + ((i + 1) * z - 1)::INTEGER) END AS e FROM f, c),
t AS (SELECT x.i AS fold, x.s AS test_start, x.e AS test_end, y.i, CASE WHEN y.i = x.i + 1 THEN y.s + 5 ELSE y.s END AS s, CASE WHEN y.i = x.i - 1 THEN y.e - 10 ELSE y.e END AS e FROM p x JOIN p y ON x.i <> y.i)
SELECT fold, test_start, test_end, s AS train_start, e AS train_end FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY e - s DESC, i) AS k FROM t WHERE s < e) WHERE k = 1""", "mkt")
def kfold_windows(spark: SparkSession, sf: str) -> DataFrame:
    return research.purged_folds(spark, *bars.span(bars.market_bars(spark, sf)), 5)


_SERIES = "ser AS (SELECT row_number() OVER (ORDER BY date) - 1 AS i, b AS r FROM mr), n AS (SELECT count(*) AS n FROM ser)"
_LCG = "(((({x}) % 2147483647 + 2147483647) % 2147483647 + 1) * 48271 % 2147483647 * 48271 % 2147483647)"


def _series(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.orderBy("date")  # one series: a row a day
    return _market(spark, sf).select((F.row_number().over(w) - 1).cast("long").alias("i"), C("b").alias("r"))


@query(f"""WITH {_MR}, {_SERIES}, g AS (SELECT s AS sim, t AS step, {_LCG.format(x='s * 1000003 + t * 7919 + 42')} % n AS i FROM n, (SELECT unnest(generate_series(0, 39)) AS s), (SELECT unnest(generate_series(0, n - 1)) AS t FROM n)),
p AS (SELECT sim, step, exp(sum(ln(1 + r)) OVER (PARTITION BY sim ORDER BY step)) AS growth FROM g JOIN ser USING (i))
SELECT step, round(quantile_cont(growth, 0.05), 6) AS p5, round(quantile_cont(growth, 0.5), 6) AS p50, round(quantile_cont(growth, 0.95), 6) AS p95 FROM p GROUP BY step""", "mkt")
def monte_carlo(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile bands of bootstrapped growth at each step."""
    paths = research.bootstrap_paths(_series(spark, sf), 40)
    return rounded(paths.groupBy("step").agg(*[F.expr(f"percentile(growth, {p})").alias(f"p{int(100 * p)}") for p in (0.05, 0.5, 0.95)]))


@query(f"""WITH {_MR}, {_SERIES}, o AS (SELECT avg(r) / stddev_pop(r) * sqrt(252) AS observed FROM ser),
f AS (SELECT p, CASE WHEN {_LCG.format(x='p * 1000003 + i * 7919 + 42')} % 2 = 0 THEN r ELSE -r END AS r FROM ser, (SELECT unnest(generate_series(0, 99)) AS p)),
s AS (SELECT p, avg(r) / stddev_pop(r) * sqrt(252) AS s FROM f GROUP BY p)
SELECT round(observed, 6) AS observed, avg((s >= observed)::INT) AS p_value, count(*) AS n FROM s, o GROUP BY observed""", "mkt")
def permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(research.sign_flip_test(_series(spark, sf), 100))
