"""Performance analytics of equity curves (run_id, date, equity), trades and returns; all keyed, none collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
DAYS = 252.0
#: What infinite ratios are set to in the metric bundle.
CLAMP = 99999.0


def _w(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy("date")


def returns(equity: DataFrame, by: list[str], value: str = "equity") -> DataFrame:
    """The keys, date and r, without the first row of each key."""
    r = C(value) / F.nullif(F.lag(value).over(_w(by)), F.lit(0.0)) - 1
    return equity.select(*by, "date", r.alias("r")).where("r is not null")


def safe(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def sharpe(r: Column, rf: float = 0.0) -> Column:
    return F.coalesce(safe(F.avg(r - rf / DAYS), F.stddev_samp(r)) * F.sqrt(F.lit(DAYS)), F.lit(0.0))


def sortino(r: Column, rf: float = 0.0) -> Column:
    """Downside deviation over all rows; infinite without a loss."""
    down = F.sqrt(F.avg(F.pow(F.least(r - rf / DAYS, F.lit(0.0)), 2)))
    return F.coalesce(safe(F.avg(r - rf / DAYS), down) * F.sqrt(F.lit(DAYS)), F.lit(float("inf")))


def growth(equity: DataFrame, by: list[str]) -> DataFrame:
    """Total return and CAGR."""
    ends = equity.groupBy(*by).agg(F.min_by("equity", "date").alias("a"), F.max_by("equity", "date").alias("b"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    return ends.select(*by, F.coalesce(safe(C("b"), C("a")) - 1, F.lit(0.0)).alias("total_return"), F.when((C("a") > 0) & (C("days") > 0), F.pow(C("b") / C("a"), F.lit(365.25) / C("days")) - 1).otherwise(0.0).alias("cagr"))


def drawdowns(equity: DataFrame, by: list[str]) -> DataFrame:
    """equity with the running peak and the drawdown."""
    peak = F.max("equity").over(_w(by).rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("peak", peak).withColumn("drawdown", F.coalesce(safe(C("equity") - C("peak"), C("peak")), F.lit(0.0)))


def drawdown_periods(equity: DataFrame, by: list[str]) -> DataFrame:
    """Underwater runs: start, trough, first recovered day (null while open), depth, calendar days to recovery or the end."""
    d = drawdowns(equity, by).withColumn("under", C("equity") < C("peak"))
    w = _w(by)
    d = d.withColumn("run", F.sum(F.when(~C("under"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumns({"after": F.lead("date").over(w), "end_date": F.max("date").over(Window.partitionBy(*by))})
    runs = d.where("under").groupBy(*by, "run").agg(
        F.min("date").alias("start"), F.min_by("date", F.struct("drawdown", "date")).alias("trough"), F.max_by("after", F.col("date")).alias("recovery"), F.min("drawdown").alias("depth"), F.max("end_date").alias("end_date")
    )
    return runs.withColumn("days", F.datediff(F.coalesce("recovery", "end_date"), "start")).drop("run", "end_date")


def relative(r: DataFrame, benchmark: DataFrame, by: list[str], rf: float = 0.0) -> DataFrame:
    """Beta, alpha, information ratio, tracking error and captures against benchmark returns (date, b)."""
    j = r.join(benchmark, "date")
    active = C("r") - C("b")
    beta = safe(F.covar_samp("r", "b"), F.var_samp("b"))
    capture = lambda test: safe(F.avg(F.when(test, C("r"))), F.avg(F.when(test, C("b")))) * 100.0
    return j.groupBy(*by).agg(
        beta.alias("beta"), ((F.avg("r") - rf / DAYS - beta * (F.avg("b") - rf / DAYS)) * DAYS).alias("alpha"), (safe(F.avg(active), F.stddev_samp(active)) * F.sqrt(F.lit(DAYS))).alias("information_ratio"),
        (F.stddev_samp(active) * F.sqrt(F.lit(DAYS))).alias("tracking_error"), capture(C("b") > 0).alias("up_capture"), capture(C("b") < 0).alias("down_capture"),
    )


def treynor(relative_to: DataFrame, grown: DataFrame, by: list[str], rf: float = 0.0) -> DataFrame:
    """relative() with the Treynor ratio: yearly growth above the risk-free rate for each unit of beta, 0 without beta."""
    joined = relative_to.join(grown.select(*by, C("cagr").alias("_cagr")), by)
    return joined.withColumn("treynor", F.coalesce(safe(C("_cagr") - rf, C("beta")), F.lit(0.0))).drop("_cagr")


def value_at_risk(r: DataFrame, by: list[str], level: float = 0.05) -> DataFrame:
    """The lower percentile of returns by linear interpolation, and the mean of returns at or below it."""
    q = r.groupBy(*by).agg(F.expr(f"percentile(r, {level})").alias("var"))
    return r.join(q, by).groupBy(*by, "var").agg(F.avg(F.when(C("r") <= C("var"), C("r"))).alias("cvar"))


def _unless_lossless(gain: Column, loss: Column) -> Column:
    """gain / loss; infinite for gains without a loss, 0 without either."""
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf"))).otherwise(0.0)


def omega(r: Column, threshold: float = 0.0) -> Column:
    return _unless_lossless(F.sum(F.greatest(r - threshold, F.lit(0.0))), F.sum(F.greatest(threshold - r, F.lit(0.0))))


def trade_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    pnl, won, lost = C("pnl"), C("pnl") > 0, C("pnl") < 0
    gain, loss = F.sum(F.when(won, pnl).otherwise(0.0)), F.abs(F.sum(F.when(lost, pnl).otherwise(0.0)))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(F.when(won, 1.0).otherwise(0.0)).alias("win_rate"), F.when(loss == 0, F.when(gain > 0, F.lit(CLAMP)).otherwise(0.0)).otherwise(safe(gain, loss)).alias("profit_factor"),
        F.avg(pnl).alias("expectancy"), F.avg(F.when(won, pnl)).alias("avg_win"), F.avg(F.when(lost, pnl)).alias("avg_loss"), _unless_lossless(F.coalesce(F.avg(F.when(won, pnl)), F.lit(0.0)), F.coalesce(-F.avg(F.when(lost, pnl)), F.lit(0.0))).alias("payoff"),
        F.avg("holding_days").alias("avg_holding"), F.expr("percentile(holding_days, 0.5)").alias("median_holding"), F.max("holding_days").alias("max_holding"), F.min("holding_days").alias("min_holding"),
        F.coalesce(F.avg(F.when(won, C("holding_days"))), F.lit(0.0)).alias("avg_holding_winners"), F.coalesce(F.avg(F.when(lost, C("holding_days"))), F.lit(0.0)).alias("avg_holding_losers"),
    )


def streaks(trades: DataFrame, by: list[str], *order: str) -> DataFrame:
    """Longest runs of wins and of losses; a trade without profit or loss ends both."""
    sign = F.signum("pnl").cast("int")
    a = Window.partitionBy(*by).orderBy(*order)
    s = trades.withColumn("s", sign).withColumn("g", F.row_number().over(a) - F.row_number().over(Window.partitionBy(*by, "s").orderBy(*order)))
    runs = s.groupBy(*by, "s", "g").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*by).agg(F.coalesce(F.max(F.when(C("s") > 0, C("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(C("s") < 0, C("n"))), F.lit(0)).alias("max_losses"))


def exposure(trades: DataFrame, dates: DataFrame, by: list[str]) -> DataFrame:
    """Share of the dates that lie on a weekday between entry and exit of a trade."""
    days = trades.select(*by, F.explode(F.sequence("entry_date", "exit_date")).alias("date")).where(F.weekday("date") < 5).distinct()
    n = dates.groupBy(*by).agg(F.countDistinct("date").alias("n"))
    held = dates.select(*by, "date").distinct().join(days, [*by, "date"], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("h"))
    return n.join(held, by, "left").select(*by, F.coalesce(safe(C("h").cast("double"), C("n").cast("double")), F.lit(0.0)).alias("exposure"))


def bundle(equity: DataFrame, trades: DataFrame, by: list[str], benchmark: DataFrame | None = None, rf: float = 0.0) -> DataFrame:
    """One row of headline metrics for each key, with those against benchmark returns (date, b) if given; infinite
    ratios are clamped, missing ones are 0."""
    clamp = lambda x: F.when(x == float("inf"), CLAMP).when(x == float("-inf"), -CLAMP).otherwise(x)
    g, r = growth(equity, by), returns(equity, by)
    risk = r.groupBy(*by).agg(sharpe(C("r"), rf).alias("sharpe"), clamp(sortino(C("r"), rf)).alias("sortino"), (F.stddev_samp("r") * F.sqrt(F.lit(DAYS))).alias("volatility"), clamp(omega(C("r"))).alias("omega"))
    dd = drawdowns(equity, by).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))
    length = drawdown_periods(equity, by).groupBy(*by).agg(F.max("days").alias("max_drawdown_days"))
    parts = [risk, dd, length, value_at_risk(r, by), trade_metrics(trades, by).withColumn("payoff", clamp(C("payoff"))), streaks(trades, by, "exit_date", "entry_date"), exposure(trades, equity.select(*by, "date"), by)]
    if benchmark is not None:
        parts.append(treynor(relative(r, benchmark, by, rf), g, by, rf))
    out = reduce(lambda a, b: a.join(b, by, "left"), parts, g)
    calmar = F.when(C("max_drawdown") == 0, F.when(C("cagr") > 0, CLAMP).otherwise(0.0)).otherwise(safe(C("cagr"), F.abs(C("max_drawdown"))))
    return out.withColumn("calmar", calmar).fillna(0)


# Calendar, regimes, correlation, decay and costs.


def monthly_returns(r: DataFrame, by: list[str]) -> DataFrame:
    """year, months 1 to 12 and ytd: compounded returns."""
    y = r.withColumns({"year": F.year("date").cast("int"), "month": F.month("date")})
    product = F.exp(F.sum(F.log1p("r"))) - 1
    return y.groupBy(*by, "year").pivot("month", list(range(1, 13))).agg(product).join(y.groupBy(*by, "year").agg(product.alias("ytd")), [*by, "year"])


def yearly_summary(r: DataFrame, by: list[str]) -> DataFrame:
    """Return, drawdown inside the year, Sharpe ratio and days."""
    y = r.withColumn("year", F.year("date").cast("int"))
    own = Window.partitionBy(*by, "year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    level = y.withColumn("level", F.exp(F.sum(F.log1p("r")).over(own)))
    level = level.withColumn("dd", C("level") / F.max("level").over(own) - 1)
    return level.groupBy(*by, "year").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("total"), F.min("dd").alias("max_dd"), sharpe(C("r")).alias("sharpe"), F.count(F.lit(1)).alias("days"))


def market_regime(bars: DataFrame, period: int = 200, band: float = 0.02) -> DataFrame:
    from ..functions.indicators import with_indicators

    out = with_indicators(bars, {"m": {"fn": "sma", "period": period}})
    ratio = C("close") / F.nullif(C("m"), F.lit(0.0))
    return out.select("symbol", "date", F.when(ratio > 1 + band, "bull").when(ratio < 1 - band, "bear").when(ratio.isNotNull(), "sideways").otherwise("unknown").alias("regime"))


def volatility_regime(r: DataFrame, by: list[str], window: int = 63, low: float = 0.33, high: float = 0.67) -> DataFrame:
    frame = _w(by).rowsBetween(-(window - 1), 0)
    v = r.withColumn("vol", F.when(F.count("r").over(frame) >= window, F.stddev_samp("r").over(frame) * F.sqrt(F.lit(DAYS))))
    q = v.groupBy(*by).agg(F.expr(f"percentile(vol, {low})").alias("lo"), F.expr(f"percentile(vol, {high})").alias("hi"))
    label = F.when(C("vol").isNull(), "unknown").when(C("vol") <= C("lo"), "low_vol").when(C("vol") > C("hi"), "high_vol").otherwise("medium_vol")
    return v.join(q, by).select(*by, "date", "r", "vol", label.alias("regime"))


def regime_performance(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Returns of each label's days compounded in date order, as if they followed each other."""
    own = Window.partitionBy(*by, "regime").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = labelled.withColumn("level", F.exp(F.sum(F.log1p("r")).over(own)))
    x = x.withColumn("dd", C("level") / F.max("level").over(own) - 1)
    g = x.groupBy(*by, "regime").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("total_return"), (F.stddev_samp("r") * F.sqrt(F.lit(DAYS))).alias("volatility"), sharpe(C("r")).alias("sharpe"), F.min("dd").alias("max_drawdown"), F.count(F.lit(1)).alias("days"))
    return g.withColumn("pct_of_time", C("days") / F.sum("days").over(Window.partitionBy(*by)))


def correlation_matrix(r: DataFrame) -> DataFrame:
    """Pairwise correlation over the dates that all symbols have. r: (symbol, date, r)."""
    n = r.agg(F.countDistinct("symbol").alias("n"))
    full = r.groupBy("date").agg(F.countDistinct("symbol").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("date")
    x = r.join(full, "date", "left_semi")
    return x.select("date", C("symbol").alias("a"), C("r").alias("ra")).join(x.select("date", C("symbol").alias("b"), C("r").alias("rb")), "date").groupBy("a", "b").agg(F.corr("ra", "rb").alias("corr"))


def regime_summary(r: DataFrame, market_labels: DataFrame, by: list[str], window: int = 63) -> DataFrame:
    """Performance by market regime (labels of dates) and by volatility regime of the returns themselves, as kind."""
    market = r.join(market_labels.select("date", "regime"), "date").select(*by, "date", "r", "regime").withColumn("kind", F.lit("market"))
    own = volatility_regime(r, by, window).select(*by, "date", "r", "regime").withColumn("kind", F.lit("volatility"))
    return regime_performance(market.unionByName(own), [*by, "kind"])


def rolling_year(r: DataFrame, by: list[str], window: int = 252) -> DataFrame:
    """Yearly return and Sharpe ratio of the last window returns, from the first full window on."""
    frame = _w(by).rowsBetween(-(window - 1), 0)
    full, spread = F.count("r").over(frame) >= window, F.stddev_samp("r").over(frame)
    grown = F.exp(F.sum(F.log1p("r")).over(frame) * (DAYS / window)) - 1
    out = r.select(*by, "date", F.when(full, grown).alias("rolling_return"), F.when(full & (spread > 0), F.avg("r").over(frame) / spread * F.sqrt(F.lit(DAYS))).alias("rolling_sharpe"))
    return out.where("rolling_return is not null")


def attribution(equity: DataFrame, weights: DataFrame, by: str) -> DataFrame:
    """Each strategy's weight, growth, Sharpe ratio, profit, and its percentage of all profit (equal without any)."""
    profit = equity.groupBy(by).agg((F.max_by("equity", "date") - F.min_by("equity", "date")).alias("pnl"))
    total = profit.agg(F.sum("pnl").alias("_all"), F.count(F.lit(1)).alias("_n"))
    risk = returns(equity, [by]).groupBy(by).agg(sharpe(C("r")).alias("sharpe"))
    out = profit.join(growth(equity, [by]).select(by, "cagr"), by).join(risk, by, "left").join(weights, by, "left").crossJoin(total)
    share = F.when(C("_all") != 0, C("pnl") / C("_all")).otherwise(1.0 / C("_n")) * 100.0
    return out.select(by, F.coalesce("weight", F.lit(0.0)).alias("weight"), "cagr", F.coalesce("sharpe", F.lit(0.0)).alias("sharpe"), "pnl", share.alias("contribution_pct"))


def concentration(weights: DataFrame, by: list[str]) -> DataFrame:
    """Herfindahl index, effective number and largest holding of (symbol, weight)."""
    return weights.groupBy(*by).agg(F.sum(C("weight") * C("weight")).alias("hhi"), (1.0 / F.sum(C("weight") * C("weight"))).alias("effective_n"), F.max_by("symbol", F.struct("weight", "symbol")).alias("largest"))


def signal_decay(trades: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Mean, median and deviation of the return h sessions after entry, h = 1..horizon, within the trade."""
    w = Window.partitionBy("symbol").orderBy("date")
    cols = {f"h{h}": F.struct(F.lit(h).alias("h"), F.lead("date", h).over(w).alias("d"), F.lead("close", h).over(w).alias("c")) for h in range(1, horizon + 1)}
    led = bars.select("symbol", C("date").alias("entry_date"), "close", F.array(*cols.values()).alias("xs"))
    met = trades.join(led, ["symbol", "entry_date"]).select("symbol", "entry_date", "exit_date", "close", F.explode("xs").alias("x")).where("x.d is not null and x.d <= exit_date")
    change = (C("x.c") - C("close")) / C("close")
    return met.groupBy(C("x.h").alias("horizon")).agg(F.count(F.lit(1)).alias("n"), F.avg(change).alias("mean"), F.expr("percentile((x.c - close) / close, 0.5)").alias("median"), F.stddev_samp(change).alias("std"))


def decay_summary(decay: DataFrame) -> DataFrame:
    """The horizon with the highest mean return of signal_decay(), that return, and the one at the last horizon. Where
    means never fall the last horizon is best, where they never rise the first."""
    w = Window.orderBy("horizon")  # a row a horizon
    d = decay.where("mean is not null").withColumn("step", C("mean") - F.lag("mean").over(w))
    last, first = F.max_by("mean", "horizon"), F.min_by("mean", "horizon")
    up, down = F.coalesce(F.min("step") >= 0, F.lit(False)), F.coalesce(F.max("step") <= 0, F.lit(False))
    best, peak = F.max_by("horizon", F.struct(C("mean"), -C("horizon"))), F.max("mean")
    one = F.lit(1).cast("int")
    out = d.agg(F.when(up, F.max("horizon")).when(down, one).otherwise(best).alias("optimal_days"), F.when(up, last).when(down, first).otherwise(peak).alias("peak_return"), last.alias("return_at_max_horizon"))
    return out.select(F.coalesce("optimal_days", F.lit(0)).cast("int").alias("optimal_days"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("peak_return", "return_at_max_horizon")])


def excursions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Worst and best move of each trade between entry and exit, both days counted, and pnl_pct by the best one.

    Trades (symbol, entry_date, exit_date, entry_price, pnl_pct and, if short ones are below 0, quantity) may overlap
    and repeat. Each meets the bars of its days by an equi-join: single days in the months of its entry and exit, the
    extremes of whole months between. Trades without a bar or a price above 0 have moves of 0."""
    keys = ["symbol", "entry_date", "exit_date", "entry_price", "pnl_pct", *(["quantity"] if "quantity" in trades.columns else [])]
    days = bars.select("symbol", C("date").alias("start"), F.lit("day").alias("unit"), "low", "high")
    months = bars.groupBy("symbol", F.trunc("date", "month").alias("start")).agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("unit", F.lit("month"))
    month = lambda c, n: F.add_months(F.trunc(c, "month"), n)
    each = lambda a, b, unit: F.transform(F.when(a <= b, F.sequence(a, b, F.expr(f"interval 1 {unit}"))).otherwise(F.array()), lambda d: F.struct(F.lit(unit).alias("unit"), d.alias("start")))
    last_month = F.greatest(month("exit_date", 0), month("entry_date", 1))
    held = F.concat(each(C("entry_date"), F.least(C("exit_date"), F.last_day("entry_date")), "day"), each(month("entry_date", 1), month("exit_date", -1), "month"), each(last_month, C("exit_date"), "day"))
    unique = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    met = unique.select(*keys, "_n", F.inline_outer(held)).join(days.unionByName(months), ["symbol", "unit", "start"], "left")
    g = met.groupBy(*keys, "_n").agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    price = F.when(C("entry_price") > 0, C("entry_price"))
    down, up = C("lo") / price - 1, C("hi") / price - 1
    if "quantity" in keys:
        down, up = F.when(C("quantity") < 0, 1 - C("hi") / price).otherwise(down), F.when(C("quantity") < 0, 1 - C("lo") / price).otherwise(up)
    out = g.select(*keys, F.coalesce(down, F.lit(0.0)).alias("mae"), F.coalesce(up, F.lit(0.0)).alias("mfe"), F.explode(F.array_repeat(F.lit(0), C("_n").cast("int"))).alias("_i"))
    return out.select(*keys, "mae", "mfe", safe(C("pnl_pct"), C("mfe")).alias("efficiency"))


def excursion_summary(moves: DataFrame) -> DataFrame:
    """Mean worst and best move of all trades, and the best by the worst; 0 without trades."""
    worst, best = F.avg("mae"), F.avg("mfe")
    return moves.agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in ((worst, "avg_mae"), (best, "avg_mfe"), (F.abs(safe(best, worst)), "efficiency"))])


def capacity(trades: DataFrame, bars: DataFrame, share: float = 0.01) -> DataFrame:
    """The least position value that stays within a share of the volume on entry days."""
    met = trades.join(bars.select("symbol", C("date").alias("entry_date"), "close", "volume"), ["symbol", "entry_date"])
    value = F.floor(C("volume") * share) * C("close")
    return met.agg(F.coalesce(F.min(F.when(value > 0, value)), F.lit(0.0)).alias("capacity"))


def sharpe_variance(r: DataFrame, by: list[str]) -> DataFrame:
    """Variance of the yearly Sharpe ratio: population deviation, bias-corrected skewness and kurtosis."""
    g = r.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"))
    n, sr = C("n"), C("m") / C("s")
    skew = F.sqrt(n * (n - 1)) / (n - 2) * C("g1")
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * C("g2") + 6)
    return g.select(*by, "n", (sr * F.sqrt(F.lit(DAYS))).alias("sharpe"), skew.alias("skew"), kurt.alias("excess_kurtosis"), ((1 + 0.5 * sr * sr - skew * sr + kurt / 4 * sr * sr) / (n - 1) * DAYS).alias("variance"))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 on the error function."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(min(max(p, 1e-15), 1 - 1e-15))


def deflated_sharpe(moments: DataFrame, by: list[str], trials: int) -> DataFrame:
    """Probability that the Sharpe ratio beats the best of `trials` unskilled ones; from sharpe_variance()."""
    import math

    euler = 0.5772156649
    best = (1 - euler) * normal_quantile(1 - 1 / trials) + euler * normal_quantile(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    se = F.sqrt("variance")
    return moments.select(*by, normal_cdf((C("sharpe") - se * best) / se).alias("dsr"))
