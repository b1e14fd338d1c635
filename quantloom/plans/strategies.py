"""The strategies as entry and exit Columns over enriched bars.

features() adds what a strategy needs; entry() and exit_() are NULL-safe booleans. Columns that enrichment did not
add count as NULL. Whether a position is open is the simulator's business.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import with_indicators
from . import rules

REGISTRY: dict[str, type[Strategy]] = {}


class Columns:
    """Columns of a frame by name; missing ones are NULL doubles."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if name in self.names else F.lit(None).cast("double")


def known(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def score(*tests: Column) -> Column:
    """How many tests hold; NULL tests do not."""
    return reduce(lambda a, b: a + b, [yes(t).cast("int") for t in tests])


@dataclass
class Strategy:
    params: dict = field(default_factory=dict)
    name = ""
    defaults = {}

    def __init_subclass__(cls) -> None:
        if cls.name:
            REGISTRY[cls.name] = cls

    def __post_init__(self) -> None:
        self.p = {**self.defaults, **self.params}
        self.check()

    def check(self) -> None:
        """Raises on parameters that make no sense."""

    def features(self, bars: DataFrame) -> DataFrame:
        return with_indicators(bars, {"sma_trend": {"fn": "sma", "period": self.p["sma_period"]}})

    def entry(self, c: Columns) -> Column:
        raise NotImplementedError

    def exit_(self, c: Columns) -> Column:
        raise NotImplementedError

    def signals(self, bars: DataFrame) -> DataFrame:
        """bars with features and the booleans buy and sell."""
        out = self.features(bars)
        c = Columns(out)
        return out.withColumns({"buy": yes(self.entry(c)), "sell": yes(self.exit_(c))})


class SmaCrossover(Strategy):
    name = "sma_crossover"
    defaults = {"sma_fast": 20, "sma_slow": 50}

    def check(self) -> None:
        if self.p["sma_fast"] >= self.p["sma_slow"]:
            raise ValueError("sma_fast must be below sma_slow")

    def features(self, bars: DataFrame) -> DataFrame:
        return with_indicators(bars, {"sma_fast": {"fn": "sma", "period": self.p["sma_fast"]}, "sma_slow": {"fn": "sma", "period": self.p["sma_slow"]}})

    def entry(self, c: Columns) -> Column:
        return c["sma_fast"] > c["sma_slow"]

    def exit_(self, c: Columns) -> Column:
        return c["sma_fast"] < c["sma_slow"]


class RuleBased(Strategy):
    name = "rule_based"
    defaults = {"indicators": {}, "buy_when": [], "sell_when": [], "short_when": [], "cover_when": [], "max_hold_days": None}

    def check(self) -> None:
        for key in ("buy_when", "sell_when", "short_when", "cover_when"):
            rules.validate(self.p[key])

    def features(self, bars: DataFrame) -> DataFrame:
        return with_indicators(bars, self.p["indicators"])

    def signals(self, bars: DataFrame) -> DataFrame:
        out = self.features(bars)
        return out.withColumns({k: rules.compile_rules(self.p[f"{k}_when"], out.columns) for k in ("buy", "sell", "short", "cover")})


class FundamentalScreener(Strategy):
    name = "fundamental_screener"
    defaults = {"rules": [], "exit_rules": [], "sma_period": 200}

    def signals(self, bars: DataFrame) -> DataFrame:
        out = self.features(bars)
        buy = rules.compile_rules(self.p["rules"], out.columns, lenient=True)
        exits = rules.compile_rules(self.p["exit_rules"], out.columns, lenient=True)
        trend = F.col("close") < F.col("sma_trend")
        return out.withColumns({"buy": yes(buy), "sell": yes(F.coalesce(exits, trend))})


class ValueQuality(Strategy):
    name = "value_quality"
    defaults = {"sma_period": 200, "max_pe": 20.0, "min_pe": 0.0, "min_revenue_growth": 0.0, "max_debt_to_equity": 1.5, "min_net_margin": 0.05}
    needs = ("sma_trend", "fund_net_income", "fund_pe_ratio", "fund_revenue_growth_yoy", "fund_debt_to_equity", "fund_net_margin")

    def entry(self, c: Columns) -> Column:
        p = self.p
        return (
            known(*[c[n] for n in self.needs]) & (c["fund_net_income"] > 0) & (c["fund_pe_ratio"] > p["min_pe"]) & (c["fund_pe_ratio"] < p["max_pe"])
            & (c["fund_revenue_growth_yoy"] >= p["min_revenue_growth"]) & (c["fund_debt_to_equity"] <= p["max_debt_to_equity"]) & (c["fund_net_margin"] >= p["min_net_margin"]) & (c["close"] > c["sma_trend"])
        )

    def exit_(self, c: Columns) -> Column:
        return known(*[c[n] for n in self.needs]) & ((c["fund_net_income"] <= 0) | (c["fund_pe_ratio"] > 1.5 * self.p["max_pe"]) | ~(c["close"] > c["sma_trend"]))


class EarningsGrowth(Strategy):
    name = "earnings_growth"
    defaults = {"sma_period": 50, "min_earnings_growth": 0.1, "min_revenue_growth": 0.05, "max_pe": 40.0}
    needs = ("sma_trend", "fund_earnings_growth_yoy", "fund_revenue_growth_yoy", "fund_pe_ratio")

    def entry(self, c: Columns) -> Column:
        p = self.p
        return known(*[c[n] for n in self.needs]) & (c[self.needs[1]] >= p["min_earnings_growth"]) & (c[self.needs[2]] >= p["min_revenue_growth"]) & (c["close"] > c["sma_trend"]) & (c[self.needs[3]] < p["max_pe"])

    def exit_(self, c: Columns) -> Column:
        return known(*[c[n] for n in self.needs]) & ((c["fund_earnings_growth_yoy"] < 0) | ~(c["close"] > c["sma_trend"]))


class InsiderFollowing(Strategy):
    name = "insider_following"
    defaults = {"sma_period": 50, "min_officer_buys": 2, "insider_buy_ratio_threshold": 0.7, "sell_on_heavy_selling": True, "heavy_selling_threshold": -50000.0}

    def entry(self, c: Columns) -> Column:
        bought = yes(c["insider_officer_buys_90d"] >= self.p["min_officer_buys"]) | yes(c["insider_buy_ratio_90d"] >= self.p["insider_buy_ratio_threshold"])
        return known(c["sma_trend"]) & bought & (c["close"] > c["sma_trend"])

    def exit_(self, c: Columns) -> Column:
        told = c["insider_officer_buys_90d"].isNotNull() | c["insider_buy_ratio_90d"].isNotNull()
        heavy = yes(c["insider_net_shares_30d"] < self.p["heavy_selling_threshold"]) & F.lit(self.p["sell_on_heavy_selling"])
        return known(c["sma_trend"]) & told & (heavy | ~(c["close"] > c["sma_trend"]))


class SmartMoney(Strategy):
    name = "smart_money"
    defaults = {"sma_period": 50, "inst_growth_threshold": 0.02, "insider_confirmation": True, "min_revenue_growth": 0.0}

    def _known(self, c: Columns) -> Column:
        return known(c["sma_trend"], c["inst_shares_change_pct"], c["fund_net_income"], c["fund_revenue_growth_yoy"])

    def entry(self, c: Columns) -> Column:
        confirmed = yes(c["insider_buy_ratio_90d"] > 0.5) if self.p["insider_confirmation"] else F.lit(True)
        return (
            self._known(c) & (c["inst_shares_change_pct"] >= self.p["inst_growth_threshold"]) & confirmed & (c["fund_net_income"] > 0)
            & (c["fund_revenue_growth_yoy"] >= self.p["min_revenue_growth"]) & (c["close"] > c["sma_trend"])
        )

    def exit_(self, c: Columns) -> Column:
        left = (c["inst_shares_change_pct"] < -self.p["inst_growth_threshold"]) & yes(c["insider_net_shares_30d"] < 0)
        return self._known(c) & (left | (c["fund_net_income"] <= 0) | ~(c["close"] > c["sma_trend"]))


class MacroAwareValue(Strategy):
    name = "macro_aware_value"
    defaults = {"sma_period": 200, "expansion_min_f": 5, "contraction_min_f": 7, "expansion_max_pe": 25.0, "contraction_max_pe": 15.0, "min_z_score": 1.8, "credit_threshold": 5.0}
    needs = ("sma_trend", "fund_piotroski_f", "fund_pe_ratio", "fund_altman_z")

    def entry(self, c: Columns) -> Column:
        p = self.p
        growing = yes((c["fred_yield_spread_10y2y"] > 0) & (c["fred_credit_spread_hy"] < p["credit_threshold"]))
        min_f = F.when(growing, p["expansion_min_f"]).otherwise(p["contraction_min_f"])
        max_pe = F.when(growing, p["expansion_max_pe"]).otherwise(p["contraction_max_pe"])
        return known(*[c[n] for n in self.needs]) & (c["fund_piotroski_f"] >= min_f) & (c["fund_pe_ratio"] < max_pe) & (c["fund_altman_z"] >= p["min_z_score"]) & (c["close"] > c["sma_trend"])

    def exit_(self, c: Columns) -> Column:
        return known(*[c[n] for n in self.needs]) & ((c["fund_piotroski_f"] < 3) | (c["fund_altman_z"] < self.p["min_z_score"]) | ~(c["close"] > c["sma_trend"]))


class SentimentMomentum(Strategy):
    name = "sentiment_momentum"
    defaults = {"sma_period": 50, "min_signals_buy": 2, "min_signals_sell": 2, "insider_buy_threshold": 0.6, "insider_sell_threshold": 0.3}

    def entry(self, c: Columns) -> Column:
        return known(c["sma_trend"]) & (score(c["analyst_rev_breadth"] > 0, c["insider_buy_ratio_90d"] > self.p["insider_buy_threshold"], c["close"] > c["sma_trend"]) >= self.p["min_signals_buy"])

    def exit_(self, c: Columns) -> Column:
        return known(c["sma_trend"]) & (score(c["analyst_rev_breadth"] < 0, c["insider_buy_ratio_90d"] < self.p["insider_sell_threshold"], c["close"] < c["sma_trend"]) >= self.p["min_signals_sell"])


class RiskRegime(Strategy):
    name = "risk_regime"
    defaults = {
        "sma_period": 200, "vix_threshold": 1.0, "yield_spread_threshold": 0.0, "credit_threshold": 5.0, "min_f_score": 5, "use_trend": False, "use_intermarket": False, "use_pcr": False,
        "pcr_fear_threshold": 1.0,
    }

    def _tests(self, c: Columns) -> list[tuple[Column, Column]]:
        p = self.p
        out = [
            (c["vix_ratio"], c["vix_ratio"] < p["vix_threshold"]), (c["fred_yield_spread_10y2y"], c["fred_yield_spread_10y2y"] > p["yield_spread_threshold"]),
            (c["fred_credit_spread_hy"], c["fred_credit_spread_hy"] < p["credit_threshold"]),
        ]
        out += [(c["sentiment_pcr_ma10"], c["sentiment_pcr_ma10"] < p["pcr_fear_threshold"])] * p["use_pcr"]
        out += [(c["intermarket_cu_au_momentum"], c["intermarket_cu_au_momentum"] > 0)] * p["use_intermarket"]
        return out + [(c["sma_trend"], c["close"] > c["sma_trend"])] * p["use_trend"]

    def entry(self, c: Columns) -> Column:
        tests = self._tests(c)
        counted = score(*[x.isNotNull() for x, _ in tests])
        return (counted > 0) & (score(*[t for _, t in tests]) == counted) & F.coalesce(c["fund_piotroski_f"] >= self.p["min_f_score"], F.lit(True))

    def exit_(self, c: Columns) -> Column:
        tests = self._tests(c)
        return (score(*[x.isNotNull() for x, _ in tests]) > 0) & (score(*[t for _, t in tests]) == 0)


class MultiTimeframeTrend(Strategy):
    name = "multi_tf_trend"
    defaults = {"weekly_fast": 10, "weekly_slow": 30, "daily_rsi_period": 14, "rsi_entry": 40.0, "rsi_exit": 70.0}

    def features(self, bars: DataFrame) -> DataFrame:
        """The weekly means roll over the weekly closes as carried to days, so that 10 rows are 10 days."""
        from ..operators.joins import exact_join_ffill
        from ..sources.bars import resample

        weekly = resample(bars, "week").select("symbol", "date", F.col("close").alias("weekly_close"))
        daily = exact_join_ffill(bars, weekly, ["weekly_close"], by=["symbol"])
        means = {k: {"fn": "sma", "period": self.p[k], "column": "weekly_close"} for k in ("weekly_fast", "weekly_slow")}
        return with_indicators(daily, {"daily_rsi": {"fn": "rsi", "period": self.p["daily_rsi_period"]}, **means})

    def entry(self, c: Columns) -> Column:
        return known(c["daily_rsi"], c["weekly_fast"], c["weekly_slow"]) & (c["weekly_fast"] > c["weekly_slow"]) & (c["daily_rsi"] < self.p["rsi_entry"])

    def exit_(self, c: Columns) -> Column:
        return known(c["daily_rsi"], c["weekly_fast"], c["weekly_slow"]) & (c["daily_rsi"] > self.p["rsi_exit"])


class MomentumRotation(Strategy):
    name = "momentum_rotation"
    defaults = {"roc_period": 126, "top_n": 5, "abs_momentum": True, "sma_period": 0}

    def features(self, bars: DataFrame) -> DataFrame:
        specs = {"roc": {"fn": "roc", "period": self.p["roc_period"]}}
        if self.p["sma_period"]:
            specs["trend_sma"] = {"fn": "sma", "period": self.p["sma_period"]}
        out = with_indicators(bars, specs)
        usable = F.col("roc").isNotNull()
        if self.p["abs_momentum"]:
            usable &= F.col("roc") > 0
        if self.p["sma_period"]:
            usable &= F.coalesce(F.col("close") >= F.col("trend_sma"), F.lit(True))
        w = Window.partitionBy("date", usable).orderBy(F.desc("roc"), "symbol")
        return out.withColumn("rank", F.when(usable, F.row_number().over(w)))

    def entry(self, c: Columns) -> Column:
        return c["rank"] <= self.p["top_n"]

    def exit_(self, c: Columns) -> Column:
        return ~yes(c["rank"] <= self.p["top_n"])


def ranked(df: DataFrame, score_col: str, n: int, largest: bool = True) -> DataFrame:
    """The n rows of each date with the highest scores (or the lowest), ties by symbol, with their rank. Rows without
    a score have no rank."""
    order = F.desc(score_col) if largest else F.asc(score_col)
    w = Window.partitionBy("date").orderBy(order, "symbol")
    return df.where(F.col(score_col).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def regime_filter(benchmark: DataFrame, fast: int = 50, slow: int = 200, condition: str = "fast_above_slow") -> DataFrame:
    """date and regime_on of a benchmark's bars: whether the fast mean is above (or below) the slow one; on where unknown."""
    out = with_indicators(benchmark, {"f": {"fn": "sma", "period": fast}, "s": {"fn": "sma", "period": slow}})
    test = F.col("f") > F.col("s") if condition == "fast_above_slow" else F.col("f") < F.col("s")
    return out.select("date", F.coalesce(test, F.lit(True)).alias("regime_on"))


def get_strategy(name: str, params: dict | None = None) -> Strategy:
    if name not in REGISTRY:
        raise ValueError(f"unknown strategy {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](params or {})
