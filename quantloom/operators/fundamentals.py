"""Point-in-time fundamentals, holdings, insider and event windows, and macro series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join, interval_sums

C = F.col
YEAR_ROWS = 252
#: Titles that make an insider an officer (in lower case).
OFFICERS = ("ceo", "cfo", "coo", "chief executive", "chief financial", "chief operating")
# Weights of the Z score, and the bounds of its zones.
Z_WEIGHTS, Z_SAFE, Z_DISTRESS = (1.2, 1.4, 3.3, 0.6, 1.0), 2.99, 1.8


class Get:
    """Columns by name; NULL doubles for those that are not there."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __getitem__(self, name: str) -> Column:
        return C(name) if name in self.df.columns else F.lit(None).cast("double")


def by_symbol(on: str = "date") -> Window:
    return Window.partitionBy("symbol").orderBy(on)


def over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def pivot_state(filings: DataFrame, metrics: list[str]) -> DataFrame:
    """(symbol, metric, period_end, filed_date, value) to a row for each filing date that carries the latest value
    filed of every metric, as fund_<metric>."""
    wide = filings.groupBy("symbol", "filed_date").pivot("metric", metrics).agg(F.max_by("value", "period_end"))
    w = by_symbol("filed_date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("symbol", "filed_date", *[F.last(F.col(f"`{m}`"), ignorenulls=True).over(w).alias(f"fund_{m}") for m in metrics])


def trailing_sums(filings: DataFrame, n: int = 4) -> DataFrame:
    """symbol, metric, filed_date, ttm: the sum of the last n periods that ended by the filing date.

    Rolling sums by period end, then an as-of join: linear in filings, no range join."""
    w = Window.partitionBy("symbol", "metric").orderBy("period_end").rowsBetween(-(n - 1), 0)
    rolled = filings.select("symbol", "metric", C("period_end").alias("at"), F.sum("value").over(w).alias("ttm"))
    dates = filings.select("symbol", "filed_date").distinct().join(filings.select("symbol", "metric").distinct(), "symbol").select("symbol", "metric", C("filed_date").alias("at"))
    return asof_join(dates, rolled, on="at", by=["symbol", "metric"]).withColumnRenamed("at", "filed_date")


def price_ratios(df: DataFrame) -> DataFrame:
    g = Get(df)
    shares, cap = g["fund_shares_outstanding"], C("close") * g["fund_shares_outstanding"]
    return df.withColumns({
        "fund_pe_ratio": over(C("close"), over(g["fund_net_income_ttm"], shares)), "fund_pb_ratio": over(cap, g["fund_total_equity"]),
        "fund_ps_ratio": over(cap, g["fund_revenue_ttm"]), "fund_fcf_yield": over(g["fund_free_cash_flow_ttm"], cap),
    })


def statement_ratios(df: DataFrame, year: int = YEAR_ROWS) -> DataFrame:
    g = Get(df)
    before = lambda c: F.lag(c, year).over(by_symbol())
    growth = lambda c: over(c - before(c), F.abs(before(c)))
    return df.withColumns({
        "fund_current_ratio": over(g["fund_current_assets"], g["fund_current_liabilities"]), "fund_debt_to_equity": over(g["fund_total_debt"], g["fund_total_equity"]),
        "fund_revenue_growth_yoy": growth(g["fund_revenue"]), "fund_earnings_growth_yoy": growth(g["fund_net_income"]), "fund_gross_margin": over(g["fund_gross_profit"], g["fund_revenue"]),
        "fund_operating_margin": over(g["fund_operating_income"], g["fund_revenue"]), "fund_net_margin": over(g["fund_net_income"], g["fund_revenue"]),
        "fund_roa": over(g["fund_net_income"], g["fund_total_assets"]), "fund_roe": over(g["fund_net_income"], g["fund_total_equity"]),
    })


def piotroski(df: DataFrame, year: int = YEAR_ROWS) -> DataFrame:
    """Nine tests; those without data do not count, NULL if none has any."""
    g = Get(df)
    assets = g["fund_total_assets"]
    made = df.withColumns({
        "_roa": over(g["fund_net_income_ttm"], assets), "_cfo": over(g["fund_operating_cf_ttm"], assets), "_lev": over(g["fund_total_debt"], assets),
        "_cur": over(g["fund_current_assets"], g["fund_current_liabilities"]), "_gm": over(g["fund_gross_profit"], g["fund_revenue"]), "_at": over(g["fund_revenue"], assets),
        "_ocf": g["fund_operating_cf_ttm"], "_sh": g["fund_shares_outstanding"],
    })
    before = lambda c: F.lag(c, year).over(by_symbol())
    tests = [
        C("_roa") > 0, C("_ocf") > 0, C("_roa") > before("_roa"), C("_cfo") > C("_roa"), C("_lev") < before("_lev"), C("_cur") > before("_cur"), C("_sh") <= before("_sh"), C("_gm") > before("_gm"),
        C("_at") > before("_at"),
    ]
    total = reduce(lambda a, b: a + b, [F.coalesce(t.cast("double"), F.lit(0.0)) for t in tests])
    out = made.withColumn("fund_piotroski_f", F.when(F.coalesce(*tests).isNotNull(), total))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def altman(df: DataFrame) -> DataFrame:
    """Z score of the terms that are known, and its zone."""
    g = Get(df)
    assets = g["fund_total_assets"]
    terms = [
        over(g["fund_current_assets"] - g["fund_current_liabilities"], assets), over(g["fund_retained_earnings"], assets), over(g["fund_operating_income"], assets),
        over(C("close") * g["fund_shares_outstanding"], g["fund_total_liabilities"]), over(g["fund_revenue"], assets),
    ]
    total = reduce(lambda a, b: a + b, [F.coalesce(w * t, F.lit(0.0)) for w, t in zip(Z_WEIGHTS, terms, strict=True)])
    out = df.withColumn("fund_altman_z", F.when(F.coalesce(*terms).isNotNull(), total))
    z = C("fund_altman_z")
    return out.withColumn("fund_altman_zone", F.when(z > Z_SAFE, "safe").when(z >= Z_DISTRESS, "grey").when(z < Z_DISTRESS, "distress"))


def payouts(df: DataFrame, year: int = YEAR_ROWS) -> DataFrame:
    """Buyback and shareholder yield, dividend growth and payout ratio."""
    g = Get(df)
    zero = lambda n: F.coalesce(g[n], F.lit(0.0))
    cap, net = C("close") * g["fund_shares_outstanding"], zero("fund_stock_repurchased_ttm") - zero("fund_stock_issued_proceeds_ttm")
    before = F.lag(g["fund_dividends_per_share"], year).over(by_symbol())
    return df.withColumns({
        "fund_buyback_yield": over(net, cap), "fund_shareholder_yield": over(net + zero("fund_dividends_paid_ttm") - zero("fund_stock_comp_ttm"), cap),
        "fund_div_growth_yoy": over(g["fund_dividends_per_share"] - before, F.abs(before)), "fund_payout_ratio": over(g["fund_dividends_paid_ttm"], g["fund_net_income_ttm"]),
    })


def enrich(bars: DataFrame, state: DataFrame) -> DataFrame:
    """Bars with the latest filed state by the bar's date, and everything derived from it."""
    joined = asof_join(bars, state.withColumnRenamed("filed_date", "date"), on="date", by=["symbol"])
    return payouts(altman(piotroski(statement_ratios(price_ratios(joined)))))


def insider_windows(days: DataFrame, trades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Windows of 30 and 90 calendar days over (filed_date, shares, price, insider_title)."""
    title = F.lower("insider_title")
    officer = reduce(lambda a, b: a | b, [title.contains(o) for o in OFFICERS])
    daily = trades.groupBy(*(by or []), "filed_date").agg(
        F.sum("shares").alias("net"), F.sum(C("shares") * C("price")).alias("value"), F.count(F.when(C("shares") > 0, 1)).alias("b"), F.count(F.when(C("shares") < 0, 1)).alias("s"),
        F.count(F.when((C("shares") > 0) & officer, 1)).alias("o"),
    )
    wanted = {
        "insider_net_shares_30d": ("net", 30), "insider_buy_count_90d": ("b", 90), "insider_sell_count_90d": ("s", 90), "insider_net_value_30d": ("value", 30), "insider_officer_buys_90d": ("o", 90),
    }
    out = interval_sums(days, daily, wanted, "date", "filed_date", by)
    return out.withColumn("insider_buy_ratio_90d", over(C("insider_buy_count_90d"), C("insider_buy_count_90d") + C("insider_sell_count_90d")))


def resolve_tags(facts: DataFrame, tags: list[str], by: list[str], prefix: str = "us-gaap:") -> DataFrame:
    """For each key the facts (concept, value) of the first tag, in the order given, that has a value; a concept may
    carry the prefix. Facts without period_end or value do not count."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tags]), F.regexp_replace("concept", f"^{prefix}", ""))
    known = facts.withColumn("_rank", rank).where("_rank > 0 and period_end is not null and value is not null")
    return known.withColumn("_first", F.min("_rank").over(Window.partitionBy(*by))).where("_rank = _first").drop("_rank", "_first")


def holdings_by_period(rows: DataFrame, by: list[str]) -> DataFrame:
    """Managers' holdings (report_date, filed_date, manager_cik, shares_held, value_held) summed for each report date."""
    return rows.groupBy(*by, "report_date").agg(
        F.max("filed_date").alias("filed_date"), F.countDistinct("manager_cik").alias("total_holders"), F.sum("shares_held").alias("total_shares"), F.sum("value_held").alias("total_value")
    )


def holdings_changes(holdings: DataFrame) -> DataFrame:
    w = by_symbol("filed_date")
    before = F.lag("total_shares").over(w)
    return holdings.withColumns({"inst_holders_change_qoq": C("total_holders") - F.lag("total_holders").over(w), "inst_shares_change_pct": over(C("total_shares") - before, before)})


def event_windows(days: DataFrame, events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flags of recent events (filed_date and boolean has_ columns), 1.0 or 0.0, and a count."""
    flags = {"event_earnings_recent": ("has_earnings", 7), "event_acquisition_recent": ("has_acquisition", 14), "event_officer_change_recent": ("has_officer_change", 28), "event_restatement_ever": ("has_restatement", 365)}
    daily = events.groupBy(*(by or []), "filed_date").agg(*[F.count(F.when(C(c), 1)).alias(c) for c, _ in flags.values()], F.count(F.lit(1)).alias("n"))
    out = interval_sums(days, daily, {**flags, "event_count_90d": ("n", 90)}, "date", "filed_date", by)
    return out.withColumns({f: F.when(C(f) > 0, 1.0).otherwise(0.0) for f in flags})


def macro_regime(macro: DataFrame) -> DataFrame:
    """Share of four conditions that hold, on one macro calendar (a row a day): spread above 0, credit spread below
    its median of 252 rows (21 at least), leading index up and claims down over 21 rows; unknown counts as not."""
    w = Window.orderBy("date")
    frame = w.rowsBetween(-251, 0)
    median = F.when(F.count("fred_credit_spread_hy").over(frame) >= 21, F.expr("percentile(fred_credit_spread_hy, 0.5)").over(frame))
    tests = []
    for column, test in (
        ("fred_yield_spread_10y2y", C("fred_yield_spread_10y2y") > 0), ("fred_credit_spread_hy", C("fred_credit_spread_hy") < median), ("fred_lei", C("fred_lei") > F.lag("fred_lei", 21).over(w)),
        ("fred_claims", C("fred_claims") < F.lag("fred_claims", 21).over(w)),
    ):
        if column in macro.columns:
            tests.append(F.coalesce(test.cast("double"), F.lit(0.0)))
    return macro.withColumn("fred_macro_regime", reduce(lambda a, b: a + b, tests) / len(tests) if tests else F.lit(None).cast("double"))


def yield_curve(df: DataFrame) -> DataFrame:
    g = Get(df)
    return df.withColumns({"yield_spread_10y2y": g["yield_10y"] - g["yield_2y"], "yield_real_10y": g["yield_10y"] - g["yield_breakeven_10y"]})


def intermarket(df: DataFrame, lag: int = 63) -> DataFrame:
    ratio = df.withColumn("intermarket_cu_au_ratio", over(C("copper"), C("gold")))
    before = F.lag("intermarket_cu_au_ratio", lag).over(Window.orderBy("date"))
    return ratio.withColumn("intermarket_cu_au_momentum", over(C("intermarket_cu_au_ratio"), before) - 1)


def put_call(df: DataFrame, n: int = 10) -> DataFrame:
    """The ratio as given, puts over calls where no column gives it, and its mean of n rows."""
    g = Get(df)
    out = df.withColumn("sentiment_pcr", g["pcr"] if "pcr" in df.columns else over(g["puts"], g["calls"]))
    frame = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    return out.withColumn(f"sentiment_pcr_ma{n}", F.when(F.count("sentiment_pcr").over(frame) >= n, F.avg("sentiment_pcr").over(frame)))


def analyst_revisions(bars: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A snapshot (symbol, up, down) on each symbol's last bar alone."""
    last = F.max("date").over(Window.partitionBy("symbol"))
    out = bars.withColumn("_last", last).join(snapshot, "symbol", "left")
    on = C("date") == C("_last")
    breadth = over((C("up") - C("down")).cast("double"), (C("up") + C("down")).cast("double"))
    return out.select(*bars.columns, *[F.when(on, x).alias(n) for n, x in (("analyst_rev_up_7d", C("up")), ("analyst_rev_down_7d", C("down")), ("analyst_rev_breadth", breadth))])
