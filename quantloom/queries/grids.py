"""Threshold grids over rules, in one scan, and their walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import research
from ..plans import grids
from ..sources import bars
from .base import query, rounded
from .indicators import _roll

C = F.col

#: Buy what fell below its mean, sell above it: how far it fell, and the mean's length, are swept.
PARAMS = {
    "indicators": {"trend": {"fn": "sma", "period": 5}, "mom": {"fn": "roc", "period": 5}},
    "buy_when": [["close", "<", "trend"], ["mom", "<", -10]], "sell_when": [["close", ">", "trend"]],
}
GRID = {"buy_when.1.2": [-10, -20, -35], "indicators.trend.period": [5, 10, 20]}

_DAYS = f"""i AS (SELECT symbol, date, open, close, [{_roll('avg', 'close', 5)}, {_roll('avg', 'close', 10)}, {_roll('avg', 'close', 20)}] AS trends, (close - lag(close, 5) OVER w) / nullif(lag(close, 5) OVER w, 0) * 100 AS mom FROM brand WINDOW w AS (PARTITION BY symbol ORDER BY date)),
x AS (SELECT symbol, date, open, close, (3 * t + p)::INTEGER AS combo, coalesce(close < trends[p + 1] AND mom < [-10, -20, -35][t + 1], false) AS buy, coalesce(close > trends[p + 1], false) AS sell FROM i, (SELECT unnest([0, 1, 2]) AS t), (SELECT unnest([0, 1, 2]) AS p)),
v AS (SELECT *, coalesce(last_value(CASE WHEN buy THEN 1 WHEN sell THEN 0 END IGNORE NULLS) OVER (PARTITION BY combo, symbol ORDER BY date), 0) AS want FROM x),
h AS (SELECT *, coalesce(lag(want) OVER c, 0) AS held, coalesce(lag(want, 2) OVER c, 0) AS night, lag(close) OVER c AS before FROM v WINDOW c AS (PARTITION BY combo, symbol ORDER BY date)),
d AS (SELECT combo, date, avg(CASE night WHEN 1 THEN open / before ELSE 1 END * CASE held WHEN 1 THEN close / open ELSE 1 END - 1) AS r, count(*) FILTER (held > night) AS entries FROM h GROUP BY combo, date)"""
_SHARPE = "coalesce(avg({0}) / nullif(stddev_samp({0}), 0) * sqrt(252), 0)"


def combination_days(spark: SparkSession, sf: str) -> DataFrame:
    return grids.portfolio(grids.daily_returns(grids.signals(bars.brand_bars(spark, sf), PARAMS, GRID)))


@query(f"WITH {_DAYS} SELECT combo, [-10, -20, -35][combo // 3 + 1]::DOUBLE AS threshold, [5, 10, 20][combo % 3 + 1]::INTEGER AS period, count(*) AS n_days, sum(entries)::BIGINT AS n_entries, round(exp(sum(ln(1 + r))) - 1, 6) AS total_return, round({_SHARPE.format('r')}, 6) AS sharpe FROM d GROUP BY combo", "brand")
def rule_grid_vectorised(spark: SparkSession, sf: str) -> DataFrame:
    out = grids.summary(combination_days(spark, sf))
    named = spark.createDataFrame([(i, float(c["buy_when.1.2"]), c["indicators.trend.period"]) for i, c in enumerate(grids.combinations(GRID))], "combo int, threshold double, period int")
    return rounded(out.join(F.broadcast(named), "combo").select("combo", "threshold", "period", "n_days", "n_entries", "total_return", "sharpe"))


@query(f"""WITH {_DAYS}, span AS (SELECT min(date) AS a, max(date) AS b FROM brand),
s AS (SELECT k::INTEGER AS "window", (a + to_months((6 * k)::INTEGER))::DATE AS is_start, b FROM span, (SELECT unnest(generate_series(0, 40)) AS k)), e AS (SELECT *, (is_start + INTERVAL 24 MONTH)::DATE AS is_end FROM s),
o AS (SELECT "window", is_start, is_end, is_end + 1 AS oos_start, least((is_end + 1 + INTERVAL 6 MONTH)::DATE, b) AS oos_end, b FROM e),
m AS (SELECT "window", is_start, is_end, oos_start, oos_end, combo, {_SHARPE.format('CASE WHEN date BETWEEN is_start AND is_end THEN r END')} AS is_sharpe, {_SHARPE.format('CASE WHEN date BETWEEN oos_start AND oos_end THEN r END')} AS oos_sharpe,
  sum(CASE WHEN date BETWEEN oos_start AND oos_end THEN entries END)::BIGINT AS oos_entries FROM d JOIN o ON date BETWEEN is_start AND oos_end WHERE oos_start < b GROUP BY ALL)
SELECT "window", is_start, is_end, oos_start, oos_end, combo, round(is_sharpe, 6) AS is_sharpe, round(oos_sharpe, 6) AS oos_sharpe, oos_entries FROM m QUALIFY row_number() OVER (PARTITION BY "window" ORDER BY round(is_sharpe, 9) DESC, combo) = 1""", "brand")
def rule_grid_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Two years in sample, half a year out of it, over the span of the bars."""
    windows = [tuple(w) for w in research.walk_forward_windows(spark, *bars.span(bars.brand_bars(spark, sf)), 24, 6).collect()]
    return rounded(grids.walk_forward(combination_days(spark, sf), windows))
