"""One query for each indicator, over the daily series of all brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.indicators import with_indicators
from ..sources import bars
from .base import ORACLE_SQL, QUERIES, CTE, r6

# SQL of each indicator over windows; {n} rows back; w is the whole partition in date order.
_TR = "t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, (high + low + close) / 3 AS tp FROM brand WINDOW w AS (PARTITION BY symbol ORDER BY date))"


def _roll(agg: str, x: str, n: int) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {n} THEN {agg}({x}) {over} END"


def _ewm(x: str, alpha: float, n: int) -> str:
    """Exponential mean from the first value on; NULLs stand only before it."""
    over = "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"
    values = f"list({x}) FILTER ({x} IS NOT NULL) {over}"
    return f"CASE WHEN count({x}) {over} >= {n} THEN list_reduce({values}, lambda a, x: a * {1 - alpha!r} + x * {alpha!r}) END"


_RSI = ("r AS (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM brand), "
        "g AS (SELECT symbol, date, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss FROM r), "
        f"e AS (SELECT symbol, date, {_ewm('gain', 1 / 14, 14)} AS ag, {_ewm('loss', 1 / 14, 14)} AS al FROM g)")  # fmt: skip
_MACD = (f"m AS (SELECT symbol, date, {_ewm('close', 2 / 13, 12)} - {_ewm('close', 2 / 27, 26)} AS line FROM brand), "
         f"s AS (SELECT symbol, date, line, {_ewm('line', 2 / 10, 9)} AS signal FROM m)")  # fmt: skip
_ADX = ("u AS (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM t WINDOW w AS (PARTITION BY symbol ORDER BY date)), "
        "v AS (SELECT symbol, date, tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM u), "
        f"z AS (SELECT symbol, date, {_ewm('tr', 1 / 14, 14)} AS a, {_ewm('pdm', 1 / 14, 14)} AS p, {_ewm('mdm', 1 / 14, 14)} AS m FROM v), "
        "q AS (SELECT symbol, date, 100 * p / a AS pd, 100 * m / a AS md FROM z), k AS (SELECT symbol, date, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM q)")  # fmt: skip
_STOCH = f"k AS (SELECT symbol, date, 100 * (close - {_roll('min', 'low', 14)}) / nullif({_roll('max', 'high', 14)} - {_roll('min', 'low', 14)}, 0) AS k FROM brand)"

#: name: (specs, {output: SQL}, more CTEs, table)
_ALL: dict[str, tuple[dict, dict[str, str], list[str], str]] = {
    "sma": ({"x": {"fn": "sma", "period": 20}}, {"x": _roll("avg", "close", 20)}, [], "brand"),
    "ema": ({"x": {"fn": "ema", "period": 26}}, {"x": _ewm("close", 2 / 27, 26)}, [], "brand"),
    "rsi": ({"x": {"fn": "rsi", "period": 14}}, {"x": "CASE WHEN al = 0 AND ag > 0 THEN 100 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END"}, [_RSI], "e"),
    "atr": ({"x": {"fn": "atr", "period": 14}}, {"x": _roll("avg", "tr", 14)}, [_TR], "t"),
    "macd": ({"x": {"fn": "macd"}}, {"x_line": "line", "x_signal": "signal", "x_hist": "line - signal"}, [_MACD], "s"),
    "bollinger": ({"x": {"fn": "bollinger", "period": 20}}, {"x_upper": f"{_roll('avg', 'close', 20)} + 2 * {_roll('stddev_samp', 'close', 20)}", "x_middle": _roll("avg", "close", 20), "x_lower": f"{_roll('avg', 'close', 20)} - 2 * {_roll('stddev_samp', 'close', 20)}"}, [], "brand"),
    "stochastic": ({"x": {"fn": "stochastic"}}, {"x_k": "k", "x_d": _roll("avg", "k", 3)}, [_STOCH], "k"),
    "adx": ({"x": {"fn": "adx", "period": 14}}, {"x": _ewm("dx", 1 / 14, 14)}, [_TR, _ADX], "k"),
    "obv": ({"x": {"fn": "obv"}}, {"x": "sum(coalesce(sign(d) * volume, 0)) OVER (PARTITION BY symbol ORDER BY date)::DOUBLE"}, ["o AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM brand)"], "o"),
    "keltner": ({"x": {"fn": "keltner"}}, {"x_upper": f"{_ewm('close', 2 / 21, 20)} + 1.5 * {_roll('avg', 'tr', 14)}", "x_middle": _ewm("close", 2 / 21, 20), "x_lower": f"{_ewm('close', 2 / 21, 20)} - 1.5 * {_roll('avg', 'tr', 14)}"}, [_TR], "t"),
    "donchian": ({"x": {"fn": "donchian"}}, {"x_upper": _roll("max", "high", 20), "x_middle": f"({_roll('max', 'high', 20)} + {_roll('min', 'low', 20)}) / 2", "x_lower": _roll("min", "low", 20)}, [], "brand"),
    "williams_r": ({"x": {"fn": "williams_r"}}, {"x": f"-100 * ({_roll('max', 'high', 14)} - close) / nullif({_roll('max', 'high', 14)} - {_roll('min', 'low', 14)}, 0)"}, [], "brand"),
    "cci": ({"x": {"fn": "cci"}}, {"x": "CASE WHEN len(l) >= 20 THEN (tp - list_avg(l)) / nullif(0.015 * list_avg(list_transform(l, lambda v: abs(v - list_avg(l)))), 0) END"}, [_TR, "c AS (SELECT *, list(tp) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM t)"], "c"),
    "mfi": ({"x": {"fn": "mfi"}}, {"x": f"CASE WHEN {_roll('sum', 'neg', 14)} = 0 THEN 100 ELSE 100 - 100 / (1 + {_roll('sum', 'pos', 14)} / nullif({_roll('sum', 'neg', 14)}, 0)) END"}, [_TR, "d AS (SELECT *, tp - lag(tp) OVER (PARTITION BY symbol ORDER BY date) AS dtp FROM t)", "f AS (SELECT *, CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END AS pos, CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END AS neg FROM d)"], "f"),
    "roc": ({"x": {"fn": "roc", "period": 12}}, {"x": "(close - lag(close, 12) OVER w) / nullif(lag(close, 12) OVER w, 0) * 100"}, [], "brand WINDOW w AS (PARTITION BY symbol ORDER BY date)"),
    "ichimoku": ({"x": {"fn": "ichimoku"}}, {"x_tenkan": "a9", "x_kijun": "a26", "x_senkou_a": "lag((a9 + a26) / 2, 26) OVER w", "x_senkou_b": "lag(a52, 26) OVER w", "x_chikou": "lag(close, 26) OVER w"}, ["i AS (SELECT symbol, date, close, " + ", ".join(f"({_roll('max', 'high', n)} + {_roll('min', 'low', n)}) / 2 AS a{n}" for n in (9, 26, 52)) + " FROM brand)"], "i WINDOW w AS (PARTITION BY symbol ORDER BY date)"),
    "vwap": ({"x": {"fn": "vwap"}}, {"x": f"{_roll('sum', 'tpv', 20)} / nullif({_roll('sum', 'volume', 20)}, 0)"}, [_TR, "y AS (SELECT *, tp * volume AS tpv FROM t)"], "y"),
    "psar": ({"x": {"fn": "psar"}}, {}, [], ""),
}


def _register(name: str, specs: dict, outputs: dict[str, str], ctes: list[str], source: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = with_indicators(bars.brand_bars(spark, sf), specs)
        new = [c for c in out.columns if c == "x" or c.startswith("x_")]
        return out.select("symbol", "date", *[r6(c).alias(c) for c in new])

    QUERIES[f"ind_{name}"] = run
    if outputs:
        cols = ", ".join(f"round({sql}, 6)::DOUBLE AS {c}" for c, sql in outputs.items())
        ORACLE_SQL[f"ind_{name}"] = f"WITH {', '.join([CTE['brand'], *ctes])} SELECT symbol, date, {cols} FROM {source}"


for _name, _parts in _ALL.items():
    _register(_name, *_parts)

# The stop of a bar follows from the one before: a recursion over each symbol's bars as lists.
ORACLE_SQL["ind_psar"] = f"""WITH RECURSIVE {CTE["brand"]}, p AS (SELECT symbol, list(date ORDER BY date) AS d, list(high ORDER BY date) AS h, list(low ORDER BY date) AS l, list(close ORDER BY date) AS c FROM brand GROUP BY symbol),
s AS (
  SELECT symbol, 1 AS i, CASE WHEN c[2] > c[1] THEN 1 ELSE -1 END AS side, CASE WHEN c[2] > c[1] THEN l[1] ELSE h[1] END AS stop, CASE WHEN c[2] > c[1] THEN h[1] ELSE l[1] END AS best, 0.02::DOUBLE AS pace FROM p WHERE len(c) > 1
  UNION ALL
  SELECT symbol, i, CASE WHEN turn THEN -side ELSE side END, CASE WHEN turn THEN best ELSE moved END, CASE WHEN turn THEN behind WHEN side * (ahead - best) > 0 THEN ahead ELSE best END,
    CASE WHEN turn THEN 0.02::DOUBLE WHEN side * (ahead - best) > 0 THEN least(pace + 0.02::DOUBLE, 0.2::DOUBLE) ELSE pace END
  FROM (SELECT *, side * (behind - moved) < 0 AS turn FROM (
    SELECT s.symbol, i + 1 AS i, side, best, pace, CASE WHEN side > 0 THEN h[i + 1] ELSE l[i + 1] END AS ahead, CASE WHEN side > 0 THEN l[i + 1] ELSE h[i + 1] END AS behind,
      CASE WHEN side > 0 THEN least(stop + pace * (best - stop), l[i], l[greatest(i - 1, 1)]) ELSE greatest(stop + pace * (best - stop), h[i], h[greatest(i - 1, 1)]) END AS moved
    FROM s JOIN p USING (symbol) WHERE i < len(c)))
)
SELECT symbol, d[i] AS date, round(stop, 6)::DOUBLE AS x FROM s JOIN p USING (symbol) UNION ALL SELECT symbol, d[1], 'nan'::DOUBLE FROM p WHERE len(c) = 1"""
