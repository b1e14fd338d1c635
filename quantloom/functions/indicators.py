"""The 18 indicators over bars (symbol, date, open, high, low, close, volume).

Those of bounded windows are window expressions. Exponential means and the parabolic stop depend on all rows
before; one grouped pass per symbol makes all of them that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def _w() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def rolling(agg: Callable[[Column], Column], x: Column, n: int) -> Column:
    """agg over the last n rows, NULL until n values are there."""
    frame = _w().rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= n, agg(x).over(frame))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3.0


def true_range() -> Column:
    before = F.lag("close").over(_w())
    return F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))


def sma(n: int = 20, column: str = "close") -> Column:
    return rolling(F.avg, C(column).cast("double"), n)


def atr(n: int = 14) -> Column:
    return rolling(F.avg, C("_tr"), n)


def bollinger(n: int = 20, width: float = 2.0) -> dict[str, Column]:
    mid, sd = rolling(F.avg, C("close"), n), rolling(F.stddev_samp, C("close"), n)
    return {"upper": mid + width * sd, "middle": mid, "lower": mid - width * sd}


def donchian(n: int = 20) -> dict[str, Column]:
    high, low = rolling(F.max, C("high"), n), rolling(F.min, C("low"), n)
    return {"upper": high, "middle": (high + low) / 2.0, "lower": low}


def stochastic_k(n: int = 14) -> Column:
    low, high = rolling(F.min, C("low"), n), rolling(F.max, C("high"), n)
    return ratio(100.0 * (C("close") - low), high - low)


def williams_r(n: int = 14) -> Column:
    low, high = rolling(F.min, C("low"), n), rolling(F.max, C("high"), n)
    return ratio(-100.0 * (high - C("close")), high - low)


def cci(n: int = 20) -> Column:
    """Mean deviation about the window's own mean."""
    frame = _w().rowsBetween(-(n - 1), 0)
    own = F.collect_list("_tp").over(frame)
    mean = F.avg("_tp").over(frame)
    mad = F.aggregate(F.zip_with(own, F.array_repeat(mean, n), lambda x, m: F.abs(x - m)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / n
    return F.when(F.count("_tp").over(frame) >= n, ratio(C("_tp") - mean, 0.015 * mad))


def mfi(n: int = 14) -> Column:
    up = rolling(F.sum, F.when(C("_dtp") > 0, C("_tp") * C("volume")).otherwise(0.0), n)
    down = rolling(F.sum, F.when(C("_dtp") < 0, C("_tp") * C("volume")).otherwise(0.0), n)
    return F.when(down == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + ratio(up, down)))


def roc(n: int = 12) -> Column:
    before = F.lag("close", n).over(_w())
    return ratio(C("close") - before, before) * 100.0


def obv() -> Column:
    return F.sum(F.coalesce(F.signum(C("_dc")) * C("volume"), F.lit(0.0))).over(_w().rowsBetween(Window.unboundedPreceding, 0))


def vwap(n: int = 20) -> Column:
    return ratio(rolling(F.sum, C("_tp") * C("volume"), n), rolling(F.sum, C("volume").cast("double"), n))


def ichimoku(conversion: int = 9, base: int = 26, span: int = 52, shift: int = 26) -> dict[str, Column]:
    """Spans and lagging line are shifted forward, so that no value looks ahead."""
    middle = lambda n: (rolling(F.max, C("high"), n) + rolling(F.min, C("low"), n)) / 2.0
    late = lambda n: (C(f"_hh{n}") + C(f"_ll{n}")) / 2.0
    lagged = lambda x: F.lag(x, shift).over(_w())
    return {
        "tenkan": middle(conversion), "kijun": middle(base), "senkou_a": lagged((late(conversion) + late(base)) / 2.0), "senkou_b": lagged(late(span)), "chikou": lagged(C("close")),
    }


# Recurrences, on one symbol's rows in date order.


def _ewm(x: pd.Series, alpha: float, n: int) -> pd.Series:
    return x.ewm(alpha=alpha, min_periods=n, adjust=False).mean()


def _ema(g: pd.DataFrame, n: int = 20, column: str = "close") -> pd.Series:
    return _ewm(g[column], 2.0 / (n + 1), n)


def _rsi(g: pd.DataFrame, n: int = 14) -> pd.Series:
    d = g["close"].diff()
    up, down = _ewm(d.clip(lower=0).fillna(0.0), 1 / n, n), _ewm((-d).clip(lower=0).fillna(0.0), 1 / n, n)
    out = 100 - 100 / (1 + up / down.where(down != 0))
    return out.mask((down == 0) & (up > 0), 100.0)


def _macd(g: pd.DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, pd.Series]:
    line = _ema(g, fast) - _ema(g, slow)
    smooth = _ewm(line, 2.0 / (signal + 1), signal)
    return {"line": line, "signal": smooth, "hist": line - smooth}


def _tr(g: pd.DataFrame) -> pd.Series:
    c = g["close"].shift()
    return pd.concat([g["high"] - g["low"], (g["high"] - c).abs(), (g["low"] - c).abs()], axis=1).max(axis=1)


def _adx(g: pd.DataFrame, n: int = 14) -> pd.Series:
    up, down = g["high"].diff(), -g["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    base = _ewm(_tr(g), 1 / n, n)
    p, m = 100 * _ewm(plus, 1 / n, n) / base, 100 * _ewm(minus, 1 / n, n) / base
    total = p + m
    return _ewm(100 * (p - m).abs() / total.where(total != 0), 1 / n, n)


def _keltner(g: pd.DataFrame, n: int = 20, width: float = 1.5, atr_period: int = 14) -> dict[str, pd.Series]:
    mid, spread = _ema(g, n), _tr(g).rolling(atr_period, min_periods=atr_period).mean()
    return {"upper": mid + width * spread, "middle": mid, "lower": mid - width * spread}


def _psar(g: pd.DataFrame, start: float = 0.02, step: float = 0.02, top: float = 0.20) -> pd.Series:
    """The stop trails the extreme of the running trend; a touch turns the trend over."""
    high, low, close = (g[c].to_numpy() for c in ("high", "low", "close"))
    if len(close) < 2:
        return pd.Series(np.nan, index=g.index)
    side = 1 if close[1] > close[0] else -1
    stop, extreme, pace = (low[0], high[0], start) if side > 0 else (high[0], low[0], start)
    out = [stop]
    for i in range(1, len(close)):
        stop += pace * (extreme - stop)
        recent = slice(max(0, i - 2), i)
        ahead, behind = (high[i], low[i]) if side > 0 else (low[i], high[i])
        stop = min(stop, *low[recent]) if side > 0 else max(stop, *high[recent])
        if side * (behind - stop) < 0:
            side, stop, extreme, pace = -side, extreme, behind, start
        elif side * (ahead - extreme) > 0:
            extreme, pace = ahead, min(pace + step, top)
        out.append(stop)
    return pd.Series(out, index=g.index)


WINDOWED = {
    "sma": sma, "atr": atr, "bollinger": bollinger, "stochastic": None, "obv": obv, "donchian": donchian, "williams_r": williams_r, "cci": cci, "mfi": mfi, "roc": roc, "ichimoku": ichimoku, "vwap": vwap,
}
RECURRENT = {"ema": _ema, "rsi": _rsi, "macd": _macd, "adx": _adx, "keltner": _keltner, "psar": _psar}
OUTPUTS = {"macd": ["line", "signal", "hist"], "keltner": ["upper", "middle", "lower"]}
NAMES = sorted({*WINDOWED, *RECURRENT})
# Other names for parameters, as rule files spell them.
SPELLING = {"period": "n", "num_std": "width", "mult": "width", "multiplier": "width", "fast": "fast", "slow": "slow", "signal": "signal"}


def with_indicators(bars: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """bars with a column for each spec {"name": {"fn": indicator, **parameters}}; indicators of several lines add a
    suffix to the name. All recurrences share one grouped pass, all windows one sort by symbol and date."""
    wanted = {name: (s["fn"], {SPELLING.get(k, k): v for k, v in s.items() if k != "fn"}) for name, s in specs.items()}
    for name, (fn, _) in wanted.items():
        if fn not in NAMES:
            raise ValueError(f"unknown indicator {fn} for {name}")
    out = bars
    slow = {name: x for name, x in wanted.items() if x[0] in RECURRENT}
    if slow:
        new = [f"{name}_{o}" if fn in OUTPUTS else name for name, (fn, _) in slow.items() for o in OUTPUTS.get(fn, [""])]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"`{c}` double" for c in new])
        cols = bars.columns

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("date", kind="stable").reset_index(drop=True)
            made = {}
            for name, (fn, params) in slow.items():
                got = RECURRENT[fn](g, **params)
                made |= {f"{name}_{o}": s for o, s in got.items()} if isinstance(got, dict) else {name: got}
            return pd.concat([g[cols], pd.DataFrame(made)[new]], axis=1)

        out = out.groupBy("symbol").applyInPandas(run, schema)
    fast = {name: x for name, x in wanted.items() if x[0] not in RECURRENT}
    if not fast:
        return out
    fns = {fn for fn, _ in fast.values()}
    helpers: dict[str, Column] = {}
    if fns & {"cci", "mfi", "vwap"}:
        helpers["_tp"] = typical()
    if "atr" in fns:
        helpers["_tr"] = true_range()
    if "obv" in fns:
        helpers["_dc"] = C("close") - F.lag("close").over(_w())
    for _, params in [x for x in fast.values() if x[0] == "ichimoku"]:
        for n in (params.get("conversion", 9), params.get("base", 26), params.get("span", 52)):
            helpers |= {f"_hh{n}": rolling(F.max, C("high"), n), f"_ll{n}": rolling(F.min, C("low"), n)}
    for name, (fn, params) in fast.items():
        if fn == "stochastic":
            helpers[f"{name}_k"] = stochastic_k(params.get("k_period", params.get("n", 14)))
    out = out.withColumns(helpers) if helpers else out
    if "mfi" in fns:
        out = out.withColumn("_dtp", C("_tp") - F.lag("_tp").over(_w()))
    columns: dict[str, Column] = {}
    for name, (fn, params) in fast.items():
        if fn == "stochastic":
            columns[f"{name}_d"] = rolling(F.avg, C(f"{name}_k"), params.get("d_period", 3))
            continue
        got = WINDOWED[fn](**params)
        columns |= {f"{name}_{o}": c for o, c in got.items()} if isinstance(got, dict) else {name: got}
    out = out.withColumns(columns)
    return out.drop(*[c for c in out.columns if c.startswith("_")])
