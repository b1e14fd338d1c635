"""Grids over a rule strategy: every combination of thresholds and indicator parameters in one scan of the bars."""

from __future__ import annotations

import copy
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import with_indicators
from ..operators import metrics as M
from . import rules

C = F.col


def substituted(params: dict, values: dict[str, object]) -> dict:
    """A copy of nested parameters with the values at dot paths such as buy_when.0.2 or indicators.fast.period."""
    out = copy.deepcopy(params)
    for path, value in values.items():
        *way, last = path.split(".")
        place = reduce(lambda x, part: x[int(part)] if isinstance(x, list) else x[part], way, out)
        place[int(last) if isinstance(place, list) else last] = value
    return out


def combinations(grid: dict[str, list]) -> list[dict[str, object]]:
    """The product of the lists, the last one fastest; a combination's place is its number."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def _variants(params: dict, grid: dict[str, list]) -> dict[str, list[dict[str, object]]]:
    """For each indicator the combinations of its own paths; one empty one where it has none."""
    own = {name: {p: v for p, v in grid.items() if p.startswith(f"indicators.{name}.")} for name in params["indicators"]}
    return {name: combinations(paths) for name, paths in own.items()}


def signals(bars: DataFrame, params: dict, grid: dict[str, list]) -> DataFrame:
    """symbol, date, open, close, combo, buy, sell: a row for each bar and combination of the grid.

    params: indicators, buy_when, sell_when. Each variant of an indicator is computed once; a literal table of the
    combinations is exploded behind them, whose columns are the thresholds of rules that are compiled once. So the plan
    has one scan and one expression for any number of combinations."""
    variants, combos = _variants(params, grid), combinations(grid)
    thresholds = {p: f"_t{i}" for i, p in enumerate(p for p in grid if not p.startswith("indicators."))}
    if any(not isinstance(v, int | float) or isinstance(v, bool) for p in thresholds for v in grid[p]):
        raise ValueError("thresholds are numbers")
    known = {p for own in variants.values() for v in own for p in v} | set(thresholds)
    if set(grid) - known:
        raise ValueError(f"no such path: {sorted(set(grid) - known)}")
    specs = {f"{name}@{i}": substituted(params, v)["indicators"][name] for name, own in variants.items() for i, v in enumerate(own)}
    out = with_indicators(bars, specs)
    entry = lambda n, c: F.struct(F.lit(n).alias("combo"), *[F.lit(float(c[p])).alias(t) for p, t in thresholds.items()], *[F.lit(own.index({p: c[p] for p in own[0]})).alias(f"_v_{name}") for name, own in variants.items()])
    columns = out.columns
    out = out.select("*", F.inline(F.array(*[entry(n, c) for n, c in enumerate(combos)])))
    lines: dict[str, Column] = {}
    for name, own in variants.items():
        for c in [c for c in columns if c == f"{name}@0" or c.startswith(f"{name}@0_")]:
            suffix = c[len(name) + 2 :]
            lines[name + suffix] = F.coalesce(*[F.when(C(f"_v_{name}") == i, C(f"`{name}@{i}{suffix}`")) for i in range(len(own))])
    out = out.withColumns(lines) if lines else out
    # A threshold in a rule is now the name of its column.
    named = substituted(params, thresholds)
    for side in ("buy_when", "sell_when"):
        rules.validate(params[side])
    buy, sell = (rules.compile_rules(named[side], out.columns) for side in ("buy_when", "sell_when"))
    return out.select("symbol", "date", "open", "close", "combo", buy.alias("buy"), sell.alias("sell"))


def daily_returns(signals: DataFrame) -> DataFrame:
    """combo, symbol, date, r, entered: the daily return of being in after a buy and out after a sell, one position a
    symbol, filled at the next open. What was held overnight moves from close to open, what is held then from open to close."""
    w = Window.partitionBy("combo", "symbol").orderBy("date")
    wanted = F.coalesce(F.last(F.when(C("buy"), 1).when(C("sell"), 0), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    before = lambda c, n: F.coalesce(F.lag(c, n).over(w), F.lit(0))
    out = signals.withColumn("_want", wanted).withColumns({"_held": before("_want", 1), "_night": before("_want", 2), "_last": F.lag("close").over(w)})
    night, day = F.when(C("_night") == 1, C("open") / C("_last")).otherwise(1.0), F.when(C("_held") == 1, C("close") / C("open")).otherwise(1.0)
    return out.select("combo", "symbol", "date", (night * day - 1).alias("r"), (C("_held") > C("_night")).alias("entered"))


def portfolio(returns: DataFrame) -> DataFrame:
    """combo, date, r, entries: all symbols of a day alike."""
    return returns.groupBy("combo", "date").agg(F.avg("r").alias("r"), F.count(F.when(C("entered"), 1)).alias("entries"))


def summary(days: DataFrame) -> DataFrame:
    """combo, n_days, n_entries, total_return, sharpe."""
    return days.groupBy("combo").agg(F.count(F.lit(1)).alias("n_days"), F.sum("entries").alias("n_entries"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total_return"), M.sharpe(C("r")).alias("sharpe"))


def walk_forward(days: DataFrame, windows: list[tuple]) -> DataFrame:
    """Of each window (number, is_start, is_end, oos_start, oos_end) the combination of the best in-sample Sharpe ratio, of
    ones equal to nine decimals the first, with its in-sample and out-of-sample ratios and entries.

    Signals come from the whole series, so that indicators are warm when a window starts. The windows are a literal
    table exploded onto the days: no range join."""
    names = ["window", "is_start", "is_end", "oos_start", "oos_end"]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, w, strict=True)]) for w in windows])
    seen = days.select("*", F.inline(table)).withColumns({"inside": C("date").between(C("is_start"), C("is_end")), "after": C("date").between(C("oos_start"), C("oos_end"))}).where("inside OR after")
    part = lambda flag: F.when(C(flag), C("r"))
    rated = seen.groupBy(*names, "combo").agg(M.sharpe(part("inside")).alias("is_sharpe"), M.sharpe(part("after")).alias("oos_sharpe"), F.sum(F.when(C("after"), C("entries"))).alias("oos_entries"))
    best = rated.groupBy(*names).agg(F.max_by(F.struct("combo", "is_sharpe", "oos_sharpe", "oos_entries"), F.struct(F.round("is_sharpe", 9), -C("combo"))).alias("b"))
    return best.select(*names, "b.*")
