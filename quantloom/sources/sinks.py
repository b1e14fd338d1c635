"""Result folders, comparison of runs, activity CSV, text reports and an HTML tearsheet with SVG charts."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import simulator as S


def save(events: DataFrame, path: str, config: dict | None = None) -> None:
    """equity, trades and activity as Parquet by run, metrics and configuration as JSON."""
    equity, trades = S.equity_of(events), S.trades_of(events)
    equity.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/equity")
    trades.write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/trades")
    S.activity_of(events).write.mode("overwrite").partitionBy("run_id").parquet(f"{path}/activity")
    M.bundle(equity, trades, ["run_id"]).write.mode("overwrite").json(f"{path}/metrics")
    events.sparkSession.createDataFrame([(json.dumps(config or {}, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("equity", "trades", "activity")} | {"metrics": spark.read.json(f"{path}/metrics")}


def compare(spark: SparkSession, paths: list[str]) -> DataFrame:
    """metric, and a column for each run of the results."""
    rows = spark.read.json([f"{p}/metrics" for p in paths])
    names = [c for c in rows.columns if c != "run_id"]
    long = rows.select(F.col("run_id").cast("string").alias("run_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x"))
    return long.groupBy("x.metric").pivot("run_id").agg(F.first("x.value"))


def write_activity_csv(events: DataFrame, path: str) -> None:
    """Fills with prices to 4 and amounts to 2 decimals."""
    a = S.activity_of(events)
    a.select("run_id", "date", "symbol", "action", "quantity", F.round("price", 4).alias("price"), *[F.round(c, 2).alias(c) for c in ("value", "fees", "slippage")]).write.mode("overwrite").option("header", True).csv(path)


def report(metrics: dict) -> str:
    """Headline metrics as aligned text."""
    width = max(map(len, metrics))
    return "\n".join(f"{k:<{width}}  {v:>16.4f}" if isinstance(v, float) else f"{k:<{width}}  {v!s:>16}" for k, v in metrics.items())


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
#: Marks of a month's return in a heat map: from losses of this size, and gains.
SHADES = [(-0.05, "##"), (-0.02, "=="), (0.0, "--"), (0.02, "+ "), (0.05, "++"), (float("inf"), "**")]


def _cell(x: float | None, form: str = "7.1%") -> str:
    return " " * int(form.split(".")[0]) if x is None or x != x else format(x, form)


def calendar_text(equity: DataFrame, top: int = 5) -> str:
    """One run's months as a table and a heat map, its years and its deepest drawdowns. A row a month, a year and a period
    come to the driver."""
    by = ["run_id"]
    r = M.returns(equity, by)
    months = [x.asDict() for x in M.monthly_returns(r, by).orderBy("year").collect()]
    years = M.yearly_summary(r, by).orderBy("year").collect()
    falls = M.drawdown_periods(equity, by).orderBy("depth", "start").limit(top).collect()
    out = ["Monthly returns", "Year  " + "".join(f"{m:>8}" for m in [*MONTHS, "YTD"])]
    out += [f"{m['year']:<6}" + "".join(" " + _cell(m[str(c)]) for c in [*range(1, 13), "ytd"]) for m in months]
    out += ["", "Heat map  " + "  ".join(f"{mark.strip()} below {limit:.0%}" if limit < float("inf") else f"{mark} above" for limit, mark in SHADES)]
    shade = lambda x: "  " if x is None or x != x else next(mark for limit, mark in SHADES if x < limit)
    out += [f"{m['year']:<6}" + " ".join(shade(m[str(c)]) for c in range(1, 13)) for m in months]
    out += ["", "Years", "Year    Return   Max DD  Sharpe"] + [f"{y.year:<6}" + " " + _cell(y.total) + "  " + _cell(y.max_dd) + _cell(y.sharpe, "8.2f") for y in years]
    out += ["", "Deepest drawdowns", "Start       Trough      Recovery       Depth  Days"]
    return "\n".join(out + [f"{f.start!s:<12}{f.trough!s:<12}{str(f.recovery or 'ongoing'):<12}" + " " + _cell(f.depth) + f"{f.days:>6}" for f in falls])


def console(equity: DataFrame, trades: DataFrame, benchmark: DataFrame | None = None) -> str:
    """One run as text: headline metrics, those against benchmark returns (date, b) if given, what the trades earned, the
    calendar and the last 20 trades."""
    row = M.bundle(equity, trades, ["run_id"], benchmark).first()
    if row is None:
        return "no bars"
    pnl = trades.agg(F.avg("pnl").alias("mean_pnl"), F.max("pnl").alias("best_pnl"), F.min("pnl").alias("worst_pnl"), F.sum("fees").alias("fees")).first().asDict()
    last = trades.orderBy(F.desc("exit_date"), "symbol").limit(20).collect()
    lines = [f"{t.symbol:<10}{t.entry_date!s:<12}{t.exit_date!s:<12}" + _cell(float(t.quantity), "10.0f") + _cell(t.entry_price, "12.4f") + _cell(t.exit_price, "12.4f") + _cell(t.pnl, "14.2f") for t in last]
    parts = [report(row.asDict()), "Trades\n" + report({k: v for k, v in pnl.items() if v is not None} or {"n": 0}), calendar_text(equity), "\n".join(["Last trades", *lines])]
    return "\n\n".join(parts)


def _chart(values: list[float], title: str, width: int = 720, height: int = 200) -> str:
    """A line chart as SVG, of at most one point a pixel."""
    step = max(1, len(values) // width)
    v = values[::step]
    low, high = min(v), max(v)
    span = (high - low) or 1.0
    points = " ".join(f"{i * width / max(1, len(v) - 1):.1f},{height - (x - low) / span * height:.1f}" for i, x in enumerate(v))
    return f'<h2>{html.escape(title)}</h2><svg viewBox="0 0 {width} {height}" width="{width}" height="{height}"><polyline fill="none" stroke="#246" points="{points}"/></svg>'


def tearsheet(events: DataFrame, run_id: str) -> str:
    """One run as a page: metrics, equity and drawdown, monthly returns, last 20 trades. Only this run's rows, a day
    each, come to the driver."""
    own = events.where(F.col("run_id") == run_id)
    equity, trades = S.equity_of(own), S.trades_of(own)
    bundle = M.bundle(equity, trades, ["run_id"]).first().asDict()
    curve = M.drawdowns(equity, ["run_id"]).orderBy("date").select("equity", "drawdown").toPandas()
    months = M.monthly_returns(M.returns(equity, ["run_id"]), ["run_id"]).orderBy("year").drop("run_id").toPandas()
    last = trades.orderBy(F.desc("exit_date"), "symbol").limit(20).drop("run_id").toPandas()
    cards = "".join(f"<tr><td>{html.escape(k)}</td><td>{v:.4f}</td></tr>" for k, v in bundle.items() if isinstance(v, (int, float)))
    table = lambda df: df.to_html(index=False, na_rep="", float_format=lambda x: f"{x:.4f}", border=0)
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(run_id)}</title></head><body><h1>{html.escape(run_id)}</h1><table>{cards}</table>"
        f"{_chart(curve['equity'].tolist(), 'Equity')}{_chart(curve['drawdown'].tolist(), 'Drawdown')}<h2>Monthly returns</h2>{table(months)}<h2>Last trades</h2>{table(last)}</body></html>"
    )
