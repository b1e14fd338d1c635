"""python -m quantloom.cli: run, list-strategies, optimize, walk-forward, stress-test, clear-cache, compare.

Bars come from folders of {SYMBOL}.csv or {SYMBOL}.parquet files. A TOML or YAML file of the same option names gives
defaults that the command line overrides. --report prints an analysis of a run: see REPORTS.
"""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import session
from .operators import metrics as M
from .operators import research
from .operators import simulator as S
from .plans import strategies
from .sources import bars, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quantloom")
    sub = top.add_subparsers(dest="verb", required=True)
    sub.add_parser("list-strategies")
    for verb in ("run", "optimize", "walk-forward", "stress-test"):
        p = sub.add_parser(verb)
        p.add_argument("--config")
        p.add_argument("--data", help="folder of bar files")
        p.add_argument("--format", choices=["csv", "parquet"])
        p.add_argument("--strategy")
        p.add_argument("--params", help="JSON of strategy parameters")
        p.add_argument("--start")
        p.add_argument("--end")
        p.add_argument("--set", action="append", default=[], metavar="OPTION=VALUE", help="an option of the simulator")
        p.add_argument("--save")
        p.add_argument("--tearsheet")
        p.add_argument("--grid", help="JSON of parameter lists")
        p.add_argument("--is-months", type=int)
        p.add_argument("--oos-months", type=int)
        p.add_argument("--ranges", help="JSON list of [name, start, end]")
        p.add_argument("--metric", help="what combinations are ordered by")
        p.add_argument("--folds", type=int, help="purged folds in place of windows of months")
        p.add_argument("--report", action="append", default=[], choices=sorted(REPORTS))
    c = sub.add_parser("compare")
    c.add_argument("paths", nargs="+")
    k = sub.add_parser("clear-cache")
    k.add_argument("path")
    k.add_argument("--ticker", help="this symbol's partition alone")
    k.add_argument("--yes", action="store_true", help="do not ask")
    return top


def read_config(path: str) -> dict:
    with open(path, "rb") as f:
        if not path.endswith((".yaml", ".yml")):
            return tomllib.load(f)
        try:
            import yaml
        except ImportError:
            raise SystemExit(f"{path}: reading YAML takes the yaml package") from None
        return yaml.safe_load(f) or {}


def merged(args: argparse.Namespace) -> dict:
    """Built-in values, then the file's, then the command line's; unknown names in the file are errors."""
    options = {"format": "csv", "strategy": "sma_crossover", "params": "{}", "start": None, "end": None, "is_months": 24, "oos_months": 6, "grid": "{}", "ranges": "[]", "data": None, "save": None, "tearsheet": None, "set": [], "metric": "sharpe", "folds": None, "report": []}
    if args.config:
        own = read_config(args.config)
        if unknown := set(own) - set(options):
            raise SystemExit(f"unknown options in {args.config}: {', '.join(sorted(unknown))}")
        options |= own
    options |= {k: v for k, v in vars(args).items() if k in options and v not in (None, [])}
    for name in ("params", "grid", "ranges"):
        if isinstance(options[name], str):
            options[name] = json.loads(options[name])
    if isinstance(options["set"], dict):
        options["set"] = [f"{k}={v}" for k, v in options["set"].items()]
    return options


def settings(pairs: list[str]) -> S.Settings:
    names = {f.name for f in fields(S.Settings)}
    own = {}
    for pair in pairs:
        name, _, value = pair.partition("=")
        if name not in names:
            raise SystemExit(f"unknown simulator option {name}")
        try:
            own[name] = json.loads(value.lower() if value in ("True", "False", "None") else value)
        except json.JSONDecodeError:
            own[name] = value
    return S.Settings(**own)


def prices(spark: SparkSession, o: dict) -> DataFrame:
    if not o["data"]:
        raise SystemExit("--data is missing")
    return (bars.read_csv if o["format"] == "csv" else bars.read_parquet)(spark, o["data"], o["start"], o["end"])


def runs_of(b: DataFrame, o: dict) -> list[tuple[str, dict]]:
    names, combos = list(o["grid"]), [{}]
    for name in names:
        combos = [c | {name: v} for c in combos for v in o["grid"][name]]
    return [(json.dumps(c, sort_keys=True), c) for c in combos]


def signals(b: DataFrame, o: dict, params: dict, run_id: str) -> DataFrame:
    out = strategies.get_strategy(o["strategy"], {**o["params"], **params}).signals(b)
    keep = [c for c in ("symbol", "date", *bars.OHLCV, "buy", "sell", "short", "cover", "ATR", "priority") if c in out.columns]
    return out.select(*keep, F.lit(run_id).alias("run_id"))


def stacked(b: DataFrame, o: dict) -> DataFrame:
    parts = [signals(b, o, params, name) for name, params in runs_of(b, o)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _returns(equity: DataFrame) -> DataFrame:
    return M.returns(equity, ["run_id"])


def _numbered(equity: DataFrame) -> DataFrame:
    """(i, r) of one run: a row a day."""
    if equity.select("run_id").distinct().limit(2).count() > 1:
        raise ValueError("one run at a time")
    return _returns(equity).select((F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("i"), "r")


def _excursions(equity: DataFrame, trades: DataFrame, b: DataFrame) -> DataFrame:
    return M.excursion_summary(M.excursions(trades, b)).crossJoin(trades.agg(F.count(F.lit(1)).alias("n_trades")))


def _paths(equity: DataFrame, trades: DataFrame, b: DataFrame) -> DataFrame:
    series = _numbered(equity)
    return research.path_summary(research.bootstrap_paths(series, 1000), max(1, series.count()))


#: Analyses of one run by name, from its equity, its trades and the bars.
REPORTS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "calendar": lambda e, t, b: M.monthly_returns(_returns(e), ["run_id"]).drop("run_id").orderBy("year"),
    "correlation": lambda e, t, b: M.correlation_matrix(M.returns(b, ["symbol"], "close")).orderBy("a", "b"),
    "costs": lambda e, t, b: t.agg(F.count(F.lit(1)).alias("n_trades"), F.sum("fees").alias("fees"), F.sum("pnl").alias("pnl")).crossJoin(M.capacity(t, b)),
    "decay": lambda e, t, b: M.decay_summary(M.signal_decay(t, b, 20)),
    "drawdowns": lambda e, t, b: M.drawdown_periods(e, ["run_id"]).drop("run_id").orderBy("depth").limit(10),
    "excursions": _excursions,
    "monte-carlo": _paths,
    "permutation": lambda e, t, b: research.sign_flip_test(_numbered(e), 1000),
    "regime": lambda e, t, b: M.regime_performance(M.volatility_regime(_returns(e), ["run_id"]).select("run_id", "date", "r", "regime"), ["run_id"]).drop("run_id").orderBy("regime"),
    "risk": lambda e, t, b: M.value_at_risk(_returns(e), ["run_id"]).drop("run_id"),
    "sharpe": lambda e, t, b: M.sharpe_variance(_returns(e), ["run_id"]).drop("run_id"),
}


def clear_cache(spark: SparkSession, path: str, ticker: str | None, sure: bool) -> int:
    """Removes a cache, or one symbol's partition of it, that holds nothing but partitions by symbol, once confirmed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        print(f"nothing at {path}")
        return 1
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    if [n for n in names if not n.startswith(("symbol=", "_", "."))]:
        print(f"{path} is no cache of bars")
        return 1
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, f"symbol={ticker.upper()}") if ticker else folder
    if not sure and input(f"remove {target.toString()}? [y/N] ").strip().lower() not in ("y", "yes"):
        return 1
    return 0 if fs.delete(target, True) else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "list-strategies":
        print("\n".join(sorted(strategies.REGISTRY)))
        return 0
    spark = SparkSession.getActiveSession() or session.build()
    if args.verb == "clear-cache":
        return clear_cache(spark, args.path, args.ticker, args.yes)
    session.ship(spark)
    if args.verb == "compare":
        sinks.compare(spark, args.paths).show(200, False)
        return 0
    o = merged(args)
    own, b = settings(o["set"]), prices(spark, o)
    if args.verb == "run":
        events = session.materialise(S.simulate(signals(b, o, {}, o["strategy"]), own), "run")
        row = M.bundle(S.equity_of(events), S.trades_of(events), ["run_id"]).first()
        print(sinks.console(S.equity_of(events), S.trades_of(events)) if row else "no bars")
        for name in o["report"] if row else ():
            print(f"\n{name}")
            REPORTS[name](S.equity_of(events), S.trades_of(events), b).show(100, False)
        if o["save"]:
            sinks.save(events, o["save"], {k: v for k, v in o.items() if k != "tearsheet"})
        if o["tearsheet"] and row:
            with open(o["tearsheet"], "w", encoding="utf-8") as f:
                f.write(sinks.tearsheet(events, row.run_id))
        return 0
    features = stacked(b, o)
    if args.verb == "stress-test":
        ranges = spark.createDataFrame([tuple(r) for r in o["ranges"]], "name string, a string, b string")
        features = signals(b, o, {}, "x").crossJoin(F.broadcast(ranges)).where("date between cast(a as date) and cast(b as date)").drop("run_id").withColumnRenamed("name", "run_id").drop("a", "b")
    elif args.verb == "walk-forward":
        span = b.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).first()
        if o["folds"]:
            w = research.purged_folds(spark, span.a, span.b, o["folds"]).toDF("window", "oos_start", "oos_end", "is_start", "is_end")
        else:
            w = research.walk_forward_windows(spark, span.a, span.b, o["is_months"], o["oos_months"])
        both = features.crossJoin(F.broadcast(w))
        part = F.when(F.col("date").between(F.col("is_start"), F.col("is_end")), "in").when(F.col("date").between(F.col("oos_start"), F.col("oos_end")), "out")
        features = both.withColumn("part", part).where("part is not null").withColumn("run_id", F.concat_ws(" ", "window", "part", "run_id")).select(*features.columns)
    events = session.materialise(S.simulate(features, own), "runs")
    out = M.bundle(S.equity_of(events), S.trades_of(events), ["run_id"])
    if o["metric"] not in out.columns:
        raise SystemExit(f"unknown metric {o['metric']}; there are {', '.join(out.columns[1:])}")
    shown = dict.fromkeys(["run_id", o["metric"], "total_return", "cagr", "sharpe", "max_drawdown", "n_trades"])
    out.orderBy(F.desc(o["metric"]), "run_id").select(*shown).show(50, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
