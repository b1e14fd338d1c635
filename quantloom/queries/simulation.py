"""Portfolio runs, research fan-outs and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.indicators import with_indicators
from ..operators import metrics as M
from ..operators import research
from ..operators import simulator as S
from ..plans import strategies
from ..session import materialise, shared_dir
from ..sources import bars
from ..streaming import streams
from .base import query, r6, rounded

C = F.col
#: Date ranges of known market stress, and a calm one of the supplied series. Fixed values.
STRESS = [("asia_1997", "1997-07-01", "1997-10-31"), ("russia_1998", "1998-08-01", "1998-10-15"), ("calm_1996", "1996-01-01", "1996-12-31")]


def _crossover(spark: SparkSession, sf: str, fast: int = 10, slow: int = 30) -> DataFrame:
    out = strategies.get_strategy("sma_crossover", {"sma_fast": fast, "sma_slow": slow}).signals(bars.brand_bars(spark, sf))
    return with_indicators(out, {"ATR": {"fn": "atr", "period": 14}}).withColumn("run_id", F.lit("base"))


def _summary(events: DataFrame) -> DataFrame:
    """Per run: days, final equity, trades, profit and fees."""
    events = materialise(events, "events")
    e = S.equity_of(events).groupBy("run_id").agg(F.count(F.lit(1)).alias("days"), F.max_by("equity", "date").alias("final_equity"))
    t = S.trades_of(events).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("pnl").alias("pnl"), F.sum("fees").alias("fees"))
    return rounded(e.join(t, "run_id", "left"))


@query()
def sim_full(spark: SparkSession, sf: str) -> DataFrame:
    """All daily equity values of a run with fees, slippage, stops and position limits."""
    s = S.Settings(max_positions=8, max_alloc=0.12, fee_bps=5, us_fees=True, stop_loss=0.08, trailing=0.15, target=0.25)
    return rounded(S.equity_of(S.simulate(_crossover(spark, sf), s)))


@query()
def sim_trades(spark: SparkSession, sf: str) -> DataFrame:
    s = S.Settings(max_positions=5, fee_per_trade=1.0, lots="highest", fill_model="vwap", slippage="sqrt")
    return rounded(S.trades_of(S.simulate(_crossover(spark, sf), s)))


@query()
def sim_activity(spark: SparkSession, sf: str) -> DataFrame:
    s = S.Settings(max_positions=5, slippage="volume", max_volume_share=0.2, requeue=True, fill_model="random", drip=True)
    return rounded(S.activity_of(S.simulate(_crossover(spark, sf).withColumn("dividends", F.when(F.dayofmonth("date") == 15, C("close") * 0.01)), s)))


@query()
def sim_short(spark: SparkSession, sf: str) -> DataFrame:
    f = _crossover(spark, sf).withColumns({"short": C("sell"), "cover": C("buy")})
    return _summary(S.simulate(f, S.Settings(allow_short=True, borrow_rate=0.03, stop_loss=0.1)))


@query()
def sim_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Sector, gross, net, drawdown and volatility limits, weekly rebalancing, regime filter and ATR sizing."""
    regime = strategies.regime_filter(bars.market_bars(spark, sf), 20, 50)
    sectors = bars.read_table(spark, sf, "part").groupBy(C("p_brand").alias("symbol")).agg(F.min("p_type").alias("sector"))
    f = _crossover(spark, sf).join(regime, "date", "left").join(sectors, "symbol", "left")
    f = f.withColumn("rebalance", F.weekday("date") == 0)
    return _summary(S.simulate(f, S.Settings(sizing="atr", max_sector=0.4, max_gross=0.9, max_net=0.8, max_drawdown=0.3, portfolio_vol=0.2)))


@query()
def sim_limit_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Limit entries two per cent below the close, good for ten days."""
    f = _crossover(spark, sf).withColumns({"limit_price": C("close") * 0.98, "expiry": F.date_add("date", 10)})
    return _summary(S.simulate(f, S.Settings(sizing="volatility")))


def grid_features(spark: SparkSession, prices: DataFrame, grid: DataFrame, fasts: list[int], slows: list[int]) -> DataFrame:
    """Rows of all runs of a grid (combo, fast, slow): each mean is made once, runs pick theirs."""
    means = with_indicators(prices, {f"m{n}": {"fn": "sma", "period": n} for n in sorted({*fasts, *slows})})
    pick = lambda c, ns: F.coalesce(*[F.when(C(c) == n, C(f"m{n}")) for n in ns])
    runs = means.crossJoin(F.broadcast(grid))
    a, b = pick("fast", fasts), pick("slow", slows)
    keep = [c for c in grid.columns if c not in ("fast", "slow")]
    return runs.select("symbol", "date", *bars.OHLCV, *keep, "fast", "slow", F.coalesce(a > b, F.lit(False)).alias("buy"), F.coalesce(a < b, F.lit(False)).alias("sell"))


def _scores(events: DataFrame) -> DataFrame:
    """Sharpe ratio of each run; runs are simulated once, whatever reads their scores."""
    return materialise(M.returns(S.equity_of(events), ["run_id"]).groupBy("run_id").agg(M.sharpe(C("r")).alias("sharpe")), "scores")


@query()
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination as a run of its own, ranked by Sharpe ratio; ties go to the earlier combination."""
    fasts, slows = [5, 10, 20], [50, 100]
    grid = research.parameter_grid(spark, {"fast": fasts, "slow": slows})
    f = grid_features(spark, bars.brand_bars(spark, sf), grid, fasts, slows).withColumn("run_id", C("combo").cast("string"))
    out = _scores(S.simulate(f, equity_only=True)).join(grid.withColumn("run_id", C("combo").cast("string")), "run_id")
    best = F.row_number().over(Window.orderBy(F.desc("sharpe"), "combo"))  # one row a combination
    return out.select("combo", "fast", "slow", r6("sharpe").alias("sharpe"), best.alias("rank"))


@query()
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """In each window, the combination that is best in sample, and how it does out of sample."""
    fasts, slows = [5, 10], [30, 60]
    grid = research.parameter_grid(spark, {"fast": fasts, "slow": slows})
    windows = research.walk_forward_windows(spark, "1995-01-01", "2001-10-31", 24, 12)
    f = grid_features(spark, bars.market_bars(spark, sf), grid, fasts, slows)
    parts = f.crossJoin(F.broadcast(windows))
    inside = parts.where("date between is_start and is_end").withColumn("run_id", F.concat_ws("/", F.lit("is"), "window", "combo"))
    outside = parts.where("date between oos_start and oos_end").withColumn("run_id", F.concat_ws("/", F.lit("oos"), "window", "combo"))
    scores = _scores(S.simulate(inside.unionByName(outside), S.Settings(max_alloc=0.9)))
    key = F.split("run_id", "/")
    s = scores.select(key[0].alias("part"), key[1].cast("int").alias("window"), key[2].cast("long").alias("combo"), "sharpe")
    best = s.where("part = 'is'").groupBy("window").agg(F.max_by(F.struct("combo", "sharpe"), F.struct("sharpe", -C("combo"))).alias("b"))
    out = best.join(s.where("part = 'oos'").select("window", "combo", C("sharpe").alias("oos_sharpe")), ["window"]).where("combo = b.combo")
    return out.select("window", C("b.combo").alias("combo"), r6("b.sharpe").alias("is_sharpe"), r6("oos_sharpe").alias("oos_sharpe"))


@query()
def kfold_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Purged folds: the best combination on the longest training block, scored on the test fold."""
    fasts, slows = [5, 10], [30, 60]
    grid = research.parameter_grid(spark, {"fast": fasts, "slow": slows})
    folds = research.purged_folds(spark, "1995-01-01", "2001-10-31", 4)
    parts = grid_features(spark, bars.market_bars(spark, sf), grid, fasts, slows).crossJoin(F.broadcast(folds))
    train = parts.where("date between train_start and train_end").withColumn("run_id", F.concat_ws("/", F.lit("train"), "fold", "combo"))
    test = parts.where("date between test_start and test_end").withColumn("run_id", F.concat_ws("/", F.lit("test"), "fold", "combo"))
    key = F.split("run_id", "/")
    s = _scores(S.simulate(train.unionByName(test), S.Settings(max_alloc=0.9))).select(key[0].alias("part"), key[1].cast("int").alias("fold"), key[2].cast("long").alias("combo"), "sharpe")
    best = s.where("part = 'train'").groupBy("fold").agg(F.max_by(F.struct("combo", "sharpe"), F.struct("sharpe", -C("combo"))).alias("b"))
    out = best.join(s.where("part = 'test'").select("fold", "combo", C("sharpe").alias("test_sharpe")), "fold").where("combo = b.combo")
    return out.select("fold", C("b.combo").alias("combo"), r6("b.sharpe").alias("train_sharpe"), r6("test_sharpe").alias("test_sharpe"))


@query()
def multi_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Three strategies with shares of the capital; combined equity is carried forward over all their days."""
    shares = {"fast": (0.4, 5, 20), "slow": (0.4, 20, 60)}
    parts = [_crossover(spark, sf, a, b).withColumns({"run_id": F.lit(n), "set_cash": F.lit(100_000.0 * w)}) for n, (w, a, b) in shares.items()]
    e = materialise(S.equity_of(S.simulate(reduce(DataFrame.unionByName, parts))), "equity")
    days = e.select("date").distinct().crossJoin(F.broadcast(e.select("run_id").distinct()))
    w = Window.partitionBy("run_id").orderBy("date")
    held = F.last("equity", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("equity", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    full = days.join(e, ["run_id", "date"], "left").withColumn("equity", F.coalesce(held, first))
    idle = 100_000.0 * (1 - sum(x[0] for x in shares.values()))
    return full.groupBy("date").agg(F.round(F.sum("equity") + idle, 6).alias("equity"))


@query()
def stress(spark: SparkSession, sf: str) -> DataFrame:
    """One run over each stress range."""
    ranges = spark.createDataFrame(STRESS, "run_id string, a string, b string")
    f = _crossover(spark, sf, 5, 20).drop("run_id").crossJoin(F.broadcast(ranges)).where("date between cast(a as date) and cast(b as date)").drop("a", "b")
    return _summary(S.simulate(f))


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close
FROM events GROUP BY ALL HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= {_CLOSED}""")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(streams.drained(streams.tumbling(streams.events(spark, sf)), "tumbling"))


@query(f"""WITH x AS (SELECT *, date_trunc('hour', ts) - to_hours(k) AS start FROM events, (SELECT unnest([0, 1]) AS k))
SELECT start, event_type, count(*) AS n, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close
FROM x GROUP BY start, event_type HAVING start + INTERVAL 2 HOUR <= {_CLOSED}""")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(streams.drained(streams.tumbling(streams.events(spark, sf), "2 hours", "1 hour"), "sliding"))


@query(f"""WITH l AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""")
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(streams.drained(streams.sessions(streams.events(spark, sf)), "sessions"))


@query("SELECT event_id, ts, user_id, event_type, round(value, 6) AS value FROM events")
def stream_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """The events fed twice: each is kept once."""
    twice = streams.events(spark, sf).unionByName(streams.events(spark, sf))
    return rounded(streams.drained(streams.deduplicated(twice), "deduplicated").select("event_id", "ts", "user_id", "event_type", "value"))


@query()
def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger over a stream of feature rows; equal to the batch run, but for the final closing."""
    path = shared_dir(spark, "features")
    _crossover(spark, sf).write.parquet(path)  # availableNow reads all files as one batch
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return rounded(S.equity_of(streams.drained(streams.ledger(stream, S.Settings(max_positions=5)), "ledger")))
