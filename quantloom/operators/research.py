"""Parameter grids, time windows, folds, bootstrap paths and permutation tests as tables of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parameter_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """The product of value lists, numbered as combo in the lists' order, the last one fastest."""
    lists = [spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in vs])).alias(f"_{k}", k)) for k, vs in values.items()]
    grid = reduce(lambda a, b: a.crossJoin(b), lists)
    combo, size = F.lit(0).cast("long"), 1
    for k, vs in reversed(values.items()):
        combo, size = combo + F.col(f"_{k}") * size, size * len(vs)
    return grid.select(*values, combo.alias("combo"))


def walk_forward_windows(spark: SparkSession, start: str, end: str, is_months: int, oos_months: int, anchored: bool = False) -> DataFrame:
    """Windows: in-sample [s, s + months], out-of-sample from the next day; the next window starts oos_months later."""
    n = spark.sql(f"SELECT CAST(months_between(DATE'{end}', DATE'{start}') / {oos_months} AS INT) + 1 AS n").first().n
    w = spark.range(n).select(F.col("id").cast("int").alias("window"), F.add_months(F.lit(start).cast("date"), (F.col("id") * oos_months).cast("int")).alias("s"))
    w = w.withColumn("is_end", F.add_months("s", is_months)).withColumn("oos_start", F.date_add("is_end", 1))
    w = w.withColumn("oos_end", F.least(F.add_months("oos_start", oos_months), F.lit(end).cast("date"))).where(F.col("oos_start") < F.lit(end).cast("date"))
    return w.select("window", (F.lit(start).cast("date") if anchored else F.col("s")).alias("is_start"), "is_end", "oos_start", "oos_end")


def purged_folds(spark: SparkSession, start: str, end: str, n: int, purge: int = 10, embargo: int = 5) -> DataFrame:
    """fold, test range and the longest contiguous training range: purged before the test range, embargoed after."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    size = F.floor(F.datediff(b, a) / n).cast("int")
    folds = spark.range(n).select(F.col("id").cast("int").alias("fold"))
    first = lambda i: F.date_add(a, (i * size).cast("int"))
    last = lambda i: F.when(i == n - 1, b).otherwise(F.date_add(a, ((i + 1) * size - 1).cast("int")))
    t = folds.crossJoin(folds.select(F.col("fold").alias("i"))).where("i <> fold")
    i, test = F.col("i"), F.col("fold")
    t = t.select("fold", "i", F.when(i == test + 1, F.date_add(first(i), embargo)).otherwise(first(i)).alias("s"), F.when(i == test - 1, F.date_sub(last(i), purge)).otherwise(last(i)).alias("e")).where("s < e")
    best = t.groupBy("fold").agg(F.max_by(F.struct("s", "e"), F.struct(F.datediff("e", "s"), -F.col("i"))).alias("x"))
    return best.select("fold", first(test).alias("test_start"), last(test).alias("test_end"), F.col("x.s").alias("train_start"), F.col("x.e").alias("train_end"))


#: A multiplicative congruential generator that every engine computes alike: x -> x * 48271 mod (2^31 - 1).
MODULUS = 2147483647


def uniform_int(seed: Column, n: Column | int) -> Column:
    """An integer of [0, n) from an integer seed: two steps of the generator over scattered seeds."""
    x = (seed % MODULUS + MODULUS) % MODULUS
    x = ((x + 1) * 48271) % MODULUS
    x = (x * 48271) % MODULUS
    return x % n


def bootstrap_paths(returns: DataFrame, sims: int, seed: int = 42) -> DataFrame:
    """sim, step, growth: paths of returns drawn with replacement. returns: (i, r), i from 0, one series.

    sims x steps rows are made in parallel and meet the series by position."""
    spark = returns.sparkSession
    n = returns.count()
    grid = spark.range(sims * n).select((F.col("id") / n).cast("long").alias("sim"), (F.col("id") % n).alias("step"))
    drawn = grid.withColumn("i", uniform_int(F.col("sim") * 1000003 + F.col("step") * 7919 + seed, n))
    joined = drawn.join(returns, "i")
    w = Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("growth", F.exp(F.sum(F.log1p("r")).over(w))).select("sim", "step", "r", "growth")


def path_summary(paths: DataFrame, days: int) -> DataFrame:
    """Growth, Sharpe ratio (population deviation, from the second step on) and drawdown of each path, as percentiles
    over all paths. paths: (sim, step, r, growth)."""
    w = Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    down = paths.withColumn("down", F.col("growth") / F.max("growth").over(w) - 1)
    later = F.when(F.col("step") > 0, F.col("r"))
    one = down.groupBy("sim").agg(F.max_by("growth", "step").alias("final"), F.coalesce(F.avg(later) / F.nullif(F.stddev_pop(later), F.lit(0.0)) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"), F.min("down").alias("max_dd"))
    one = one.withColumn("cagr", F.pow("final", F.lit(252.0 / days)) - 1)
    wanted = {"cagr": (5, 25, 50, 75, 95), "sharpe": (25, 50, 75), "max_dd": (25, 50, 75), "final": (5, 50, 95)}
    name = lambda c, p: f"{'median' if p == 50 else f'p{p}'}_{c}"
    return one.agg(F.count(F.lit(1)).alias("n_simulations"), *[F.expr(f"percentile({c}, {p / 100})").alias(name(c, p)) for c, ps in wanted.items() for p in ps])


def sign_flip_test(returns: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """The observed Sharpe ratio (population deviation) of returns (i, r), and the share of sign-flipped series
    that reach it."""
    sharpe = lambda x: F.coalesce(F.avg(x) / F.nullif(F.stddev_pop(x), F.lit(0.0)) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    observed = returns.agg(sharpe(F.col("r")).alias("observed"))
    flips = returns.sparkSession.range(permutations).withColumnRenamed("id", "p")
    signed = flips.crossJoin(returns).withColumn("r", F.when(uniform_int(F.col("p") * 1000003 + F.col("i") * 7919 + seed, 2) == 0, F.col("r")).otherwise(-F.col("r")))
    null = signed.groupBy("p").agg(sharpe(F.col("r")).alias("s"))
    return null.crossJoin(observed).groupBy("observed").agg(F.avg(F.when(F.col("s") >= F.col("observed"), 1.0).otherwise(0.0)).alias("p_value"), F.count(F.lit(1)).alias("n"))
