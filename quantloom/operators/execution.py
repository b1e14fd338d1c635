"""Set-wise execution operators: lot matching, rebalancing, and single-position runs by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Quantities that are not whole are summed in this type, so that running sums of both sides meet exactly.
EXACT = "decimal(28,9)"


def _exact(side: DataFrame) -> DataFrame:
    """Positive quantities, fractional ones as decimals."""
    kind = side.schema["quantity"].dataType.simpleString()
    return side.withColumn("quantity", F.col("quantity").cast(EXACT if kind in ("double", "float") else kind)).where("quantity > 0")


def match_lots(buys: DataFrame, sells: DataFrame, by: str) -> DataFrame:
    """First-in-first-out: each buy and sell covers an interval of the running quantity; overlaps are the matches.

    buys, sells: (by, seq, quantity, price). Result: by, buy_seq, sell_seq, quantity, pnl. The ends of both sides'
    intervals cut the running quantity; the part before a cut belongs to the next buy and the next sell that end at or
    after it, which a window carries back: no join. Fractional quantities count to nine decimals and come back so."""

    def ends(side: DataFrame, name: str, other: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        lot = F.struct(F.col("seq"), F.col("price").cast("double").alias("price"))
        return _exact(side).select(by, F.sum("quantity").over(w).alias("cut"), lot.alias(name), F.lit(None).cast(f"struct<seq:{side.schema['seq'].dataType.simpleString()},price:double>").alias(other))

    cuts = ends(buys, "buy", "sell").unionByName(ends(sells, "sell", "buy")).groupBy(by, "cut").agg(F.max("buy").alias("buy"), F.max("sell").alias("sell"))
    w = Window.partitionBy(by).orderBy("cut")
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    met = cuts.select(by, (F.col("cut") - F.coalesce(F.lag("cut").over(w), F.lit(0))).alias("quantity"), F.first("buy", ignorenulls=True).over(ahead).alias("buy"), F.first("sell", ignorenulls=True).over(ahead).alias("sell"))
    met = met.where("buy is not null and sell is not null")
    return met.select(by, F.col("buy.seq").alias("buy_seq"), F.col("sell.seq").alias("sell_seq"), "quantity", (F.col("quantity") * (F.col("sell.price") - F.col("buy.price"))).alias("pnl"))


def match_lots_lifo(buys: DataFrame, sells: DataFrame, by: str) -> DataFrame:
    """Last-in-first-out, by levels of the running quantity: by, buy_seq, sell_seq, quantity, pnl.

    Each order moves the running quantity across levels, buys up and sells down, so that a level is crossed up and
    down in turn: what a sell takes away at a level was put there by the crossing before it. What a sell takes beyond
    the quantity held matches nothing, as nothing crossed its level up before. The levels are the running quantities
    themselves; an order has a row for each one it crosses. Buys come before sells of the same seq; fractional
    quantities count to nine decimals."""
    side = lambda orders, sign: _exact(orders).select(by, "seq", (F.col("quantity") * sign).alias("move"), F.col("price").cast("double").alias("price"))
    orders = side(buys, 1).unionByName(side(sells, -1))
    w = Window.partitionBy(by).orderBy("seq", F.desc("move"))
    walked = orders.withColumn("after", F.sum("move").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = walked.select(by).distinct().select(by, F.lit(None).cast(orders.schema["seq"].dataType).alias("seq"), F.lit(0).cast(orders.schema["move"].dataType).alias("move"), F.lit(None).cast("double").alias("price"), F.lit(0).cast(walked.schema["after"].dataType).alias("after"))
    ranked = walked.unionByName(start).withColumn("level", F.dense_rank().over(Window.partitionBy(by).orderBy("after")))
    in_turn = Window.partitionBy(by).orderBy(F.asc_nulls_first("seq"), F.desc("move"))
    steps = ranked.withColumn("before", F.lag("level").over(in_turn)).where("move <> 0")
    crossed = F.explode(F.sequence(F.least("before", "level") + 1, F.greatest("before", "level")))
    rows = steps.select(by, "seq", "move", "price", crossed.alias("level"))
    widths = ranked.select(by, "level", "after").distinct()
    widths = widths.select(by, "level", (F.col("after") - F.lag("after").over(Window.partitionBy(by).orderBy("level"))).alias("quantity"))
    here = Window.partitionBy(by, "level").orderBy("seq", F.desc("move"))
    opened = rows.withColumn("buy", F.lag(F.struct("seq", "price")).over(here)).where("move < 0 and buy is not null")
    met = opened.join(widths, [by, "level"]).groupBy(by, F.col("buy.seq").alias("buy_seq"), F.col("seq").alias("sell_seq"), (F.col("price") - F.col("buy.price")).alias("gain"))
    return met.agg(F.sum("quantity").alias("quantity")).select(by, "buy_seq", "sell_seq", "quantity", (F.col("quantity") * F.col("gain")).alias("pnl"))


def rebalance_orders(holdings: DataFrame, targets: DataFrame, prices: DataFrame, by: str = "run_id") -> DataFrame:
    """Orders to target weights: sells before buys. holdings: (by, symbol, quantity, equity); targets: (by, symbol, weight)."""
    keys = [by, "symbol"]
    equity = holdings.groupBy(by).agg(F.max("equity").alias("e"))
    both = holdings.select(*keys, "quantity").join(targets, keys, "full_outer").join(prices, "symbol").join(equity, by)
    now = F.coalesce("quantity", F.lit(0)) * F.col("price") / F.col("e")
    delta = F.coalesce("weight", F.lit(0.0)) - now
    shares = F.floor(F.abs(delta) * F.col("e") / F.col("price")).cast("long")
    out = both.where("price > 0 and e > 0").select(*keys, F.when(delta < 0, "SELL").otherwise("BUY").alias("side"), shares.alias("quantity"))
    return out.where("quantity > 0")


def single_position_trades(signals: DataFrame) -> DataFrame:
    """Trades of one position a symbol at a time, from (symbol, date, open, buy, sell): a signal at the close fills
    at the next bar's open. Changes of the wanted state are the fills; pairs of them are the trades."""
    w = Window.partitionBy("symbol").orderBy("date")
    wanted = F.when(F.col("buy"), 1).when(F.col("sell"), 0)
    state = signals.withColumn("want", F.coalesce(F.last(wanted, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    moved = state.withColumn("prior", F.coalesce(F.lag("want").over(w), F.lit(0)))
    moved = moved.withColumns({"fill_date": F.lead("date").over(w), "fill": F.lead("open").over(w), "end_date": F.last("date").over(w.rowsBetween(0, Window.unboundedFollowing)), "end_close": F.last("close").over(w.rowsBetween(0, Window.unboundedFollowing))})
    fills = moved.where("want <> prior and fill_date is not null")
    closed = fills.withColumns({"exit_date": F.coalesce(F.lead("fill_date").over(w), F.col("end_date")), "exit_price": F.coalesce(F.lead("fill").over(w), F.col("end_close"))})
    return closed.where("want = 1").select("symbol", F.col("fill_date").alias("entry_date"), "exit_date", F.col("fill").alias("entry_price"), "exit_price", (F.col("exit_price") / F.col("fill") - 1).alias("pnl_pct"), F.datediff("exit_date", "fill_date").alias("holding_days"))


def single_position_equity(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """symbol, date, equity from 1.0: held from the entry's open to the exit's open, in cash otherwise."""
    w = Window.partitionBy("symbol").orderBy("date")
    enter = trades.select("symbol", F.col("entry_date").alias("date"), F.col("entry_price").alias("in_price"))
    leave = trades.select("symbol", F.col("exit_date").alias("date"), F.col("exit_price").alias("out_price"))
    days = bars.select("symbol", "date", "close").join(enter, ["symbol", "date"], "left").join(leave, ["symbol", "date"], "left")
    after = F.sum(F.when(F.col("in_price").isNotNull(), 1).otherwise(0) - F.when(F.col("out_price").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumns({"held": after, "prior": F.lag("close").over(w)})
    first = F.when(F.col("in_price").isNotNull() & F.col("out_price").isNull(), F.col("close") / F.col("in_price"))
    last = F.when(F.col("out_price").isNotNull() & F.col("in_price").isNull(), F.col("out_price") / F.col("prior"))
    grow = F.coalesce(first, last, F.when(F.col("held") > 0, F.col("close") / F.col("prior")), F.lit(1.0))
    return days.select("symbol", "date", F.exp(F.sum(F.ln(grow)).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))
