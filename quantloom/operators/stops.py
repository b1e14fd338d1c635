"""First-passage exits: for given entries, the first bar that touches a stop, a trailing stop or a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

C = F.col
NARROWER = {"year": "month", "month": "day"}


def _blocks(bars: DataFrame, trailing: float | None) -> DataFrame:
    """symbol, unit, start and, of each day, month and year: the lowest low, the highest high, the highest price that a
    trailing stop follows, and whether a low in it touches the trailing stop of an earlier high in it.

    A day without low or high touches nothing."""
    whole = C("low").isNotNull() & C("high").isNotNull()
    days = bars.select("symbol", C("date").alias("start"), F.when(whole, C("low")).alias("low"), F.when(whole, C("high")).alias("high"), F.coalesce("high", "close").alias("follow"))
    days = days.withColumns({"month": F.trunc("start", "month"), "year": F.trunc("start", "year")}).repartition("symbol", "year")

    def touched(*by: str) -> Column:
        if trailing is None:
            return F.lit(False)
        before = Window.partitionBy("symbol", *by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(C("low") <= (1 - trailing) * F.max("follow").over(before), F.lit(False))

    days = days.withColumns({"in_year": touched("year"), "in_month": touched("year", "month")})
    summary = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("follow").alias("follow")]
    out = days.select("symbol", F.lit("day").alias("unit"), "start", "low", "high", "follow", F.lit(False).alias("within"))
    for unit in ("month", "year"):
        wide = days.groupBy("symbol", "year", *(["month"] if unit == "month" else [])).agg(*summary, F.max(f"in_{unit}").alias("within"))
        out = out.unionByName(wide.select("symbol", F.lit(unit).alias("unit"), C(unit).alias("start"), "low", "high", "follow", "within"))
    return out


def first_hit(entries: DataFrame, bars: DataFrame, trailing: float | None = None) -> DataFrame:
    """Each entry with exit_date, exit_price and reason, null where nothing is ever touched.

    entries: symbol, entry_date, entry_price, quantity (below 0: short), stop, target (null: none); they may overlap,
    and repeated ones are each answered. The entry's own day counts. On one day the stop comes before the trailing stop
    (long entries only) and the target; the exit is at the level touched, and of a stop and a target, as of the two
    children of a bracket, only the one touched first fills. The trailing stop is the share `trailing` below the
    highest price from the entry to the day before.

    The days to the end of the month, the months to the end of the year and the years after it are one equi-join with
    their summaries; the first of them that touches a level is then narrowed down, so that an entry meets some tens of
    rows however long it is held."""
    keys = ["symbol", "entry_date", "entry_price", "quantity", "stop", "target"]
    blocks = materialise(_blocks(bars, trailing), "stop-blocks")
    spans = blocks.where("unit = 'year'").groupBy("symbol").agg(F.max("start").alias("last_year"))
    unique = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long = C("quantity") >= 0
    low_level, high_level = F.when(long, C("stop")).otherwise(C("target")), F.when(long, C("target")).otherwise(C("stop"))
    met = lambda c: F.coalesce(c, F.lit(False))
    trails = lambda low: met(long & (low <= (1 - trailing) * C("top"))) if trailing is not None else F.lit(False)

    def first(asked: DataFrame) -> DataFrame:
        """asked: keys, peak, unit, start of the blocks to look at. Of each entry the first that touches a level."""
        w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        seen = asked.join(blocks, ["symbol", "unit", "start"]).withColumn("top", F.greatest("peak", F.max("follow").over(w)))
        hit = met(C("low") <= low_level) | met(C("high") >= high_level) | trails(C("low")) | (long & C("within"))
        return seen.where(hit).groupBy(*keys).agg(F.min_by(F.struct("unit", "start", "top", "low", "high"), "start").alias("b")).select(*keys, "b.*")

    def narrowed(found: DataFrame, unit: str) -> DataFrame:
        inner = NARROWER[unit]
        end = F.add_months("start", 12 if unit == "year" else 1)
        parts = F.explode(F.sequence("start", F.date_sub(end, 1), F.expr(f"interval 1 {inner}"))).alias("start")
        return first(found.where(C("unit") == unit).select(*keys, C("top").alias("peak"), F.lit(inner).alias("unit"), parts))

    day, month, year = C("entry_date"), F.add_months(F.trunc("entry_date", "month"), 1), F.add_months(F.trunc("entry_date", "year"), 12)
    each = lambda start, stop, unit: F.transform(F.when(start <= stop, F.sequence(start, stop, F.expr(f"interval 1 {unit}"))).otherwise(F.array()), lambda d: F.struct(F.lit(unit).alias("unit"), d.alias("start")))
    ahead = F.concat(each(day, F.last_day("entry_date"), "day"), each(month, F.date_sub(year, 1), "month"), each(year, C("last_year"), "year"))
    asked = unique.drop("_n").join(spans, "symbol").select(*keys, C("entry_price").alias("peak"), F.inline(ahead))
    hits = materialise(first(asked), "stop-hits")
    months = hits.where("unit = 'month'").unionByName(narrowed(hits, "year"))
    days = hits.where("unit = 'day'").unionByName(narrowed(months, "month"))

    stopped = F.when(long, met(C("low") <= C("stop"))).otherwise(met(C("high") >= C("stop")))
    level = (1 - trailing) * C("top") if trailing is not None else F.lit(None).cast("double")
    reason = F.when(stopped, "stop_loss").when(trails(C("low")), "trailing_stop").otherwise("take_profit")
    price = F.when(reason == "stop_loss", C("stop")).when(reason == "trailing_stop", level).otherwise(C("target"))
    exits = days.select(*[C(k).alias(f"_{k}") for k in keys], C("start").alias("exit_date"), price.alias("exit_price"), reason.alias("reason"))
    same = [C(k).eqNullSafe(C(f"_{k}")) if k in ("stop", "target") else C(k) == C(f"_{k}") for k in keys]
    out = unique.join(exits, same, "left").select(*keys, "exit_date", "exit_price", "reason", F.explode(F.array_repeat(F.lit(0), C("_n").cast("int"))).alias("_i"))
    return out.drop("_i")
