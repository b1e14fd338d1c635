"""Exits by stops, lots by other orders than first-in-first-out, moves of overlapping trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import execution, lots, metrics, stops
from ..sources import bars
from .base import query, r6, rounded

C = F.col

_ENTRIES = "e AS (SELECT symbol, date AS entry_date, open AS p, CASE WHEN close >= coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) THEN 10 ELSE -10 END AS quantity FROM brand)"
_LEVELS = "CASE WHEN quantity >= 0 THEN p * (1 - 0.35::DOUBLE) ELSE p * (1 + 0.35::DOUBLE) END AS stop, CASE WHEN quantity >= 0 THEN p * (1 + 0.6::DOUBLE) ELSE p * (1 - 0.4::DOUBLE) END AS target"


def daily_entries(spark: SparkSession, sf: str) -> DataFrame:
    """An entry at every bar's open, long if its close is no lower than the one before, else short."""
    before = F.coalesce(F.lag("close").over(bars.by_symbol()), F.lit(0.0))
    return bars.brand_bars(spark, sf).select("symbol", C("date").alias("entry_date"), C("open").alias("entry_price"), F.when(C("close") >= before, 10).otherwise(-10).alias("quantity"))


@query(f"""WITH {_ENTRIES}, l AS (SELECT *, {_LEVELS} FROM e),
x AS (SELECT l.*, b.date, b.low, b.high, greatest(p, max(b.high) OVER (PARTITION BY l.symbol, entry_date ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS top FROM l JOIN brand b ON b.symbol = l.symbol AND b.date >= entry_date),
h AS (SELECT *, CASE WHEN quantity >= 0 AND low <= stop OR quantity < 0 AND high >= stop THEN 'stop_loss' WHEN quantity >= 0 AND low <= (1 - 0.45::DOUBLE) * top THEN 'trailing_stop' WHEN quantity >= 0 AND high >= target OR quantity < 0 AND low <= target THEN 'take_profit' END AS reason FROM x),
f AS (SELECT symbol, entry_date, arg_min(date, date) AS exit_date, arg_min(reason, date) AS reason, arg_min(CASE reason WHEN 'stop_loss' THEN stop WHEN 'take_profit' THEN target ELSE (1 - 0.45::DOUBLE) * top END, date) AS exit_price FROM h WHERE reason IS NOT NULL GROUP BY 1, 2)
SELECT e.symbol, e.entry_date, e.quantity, exit_date, round(exit_price, 6) AS exit_price, reason FROM e LEFT JOIN f USING (symbol, entry_date)""", "brand")
def stops_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    """Entries at every bar, all of them open together: stop at 35 %, trailing stop at 45 %, targets at 60 and 40 %."""
    p, long = C("entry_price"), C("quantity") >= 0
    e = daily_entries(spark, sf).withColumns({"stop": F.when(long, p * (1 - 0.35)).otherwise(p * (1 + 0.35)), "target": F.when(long, p * (1 + 0.6)).otherwise(p * (1 - 0.4))})
    out = stops.first_hit(e, bars.brand_bars(spark, sf), trailing=0.45)
    return out.select("symbol", "entry_date", "quantity", "exit_date", r6("exit_price").alias("exit_price"), "reason")


_OVER = f"{_ENTRIES}, t AS (SELECT e.*, entry_date + 10 + (day(entry_date) * 5)::INTEGER AS exit_date FROM e), g AS (SELECT t.symbol, entry_date, quantity, p, min(low) AS lo, max(high) AS hi FROM t JOIN brand b ON b.symbol = t.symbol AND b.date BETWEEN entry_date AND exit_date GROUP BY ALL), m AS (SELECT symbol, entry_date, quantity, CASE WHEN quantity < 0 THEN 1 - hi / p ELSE lo / p - 1 END AS mae, CASE WHEN quantity < 0 THEN 1 - lo / p ELSE hi / p - 1 END AS mfe FROM g)"


def overlapping_moves(spark: SparkSession, sf: str) -> DataFrame:
    t = daily_entries(spark, sf).withColumns({"exit_date": F.date_add("entry_date", 10 + F.dayofmonth("entry_date") * 5), "pnl_pct": F.lit(None).cast("double")})
    return metrics.excursions(t, bars.brand_bars(spark, sf))


@query(f"WITH {_OVER} SELECT symbol, entry_date, quantity, round(mae, 6) AS mae, round(mfe, 6) AS mfe FROM m", "brand")
def mae_mfe_overlapping(spark: SparkSession, sf: str) -> DataFrame:
    """A trade from every bar, held for 15 to 165 days, half of them short."""
    return rounded(overlapping_moves(spark, sf).select("symbol", "entry_date", "quantity", "mae", "mfe"))


@query(f"WITH {_OVER} SELECT round(avg(mae), 6) AS avg_mae, round(avg(mfe), 6) AS avg_mfe, round(abs(avg(mfe) / avg(mae)), 6) AS efficiency FROM m", "brand")
def mae_mfe_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.excursion_summary(overlapping_moves(spark, sf)))


def _side(spark: SparkSession, sf: str, kind: str, whole: bool) -> DataFrame:
    """Purchases as buys and errors as sells of a user, quantity and price both the event's value."""
    e = bars.read_table(spark, sf, "events").where("value > 0").where(C("event_type") == kind)
    return e.select("user_id", C("event_id").alias("seq"), (F.ceil("value") if whole else C("value")).alias("quantity"), C("value").alias("price"))


_FRACTIONS = "b AS (SELECT user_id, event_id AS seq, value::DECIMAL(28,9) AS q, value AS price, event_type FROM events WHERE event_type IN ('purchase', 'error') AND value > 0), r AS (SELECT *, sum(q) OVER (PARTITION BY user_id, event_type ORDER BY seq)::DECIMAL(28,9) AS e FROM b)"


@query(f"""WITH {_FRACTIONS} SELECT x.user_id, x.seq AS buy_seq, y.seq AS sell_seq, round((least(x.e, y.e) - greatest(x.e - x.q, y.e - y.q))::DOUBLE, 6) AS quantity, round((least(x.e, y.e) - greatest(x.e - x.q, y.e - y.q))::DOUBLE * (y.price - x.price), 4) AS pnl
FROM r x JOIN r y ON x.user_id = y.user_id AND x.event_type = 'purchase' AND y.event_type = 'error' AND x.e - x.q < y.e AND y.e - y.q < x.e""")
def lots_fifo_fractional(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities as they are, not whole ones."""
    met = execution.match_lots(_side(spark, sf, "purchase", False), _side(spark, sf, "error", False), "user_id")
    return met.select("user_id", "buy_seq", "sell_seq", r6(C("quantity").cast("double")).alias("quantity"), F.round(C("pnl").cast("double"), 4).alias("pnl"))


@query("""WITH o AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN ceil(value)::BIGINT ELSE -ceil(value)::BIGINT END AS move, value AS price FROM events WHERE event_type IN ('purchase', 'error') AND value > 0),
w AS (SELECT *, sum(move) OVER (PARTITION BY user_id ORDER BY seq)::BIGINT AS a FROM o),
u AS (SELECT user_id, seq, move, price, unnest(generate_series(least(a, a - move) + 1, greatest(a, a - move))) AS level FROM w),
m AS (SELECT *, lag(seq) OVER c AS buy_seq, lag(price) OVER c AS buy_price FROM u WINDOW c AS (PARTITION BY user_id, level ORDER BY seq))
SELECT user_id, buy_seq, seq AS sell_seq, count(*)::BIGINT AS quantity, round(count(*) * (any_value(price) - any_value(buy_price)), 6) AS pnl FROM m WHERE move < 0 AND buy_seq IS NOT NULL GROUP BY ALL""")
def lots_lifo_match(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(execution.match_lots_lifo(_side(spark, sf, "purchase", True), _side(spark, sf, "error", True), "user_id"))


@query()
def lots_highest_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Of a user's open lots the dearest goes first: a queue in order, which SQL can't express."""
    orders = _side(spark, sf, "purchase", False).withColumn("side", F.lit("BUY")).unionByName(_side(spark, sf, "error", False).withColumn("side", F.lit("SELL")))
    return rounded(lots.match_by_cost(orders, "user_id"))
