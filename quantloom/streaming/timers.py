"""Event-time timers: what becomes silent, and orders that expire."""

from __future__ import annotations

import datetime as dt
import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import WATERMARK

C = F.col

# Spark unpickles a processor also in a worker of the driver that gets neither the files added to the application nor
# the driver's path: it travels by value, so that this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _ms(micros: int) -> int:
    """The first millisecond not before this microsecond."""
    return -(-micros // 1000)


def _micros(span: dt.timedelta) -> int:
    return span // dt.timedelta(microseconds=1)


class Silence(StatefulProcessor):
    """State of a key: the microsecond it was last heard of, with a timer at the end of its patience."""

    def __init__(self, patience: dt.timedelta):
        self.patience = _micros(patience)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, reported boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, reported = self.last.get() or (None, False)
        before, out = last, []
        for at in sorted(x for r in rows for x in r["at"].tolist()):
            if last is not None and at - last > self.patience and not reported:
                out.append((*key, last))
            if last is None or at > last:
                last, reported = at, False
        if last != before:
            for timer in self.handle.listTimers() if before is not None else ():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(_ms(last + self.patience))
            self.last.update((last, reported))
        if out:
            yield pd.DataFrame(out, columns=["key", "last"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.last.get()
        self.last.update((last, True))
        yield pd.DataFrame([(*key, last)], columns=["key", "last"])

    def close(self) -> None:
        pass


def silences(stream: DataFrame, key: str, patience: dt.timedelta = dt.timedelta(days=5)) -> DataFrame:
    """key, last: a row each time a key (a column or expression) is silent for longer than patience of event time, by the
    next row if it comes in the same batch, else by a timer once the watermark is that far. Rows of a key older than one
    seen in an earlier batch change nothing; null keys and times are left out."""
    rows = stream.withWatermark("ts", WATERMARK).select(F.expr(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at")).where("key IS NOT NULL AND ts IS NOT NULL")
    found = rows.groupBy("key").transformWithStateInPandas(Silence(patience), "key string, last long", "Append", "EventTime")
    return found.select("key", F.timestamp_micros("last").alias("last"))


class Pending(StatefulProcessor):
    """State of a symbol: its orders that are neither filled nor expired, with a timer for the end of each.

    An order that a row of its symbol leaves behind by the watermark's delay is told of at once: the watermark passes its
    end after the batch anyway, and neither state nor timer is needed for it."""

    def __init__(self, life: dt.timedelta):
        self.life, self.delay = _micros(life), _micros(pd.Timedelta(WATERMARK).to_pytimedelta())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.orders = handle.getMapState("orders", "id long", "level double, placed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_ = {i: tuple(order) for (i,), order in self.orders.iterator()}
        known, out = dict(open_), []
        # The highest level first: a price meets only orders that it fills or that have ended.
        levels = [(-level, i, placed) for i, (level, placed) in open_.items()]
        heapq.heapify(levels)
        frame = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        for at, i, is_order, price in zip(*(frame[c].tolist() for c in ("at", "id", "is_order", "price")), strict=True):
            if is_order:
                open_[i] = (price, at)
                heapq.heappush(levels, (-price, i, at))
                continue
            while levels and price <= -levels[0][0]:
                level, order, placed = heapq.heappop(levels)
                if at <= placed + self.life and open_.get(order) == (-level, placed):
                    out.append((*key, order, "filled", at, price))
                    del open_[order]
        for i, (_, placed) in list(open_.items()):
            if _ms(placed + self.life) <= (at - self.delay) // 1000:
                out.append((*key, i, "expired", placed + self.life, None))
                del open_[i]
        for i in known.keys() - open_.keys():
            self.orders.removeKey((i,))
        for i, order in open_.items():
            if known.get(i) != order:
                self.orders.updateValue((i,), order)
                self.handle.registerTimer(_ms(order[1] + self.life))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "state", "done_at", "price"]).astype({"price": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (i,), (_, placed) in list(self.orders.iterator()):
            if _ms(placed + self.life) == now:
                out.append((*key, i, "expired", placed + self.life, None))
                self.orders.removeKey((i,))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "state", "done_at", "price"]).astype({"price": "float64"})

    def close(self) -> None:
        pass


def limit_orders(stream: DataFrame, life: dt.timedelta) -> DataFrame:
    """key, id, state, done_at, price of limit buys that are good until cancelled after `life`: filled at the first price of
    their symbol at or below their level, else expired once the watermark has passed their end.

    stream: key, id, ts, is_order, price (an order's is its level). Rows of a symbol come in the order of time from
    batch to batch, in any order within one; null keys, times and prices are left out."""
    rows = stream.withWatermark("ts", WATERMARK).select(C("key").cast("string").alias("key"), C("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("at"), "is_order", C("price").cast("double").alias("price")).where("key IS NOT NULL AND ts IS NOT NULL AND price IS NOT NULL")
    found = rows.groupBy("key").transformWithStateInPandas(Pending(life), "key string, id long, state string, done_at long, price double", "Append", "EventTime")
    return found.withColumn("done_at", F.timestamp_micros("done_at"))
