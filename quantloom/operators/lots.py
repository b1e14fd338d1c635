"""Lots sold by cost: a priority queue for each account, in batch and on a stream."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Orders are (by, seq, side, quantity, price); matches are what follows.
MATCH = "account string, buy_seq long, sell_seq long, quantity double, pnl double"
NAMES = ["account", "buy_seq", "sell_seq", "quantity", "pnl"]
#: Quantities below this are none: what is left of differences of doubles.
NONE = 1e-9


class Lots:
    """Open lots, the dearest (or cheapest) first, of one price the earliest."""

    def __init__(self, highest_first: bool):
        self.sign = -1.0 if highest_first else 1.0
        self.heap: list[list] = []  # key, seq, quantity, price

    def buy(self, seq: int, quantity: float, price: float) -> None:
        heapq.heappush(self.heap, [self.sign * price, seq, quantity, price])

    def sell(self, seq: int, quantity: float, price: float) -> Iterator[tuple[int, int, float, float]]:
        """(buy_seq, sell_seq, quantity, pnl); what exceeds the open lots matches nothing."""
        while quantity > NONE and self.heap:
            lot = self.heap[0]
            taken = min(quantity, lot[2])
            yield lot[1], seq, taken, taken * (price - lot[3])
            quantity, lot[2] = quantity - taken, lot[2] - taken
            if lot[2] <= NONE:
                heapq.heappop(self.heap)


def _orders(orders: DataFrame, by: str) -> DataFrame:
    return orders.where("quantity > 0").select(F.col(by).cast("string").alias("account"), F.col("seq").cast("long").alias("seq"), F.col("side").alias("side"), F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"))


def match_by_cost(orders: DataFrame, by: str, highest_first: bool = True) -> DataFrame:
    """Each sell against the dearest (or cheapest) open lots: account, buy_seq, sell_seq, quantity, pnl.

    Orders (by, seq, side, quantity, price) are sorted by account and seq, buys before sells of one seq, and streamed
    through one pass that holds the open lots of one account at a time. A null account is one of its own."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, lots = object(), Lots(highest_first)
        for batch in batches:
            out: list[tuple] = []
            for own, seq, side, quantity, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != account:
                    account, lots = own, Lots(highest_first)
                if side == "BUY":
                    lots.buy(seq, quantity, price)
                else:
                    out += [(own, *m) for m in lots.sell(seq, quantity, price)]
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=NAMES)

    return _orders(orders, by).repartition("account").sortWithinPartitions("account", "seq", "side").mapInArrow(fold, MATCH)


class CostProcessor(StatefulProcessor):
    """The same as state: a map from price to the lots bought at it, in the order of their seq."""

    def __init__(self, highest_first: bool):
        self.highest_first = highest_first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "price double", "seqs array<long>, quantities array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lots, known = Lots(self.highest_first), set()
        for (price,), (seqs, quantities) in self.open.iterator():
            known.add(price)
            for seq, quantity in zip(seqs, quantities, strict=True):
                lots.buy(seq, quantity, price)
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values(["seq", "side"], kind="stable").itertuples():
            if r.side == "BUY":
                lots.buy(r.seq, r.quantity, r.price)
            else:
                out += [(key[0], *m) for m in lots.sell(r.seq, r.quantity, r.price)]
        left: dict[float, list[tuple[int, float]]] = {}
        for _, seq, quantity, price in sorted(lots.heap):
            left.setdefault(price, []).append((seq, quantity))
        for price in known - left.keys():
            self.open.removeKey((price,))
        for price, own in left.items():
            self.open.updateValue((price,), ([s for s, _ in own], [q for _, q in own]))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def stream_by_cost(orders: DataFrame, by: str, highest_first: bool = True) -> DataFrame:
    """match_by_cost of a stream whose orders of an account arrive in the order of seq; state is a row for each price at
    which an account holds lots."""
    return _orders(orders, by).groupBy("account").transformWithStateInPandas(CostProcessor(highest_first), MATCH, "Append", "None")
