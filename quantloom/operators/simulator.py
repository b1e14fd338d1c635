"""The path-dependent portfolio simulation: a stateful fold over the days of a run.

Everything a day's decision reads (indicators, rules, regime, ranks) is made by DataFrame operators and comes in as
columns; what is left here is the ledger: orders, fills, stops, lots and limits, whose cash couples all symbols of a
run. Runs are independent: run_id is the partition key, in batch and in streams.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sessions without a bar after which a held symbol is closed, and days that a requeued remainder lives.
ABSENT_SESSIONS, REQUEUE_DAYS = 5, 7


@dataclass(frozen=True)
class Settings:
    """Options of a run; per-run overrides come from columns of the runs table by the same names."""

    cash: float = 100_000.0
    max_positions: int = 10
    max_alloc: float = 0.10
    fee_per_trade: float = 0.0
    fee_bps: float = 0.0
    us_fees: bool = False
    slippage: str = "fixed"  # fixed, volume, sqrt
    slippage_bps: float = 10.0
    slippage_impact: float = 0.1
    fill_model: str = "open"  # open, close, vwap, random
    max_volume_share: float = 0.0
    requeue: bool = False
    sizing: str = "fixed"  # fixed, atr, kelly, volatility
    risk: float = 0.01
    atr_multiple: float = 2.0
    target_vol: float = 0.10
    kelly_fraction: float = 0.5
    allow_short: bool = False
    borrow_rate: float = 0.0
    stop_loss: float | None = None
    stop_atr: float | None = None
    trailing: float | None = None
    target: float | None = None
    max_drawdown: float | None = None
    max_sector: float | None = None
    max_gross: float | None = None
    max_net: float | None = None
    portfolio_vol: float | None = None
    vol_lookback: int = 60
    lots: str = "fifo"  # fifo, lifo, highest, lowest
    drip: bool = False


@dataclass
class Lot:
    quantity: int  # negative for shorts
    price: float
    day: date
    fee: float


@dataclass
class Order:
    symbol: str
    action: str  # BUY, SELL, SHORT, COVER
    quantity: int  # -1: all
    kind: str = "MARKET"
    limit: float | None = None
    stop: float | None = None
    expiry: date | None = None  # set: good till then, else for one day
    number: int = 0


@dataclass
class Ledger:
    """All state of one run between days; plain values, so that it can be stored as state of a stream."""

    cash: float
    lots: dict[str, list[Lot]] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=dict)
    stops: dict[str, dict[str, float]] = field(default_factory=dict)
    absent: dict[str, int] = field(default_factory=dict)
    queue: list[Order] = field(default_factory=list)
    equity: list[float] = field(default_factory=list)
    peak: float = 0.0
    halted: bool = False
    numbered: int = 0

    def held(self, symbol: str) -> int:
        return sum(x.quantity for x in self.lots.get(symbol, ()))

    def value(self, symbol: str) -> float:
        lots = self.lots[symbol]
        return self.held(symbol) * self.marks.get(symbol, sum(x.quantity * x.price for x in lots) / self.held(symbol))

    def total(self) -> float:
        return self.cash + sum(self.value(s) for s in self.lots)


def _number(x: object) -> float | None:
    return None if x is None or isinstance(x, float) and not math.isfinite(x) or x is pd.NA else float(x)


def fee(s: Settings, sells: bool, price: float, quantity: int) -> float:
    out = s.fee_per_trade + price * quantity * s.fee_bps / 10_000
    return out + price * quantity * 8e-6 + min(quantity * 0.000119, 5.95) if s.us_fees and sells else out


def slipped(s: Settings, buys: bool, price: float, quantity: int, volume: float) -> float:
    if s.slippage == "fixed":
        move = price * s.slippage_bps / 10_000
    elif volume <= 0:
        move = 0.0
    else:
        move = price * s.slippage_impact * quantity / volume if s.slippage == "volume" else s.slippage_impact * 0.02 * math.sqrt(quantity / volume) * price
    return price + move if buys else price - move


def base_price(s: Settings, o: Order, bar: dict, run: str) -> float | None:
    """The price at which an order fills on a bar, before slippage; None if it does not."""
    buys = o.action in ("BUY", "COVER")
    low, high = bar["low"], bar["high"]
    if o.kind == "MARKET":
        if s.fill_model == "random":  # the same for the same run and order, wherever it is computed
            return low + (high - low) * zlib.crc32(f"{run}/{o.number}".encode()) / (1 << 32)
        return {"open": bar["open"], "close": bar["close"], "vwap": (high + low + bar["close"]) / 3}[s.fill_model]
    reached = o.limit is not None and (low <= o.limit if buys else high >= o.limit)
    hit = o.stop is not None and (high >= o.stop if buys else low <= o.stop)
    if o.kind == "LIMIT":
        return o.limit if reached else None
    if o.kind == "STOP":
        return o.stop if hit else None
    return o.limit if hit and reached else None


def size(s: Settings, equity: float, cash: float, bar: dict) -> int:
    price, atr = bar["close"], _number(bar.get("ATR"))
    if not price or price <= 0:
        return 0
    plain = int(min(equity * s.max_alloc, cash) // price)
    if s.sizing == "atr" and atr and atr > 0:
        plain = min(int(equity * s.risk / (atr * s.atr_multiple)), plain)
    elif s.sizing == "volatility" and atr and atr > 0:
        plain = int(min(equity * min(s.target_vol / (atr / price * math.sqrt(252)), s.max_alloc), cash) // price)
    elif s.sizing == "kelly":
        win, payoff = _number(bar.get("kelly_win_rate")), _number(bar.get("kelly_payoff_ratio"))
        if win is not None and payoff:
            best = (win * payoff - (1 - win)) / payoff
            plain = int(min(equity * min(best * s.kelly_fraction, s.max_alloc), cash) // price) if best > 0 else 0
    return max(0, plain)


def close_lots(s: Settings, book: Ledger, symbol: str, quantity: int, price: float, day: date, cost: float) -> list[dict]:
    """Closes that many shares; entry fees go with the share of their lot, the exit fee by shares. Shorts close
    first-in-first-out."""
    lots, short = book.lots[symbol], book.held(symbol) < 0
    order = {"fifo": lots, "lifo": lots[::-1], "highest": sorted(lots, key=lambda x: -x.price), "lowest": sorted(lots, key=lambda x: x.price)}["fifo" if short else s.lots]
    if quantity > abs(book.held(symbol)):
        raise ValueError(f"cannot close {quantity} of {symbol}")
    left, out = quantity, []
    for lot in list(order):
        if not left:
            break
        n = min(left, abs(lot.quantity))
        entry_fee, exit_fee = lot.fee * n / abs(lot.quantity), cost * n / quantity
        gain = (lot.price - price if short else price - lot.price) * n - entry_fee - exit_fee
        out.append({"kind": "trade", "date": day, "symbol": symbol, "quantity": n, "price": price, "entry_date": lot.day, "entry_price": lot.price, "pnl": gain, "pnl_pct": lot.price / price - 1 if short else price / lot.price - 1, "fees": entry_fee + exit_fee, "action": "COVER" if short else "SELL"})
        lot.fee -= entry_fee
        lot.quantity += n if short else -n
        left -= n
    book.lots[symbol] = [x for x in lots if x.quantity]
    if not book.lots[symbol]:
        for held in (book.lots, book.stops, book.marks, book.absent):
            held.pop(symbol, None)
    return out


def leave(s: Settings, book: Ledger, symbol: str, price: float, day: date, log: bool = True, quantity: int | None = None, cost: float | None = None, slip: float = 0.0) -> list[dict]:
    """Sells or covers a position (or part of it) at a price: trades, and a fill unless log is off."""
    n = quantity or abs(book.held(symbol))
    short = book.held(symbol) < 0
    cost = fee(s, not short, price, n) if cost is None else cost
    book.cash += (-1 if short else 1) * price * n - cost
    out = close_lots(s, book, symbol, n, price, day, cost)
    return out + ([{"kind": "fill", "date": day, "symbol": symbol, "quantity": n, "price": price, "fees": cost, "slippage": slip, "action": "COVER" if short else "SELL"}] if log else [])


def fill_orders(s: Settings, book: Ledger, day: date, bars: dict[str, dict], run: str) -> Iterator[dict]:
    """Yesterday's queue, in order. Unreached orders of a day lapse, longer ones wait until they expire; orders
    without a bar wait."""
    queue, book.queue = book.queue, []
    for o in queue:
        bar = bars.get(o.symbol)
        if bar is None or _number(bar["open"]) is None:
            book.queue.append(o)
            continue
        price, buys, held = base_price(s, o, bar, run), o.action in ("BUY", "COVER"), book.held(o.symbol)
        closes = o.action in ("SELL", "COVER")
        n = o.quantity
        if price is not None and closes:
            n = 0 if (held <= 0 if o.action == "SELL" else held >= 0) else min(abs(held), n) if n > 0 else abs(held)
            if n == 0:
                continue
        volume = _number(bar.get("volume")) or 0.0
        most = int(volume * s.max_volume_share)
        rest = max(0, n - most) if price is not None and most > 0 else 0
        net = slipped(s, buys, price, n - rest, volume) if price is not None else -1.0
        if net < 0:
            if o.expiry is not None and day < o.expiry:
                book.queue.append(o)
            continue
        if rest and s.requeue:
            book.queue.append(replace(o, quantity=rest, expiry=o.expiry or day + timedelta(days=REQUEUE_DAYS)))
        n -= rest
        cost = fee(s, not buys, net, n)
        if buys and net * n + cost > book.cash:
            n = max(0, int((book.cash - cost) // net))
            if n == 0:
                continue
            cost = fee(s, False, net, n)
        if closes:
            yield from leave(s, book, o.symbol, net, day, quantity=n, cost=cost, slip=abs(net - price))
            continue
        sign = 1 if o.action == "BUY" else -1
        book.cash -= sign * net * n + cost
        book.lots.setdefault(o.symbol, []).append(Lot(sign * n, net, day, cost))
        _set_stops(s, book, o.symbol, net, bar)
        yield {"kind": "fill", "date": day, "symbol": o.symbol, "quantity": n, "price": net, "fees": cost, "slippage": abs(net - price), "action": o.action}


def _set_stops(s: Settings, book: Ledger, symbol: str, price: float, bar: dict) -> None:
    """Levels from the fill price; of percentage and ATR the tighter. Shorts have neither ATR nor trailing stops."""
    side = 1 if book.held(symbol) > 0 else -1
    levels = [price * (1 - side * s.stop_loss)] if s.stop_loss is not None else []
    atr = _number(bar.get("ATR"))
    if side > 0 and s.stop_atr is not None and atr:
        levels.append(price - s.stop_atr * atr)
    out = {"stop": max(levels)} if levels else {}
    if s.target is not None:
        out["target"] = price * (1 + side * s.target)
    if side > 0 and s.trailing is not None:
        out["high"] = price
    if out:
        book.stops[symbol] = out


def check_stops(s: Settings, book: Ledger, day: date, bars: dict[str, dict]) -> Iterator[dict]:
    """Stop, then trailing stop, then target, each at its level."""
    for symbol, levels in list(book.stops.items()):
        bar = bars.get(symbol)
        if bar is None or symbol not in book.lots:
            continue
        side = 1 if book.held(symbol) > 0 else -1
        down, up = (bar["low"], bar["high"]) if side > 0 else (-bar["high"], -bar["low"])
        ways = [(levels.get("stop"), True), (levels["high"] * (1 - s.trailing) if "high" in levels else None, True), (levels.get("target"), False)]
        for level, falling in ways:
            if level is not None and (down <= side * level if falling else up >= side * level):
                yield from leave(s, book, symbol, level, day)
                break
        else:
            if "high" in levels:
                levels["high"] = max(levels["high"], bar["high"])


def decide(s: Settings, book: Ledger, day: date, bars: dict[str, dict], last: bool) -> None:
    """Orders for tomorrow from today's signal columns; one snapshot of equity and cash serves all of them."""
    if last:
        return
    equity, cash, owned, new = book.total(), book.cash, set(book.lots), set()
    scale = _vol_scale(s, book)
    for symbol, bar in bars.items():
        held = book.held(symbol)
        want = "SELL" if held > 0 and bar.get("sell") else "COVER" if held < 0 and bar.get("cover") else "BUY" if not held and bar.get("buy") else "SHORT" if not held and bar.get("short") and s.allow_short else None
        if want is None:
            continue
        n = -1
        if want in ("BUY", "SHORT"):
            if bar.get("regime_on") is False or len(owned) + len(new) >= s.max_positions or symbol in owned or _limited(s, book, want, symbol, bar, bars, equity):
                continue
            n = int(size(s, equity, cash, bar) * scale)
            if n <= 0:
                continue
            new.add(symbol)
        limit, stop = _number(bar.get("limit_price")), _number(bar.get("stop_price"))
        kind = "MARKET" if want in ("SELL", "COVER") or limit is None and stop is None else "STOP_LIMIT" if limit is not None and stop is not None else "LIMIT" if limit is not None else "STOP"
        book.numbered += 1
        book.queue.append(Order(symbol, want, n, kind, limit, stop, bar.get("expiry"), book.numbered))


def _limited(s: Settings, book: Ledger, want: str, symbol: str, bar: dict, bars: dict[str, dict], equity: float) -> bool:
    if equity <= 0:
        return False
    if s.max_sector is not None and bar.get("sector") is not None:
        own = sum(abs(book.value(x)) for x in book.lots if bars.get(x, {}).get("sector", "Unknown") == bar["sector"])
        added = bar["close"] * int(equity * s.max_alloc / bar["close"]) if bar["close"] > 0 else 0
        if (own + added) / equity >= s.max_sector:
            return True
    values = [book.value(x) for x in book.lots]
    gross, net = sum(map(abs, values)) / equity, sum(values) / equity
    return s.max_gross is not None and gross >= s.max_gross or s.max_net is not None and want == "BUY" and net >= s.max_net


def _vol_scale(s: Settings, book: Ledger) -> float:
    if s.portfolio_vol is None or len(book.equity) < s.vol_lookback + 1:
        return 1.0
    e = book.equity[-s.vol_lookback - 1 :]
    r = [b / a - 1 for a, b in zip(e[:-1], e[1:], strict=True) if a]
    mean = sum(r) / len(r)
    vol = math.sqrt(sum((x - mean) ** 2 for x in r) / len(r)) * math.sqrt(252)
    return min(s.portfolio_vol / vol, 2.0) if vol > 0 else 1.0


def step(s: Settings, book: Ledger, day: date, bars: dict[str, dict], run: str = "", last: bool = False) -> Iterator[dict]:
    """One day, in the order that is the simulation's meaning: fills, stops, delistings, marks, borrowing, dividends,
    equity, kill switch, signals. bars: symbol to its row, in the order in which signals are served."""
    yield from fill_orders(s, book, day, bars, run)
    yield from check_stops(s, book, day, bars)
    for symbol in list(book.lots):
        book.absent[symbol] = 0 if symbol in bars else book.absent.get(symbol, 0) + 1
        if book.absent[symbol] > ABSENT_SESSIONS:
            lots = book.lots[symbol]
            yield from leave(s, book, symbol, book.marks.get(symbol, lots[0].price), day)
    for symbol in book.lots:
        close = _number(bars[symbol]["close"]) if symbol in bars else None
        if close is not None:
            book.marks[symbol] = close
    if s.allow_short and s.borrow_rate > 0:
        book.cash -= sum(abs(book.value(x)) for x in book.lots if book.held(x) < 0) * s.borrow_rate / 252
    if s.drip:
        for symbol, lots in book.lots.items():
            paid = (_number(bars.get(symbol, {}).get("dividends")) or 0.0) * max(0, book.held(symbol))
            if paid > 0:
                n = int(paid / book.marks[symbol])
                book.cash += paid - n * book.marks[symbol]
                if n:
                    lots.append(Lot(n, book.marks[symbol], day, 0.0))
    now = book.total()
    book.equity = [*book.equity, now][-(s.vol_lookback + 1) :]
    book.peak = max(book.peak, now)
    yield {"kind": "equity", "date": day, "price": now}
    if s.max_drawdown is not None and not book.halted and book.peak > 0 and (now - book.peak) / book.peak <= -s.max_drawdown:
        yield from close_all(s, book, day)
        book.halted = True
    if not book.halted and next(iter(bars.values()), {}).get("rebalance") is not False:
        decide(s, book, day, bars, last)


def close_all(s: Settings, book: Ledger, day: date) -> Iterator[dict]:
    """Everything at its mark; no order survives, no fill is logged."""
    book.queue = []
    for symbol in list(book.lots):
        yield from leave(s, book, symbol, book.marks.get(symbol, book.lots[symbol][0].price), day, log=False)


EVENTS = {"kind": "string", "date": "date", "symbol": "string", "action": "string", "quantity": "long", "price": "double", "entry_date": "date", "entry_price": "double", "pnl": "double", "pnl_pct": "double", "fees": "double", "slippage": "double"}
SCHEMA = "run_id string, " + ", ".join(f"{k} {v}" for k, v in EVENTS.items())


def days_of(pdf: pd.DataFrame) -> Iterator[tuple[date, dict[str, dict]]]:
    order = ["date", *(["priority"] if "priority" in pdf else []), "symbol"]
    for day, g in pdf.sort_values(order, kind="stable").groupby("date", sort=True):
        yield day, {r["symbol"]: r for r in g.to_dict("records")}


def settings_of(pdf: pd.DataFrame, base: Settings) -> Settings:
    """base with the values of columns named set_<option>, which are constant in a run."""
    own = {c[4:]: pdf[c].iloc[0] for c in pdf.columns if c.startswith("set_")}
    return replace(base, **{k: v.item() if hasattr(v, "item") else v for k, v in own.items()})


def events_frame(out: list[dict], run_id: str) -> pd.DataFrame:
    """Events as rows of SCHEMA."""
    frame = pd.DataFrame(out, columns=list(EVENTS))
    for name, kind in EVENTS.items():
        if kind in ("date", "string"):
            frame[name] = frame[name].astype(object).where(frame[name].notna(), None)
        elif kind == "long":
            frame[name] = pd.array([None if pd.isna(x) else int(x) for x in frame[name]], dtype="Int64")
        else:
            frame[name] = frame[name].astype(float)
    frame.insert(0, "run_id", run_id)
    return frame


def simulate(features: DataFrame, settings: Settings = Settings(), equity_only: bool = False) -> DataFrame:  # noqa: B008
    """All events of all runs: equity by day, trades and fills; or equity alone, for readers of nothing else, which
    also holds where a run's quantities outgrow a long.

    features: run_id, symbol, date, open, high, low, close, volume, the booleans buy and sell, and optionally short,
    cover, regime_on, rebalance, priority, limit_price, stop_price, expiry, sector, ATR, dividends, set_<option>. A
    run's rows fit one task; scale comes from the number of runs."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = settings_of(pdf, settings)
        book, out, day = Ledger(own.cash), [], None
        final = pdf["date"].max()
        for day, bars in days_of(pdf):
            events = step(own, book, day, bars, key[0], last=day == final)
            out += [e for e in events if e["kind"] == "equity"] if equity_only else events
        if day is not None and not book.halted and not equity_only:
            out += close_all(own, book, day)
        return events_frame(out, key[0])

    keyed = features.withColumn("run_id", F.col("run_id").cast("string"))
    return keyed.groupBy("run_id").applyInPandas(run, SCHEMA)


def equity_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'equity'").select("run_id", "date", F.col("price").alias("equity"))


def trades_of(events: DataFrame) -> DataFrame:
    t = events.where("kind = 'trade'").withColumnRenamed("date", "exit_date").withColumnRenamed("price", "exit_price")
    return t.select("run_id", "symbol", "entry_date", "exit_date", "entry_price", "exit_price", "quantity", "pnl", "pnl_pct", F.datediff("exit_date", "entry_date").alias("holding_days"), "fees")


def activity_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'fill'").select("run_id", "date", "symbol", "action", "quantity", "price", (F.col("quantity") * F.col("price")).alias("value"), "fees", "slippage")
