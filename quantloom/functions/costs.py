"""Fees, slippage, sizing, fill prices and stop levels as Columns. Quantities are whole, prices doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the fee models.
SEC_PER_DOLLAR, TAF_PER_SHARE, TAF_CAP = 8.0 / 1_000_000, 0.000119, 5.95


def signed(side: Column) -> Column:
    """+1 for what buys, -1 for what sells."""
    return F.when(side.isin("BUY", "COVER"), 1.0).otherwise(-1.0)


def fixed_slippage(price: Column, side: Column, bps: float = 10.0) -> Column:
    return price + signed(side) * price * bps / 10_000.0


def volume_slippage(price: Column, side: Column, quantity: Column, volume: Column, impact: float = 0.1) -> Column:
    return F.when(volume > 0, price + signed(side) * price * impact * quantity / volume).otherwise(price)


def sqrt_slippage(price: Column, side: Column, quantity: Column, volume: Column, sigma: float = 0.02, impact: float = 0.1) -> Column:
    return F.when(volume > 0, price + signed(side) * impact * sigma * F.sqrt(quantity / volume) * price).otherwise(price)


def per_trade_fee(fee: float) -> Column:
    return F.lit(float(fee))


def percentage_fee(price: Column, quantity: Column, bps: float = 5.0) -> Column:
    return price * quantity * bps / 10_000.0


def tiered_fee(price: Column, quantity: Column, tiers: list[tuple[float, float]]) -> Column:
    """Marginal bands: tiers are (threshold, bps) in ascending order."""
    if not tiers:
        raise ValueError("no tiers")
    notional, tops = price * quantity, [t for t, _ in tiers[1:]] + [None]
    band = lambda low, top: F.greatest(F.lit(0.0), (notional if top is None else F.least(notional, F.lit(float(top)))) - low)
    return reduce(lambda a, b: a + b, [band(low, top) * bps / 10_000.0 for (low, bps), top in zip(tiers, tops, strict=True)])


def sec_fee(price: Column, quantity: Column, side: Column) -> Column:
    return F.when(side.isin("SELL", "SHORT"), price * quantity * SEC_PER_DOLLAR).otherwise(0.0)


def taf_fee(quantity: Column, side: Column) -> Column:
    return F.when(side.isin("SELL", "SHORT"), F.least(quantity * TAF_PER_SHARE, F.lit(TAF_CAP))).otherwise(0.0)


def composite_fee(price: Column, quantity: Column, side: Column, bps: float = 5.0) -> Column:
    return percentage_fee(price, quantity, bps) + sec_fee(price, quantity, side) + taf_fee(quantity, side)


def _whole(x: Column) -> Column:
    return F.coalesce(F.greatest(F.floor(x), F.lit(0)), F.lit(0)).cast("long")


def fixed_fractional(equity: Column, cash: Column, price: Column, alloc: float) -> Column:
    return _whole(F.when(price > 0, F.least(equity * alloc, cash) / price))


def atr_size(equity: Column, cash: Column, price: Column, atr: Column, alloc: float, risk: float = 0.01, multiple: float = 2.0) -> Column:
    """Risks a share of equity per ATR multiple, within allocation and cash; fixed-fractional without an ATR."""
    plain = fixed_fractional(equity, cash, price, alloc)
    return F.when(F.coalesce(atr > 0, F.lit(False)), F.least(_whole(equity * risk / (F.nullif(atr, F.lit(0.0)) * multiple)), plain)).otherwise(plain)


def kelly_size(equity: Column, cash: Column, price: Column, win: Column, payoff: Column, alloc: float, fraction: float = 0.5) -> Column:
    f = (win * payoff - (1.0 - win)) / F.nullif(payoff, F.lit(0.0))
    share = F.least(f * fraction, F.lit(alloc))
    return F.when(F.coalesce(f > 0, F.lit(False)), _whole(F.least(equity * share, cash) / price)).otherwise(F.lit(0).cast("long"))


def volatility_size(equity: Column, cash: Column, price: Column, atr: Column, alloc: float, target: float = 0.10) -> Column:
    """Risk parity: the position's yearly volatility, from ATR, meets the target; also volatility parity."""
    plain = fixed_fractional(equity, cash, price, alloc)
    vol = atr / price * F.sqrt(F.lit(252.0))
    return F.when(F.coalesce(vol > 0, F.lit(False)), _whole(F.least(equity * F.least(target / F.nullif(vol, F.lit(0.0)), F.lit(alloc)), cash) / price)).otherwise(plain)


def volatility_parity(equity: Column, cash: Column, price: Column, atr: Column, alloc: float, target: float = 0.10, lookback: int = 20) -> Column:
    """A yearly volatility budget for each position, with ATR for its volatility; lookback is accepted from
    configurations and says nothing, as ATR has its own period."""
    return volatility_size(equity, cash, price, atr, alloc, target)


def fill_price(kind: Column, side: Column, limit: Column, stop: Column, model: str = "open") -> Column:
    """The base price of an order on a bar (open, high, low, close), NULL where it does not fill.

    Market: open, close or typical price. Limit: the limit, if the range touches it. Stop: the stop, likewise.
    Stop-limit: needs both, fills at the limit."""
    market = {"open": F.col("open"), "close": F.col("close"), "vwap": (F.col("high") + F.col("low") + F.col("close")) / 3.0}[model]
    buys = side.isin("BUY", "COVER")
    reached = F.when(buys, F.col("low") <= limit).otherwise(F.col("high") >= limit)
    triggered = F.when(buys, F.col("high") >= stop).otherwise(F.col("low") <= stop)
    return F.when(kind == "MARKET", market).when((kind == "LIMIT") & reached, limit).when((kind == "STOP") & triggered, stop).when((kind == "STOP_LIMIT") & triggered & reached, limit)


def stop_levels(entry: Column, atr: Column, stop_pct: float | None, atr_multiple: float | None, target_pct: float | None) -> dict[str, Column]:
    """Stop (the tighter of percentage and ATR) and target of a long position."""
    levels = [entry * (1 - stop_pct)] if stop_pct is not None else []
    if atr_multiple is not None:
        levels.append(entry - atr * atr_multiple)
    tight = F.lit(None).cast("double") if not levels else levels[0] if len(levels) == 1 else F.greatest(*levels)
    return {"stop": tight, "target": entry * (1 + target_pct) if target_pct is not None else F.lit(None).cast("double")}
