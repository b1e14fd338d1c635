"""Stops, lots and moves against plain versions that go bar by bar and order by order."""

import datetime as dt
import random

import pytest

from quantloom.operators import execution, lots, metrics, stops

DAY0 = dt.date(2019, 11, 20)
BAR = "symbol string, date date, open double, high double, low double, close double"


def walk(symbol, n, seed, step=3.0):
    """Bars on most days, over several years and year ends; some without low or high."""
    r, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        day = DAY0 + dt.timedelta(days=3 * i)
        if r.random() < 0.1:
            continue
        price = max(5.0, price + r.gauss(0, step))
        low, high = price - r.random() * step, price + r.random() * step
        out.append((symbol, day, price, None if r.random() < 0.02 else high, None if r.random() < 0.02 else low, price))
    return out


def exit_of(entry, bars, trailing):
    symbol, day, price, quantity, stop, target = entry
    top = price
    for s, date, _, high, low, close in bars:
        if s != symbol or date < day:
            continue
        if low is not None and high is not None:
            if quantity >= 0:
                trail = (1 - trailing) * top if trailing is not None else None
                for level, hit, name in ((stop, stop is not None and low <= stop, "stop_loss"), (trail, trail is not None and low <= trail, "trailing_stop"), (target, target is not None and high >= target, "take_profit")):
                    if hit:
                        return date, level, name
            else:
                if stop is not None and high >= stop:
                    return date, stop, "stop_loss"
                if target is not None and low <= target:
                    return date, target, "take_profit"
        top = max(top, high if high is not None else close)
    return None, None, None


@pytest.mark.parametrize("trailing", [None, 0.05, 0.2])
def test_first_hit_matches_every_bar(spark, trailing):
    bars = walk("A", 500, 1) + walk("B", 300, 2, 1.0)
    r, entries = random.Random(3), []
    for s, day, price, *_ in bars[::3]:
        quantity = r.choice([5, -5])
        up, down = price * (1 + r.choice([0.02, 0.1, 0.4])), price * (1 - r.choice([0.02, 0.1, 0.4]))
        stop, target = (down, up) if quantity > 0 else (up, down)
        entries.append((s, day, price, quantity, r.choice([stop, stop, None]), r.choice([target, target, None])))
    entries += entries[:5] + [("C", DAY0, 10.0, 1, 9.0, 11.0), ("A", dt.date(2030, 1, 1), 10.0, 1, 9.0, 11.0)]
    e = spark.createDataFrame(entries, "symbol string, entry_date date, entry_price double, quantity int, stop double, target double")
    got = sorted((tuple(x) for x in stops.first_hit(e, spark.createDataFrame(bars, BAR), trailing).collect()), key=repr)
    want = sorted(((*x, *exit_of(x, bars, trailing)) for x in entries), key=repr)
    assert got == want
    assert {x[-1] for x in want} >= {"stop_loss", "take_profit", None} | ({"trailing_stop"} if trailing else set())


def test_first_hit_of_nothing(spark):
    e = spark.createDataFrame([], "symbol string, entry_date date, entry_price double, quantity int, stop double, target double")
    assert stops.first_hit(e, spark.createDataFrame([], BAR), 0.1).count() == 0


def test_excursions_of_overlapping_trades(spark):
    bars = [("S", DAY0 + dt.timedelta(days=i), 100.0, h, low, 100.0) for i, (low, h) in enumerate([(97.0, 103.0), (98.0, 102.0), (99.0, 101.0), (70.0, 120.0), (80.0, 150.0)])]
    bars += walk("A", 200, 5)
    bars = [b for b in bars if b[3] is not None and b[4] is not None]
    r = random.Random(6)
    trades = [("S", DAY0, DAY0 + dt.timedelta(days=4), 100.0, 0.1, 1), ("S", DAY0 + dt.timedelta(days=1), DAY0 + dt.timedelta(days=2), 100.0, 0.1, 1), ("S", DAY0, DAY0 + dt.timedelta(days=1), 100.0, 0.1, -1)]
    trades += [("A", d, d + dt.timedelta(days=r.choice([0, 1, 20, 60, 200])), p, 0.2, r.choice([3, -3])) for _, d, p, *_ in bars[5::2]]
    trades += [trades[0], ("none", DAY0, DAY0, 5.0, 0.1, 1), ("S", DAY0, DAY0, 0.0, 0.1, 1), ("S", DAY0 + dt.timedelta(days=3), DAY0, 100.0, 0.1, 1)]
    want = []
    for s, a, b, p, pnl, q in trades:
        own = [(x[4], x[3]) for x in bars if x[0] == s and a <= x[1] <= b]
        low, high = (min(x[0] for x in own), max(x[1] for x in own)) if own else (None, None)
        mae, mfe = (0.0, 0.0) if not own or p <= 0 else (low / p - 1, high / p - 1) if q >= 0 else (1 - high / p, 1 - low / p)
        want.append((s, a, b, q, round(mae, 9), round(mfe, 9)))
    t = spark.createDataFrame(trades, "symbol string, entry_date date, exit_date date, entry_price double, pnl_pct double, quantity int")
    moves = metrics.excursions(t, spark.createDataFrame(bars, BAR))
    got = [(m.symbol, m.entry_date, m.exit_date, m.quantity, round(m.mae, 9), round(m.mfe, 9)) for m in moves.collect()]
    assert sorted(got) == sorted(want)
    assert [w[4:] for w in want[:2]] == [(-0.3, 0.5), (-0.02, 0.02)]
    s = metrics.excursion_summary(moves).first()
    assert s.efficiency == pytest.approx(abs(s.avg_mfe / s.avg_mae))
    empty = metrics.excursion_summary(moves.limit(0)).first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def orders(n, seed, amounts, accounts=4):
    """Rows (account, seq, side, quantity, price); some sells exceed what is held."""
    r = random.Random(seed)
    return [(r.choice([*range(accounts), None]) if seed % 2 else r.randrange(accounts), i, r.choice(["BUY", "BUY", "SELL"]), r.choice(amounts), float(r.randrange(5, 9))) for i in range(n)]


def pairs(rows, pick):
    """(account, buy, sell) -> quantity, taking lots one by one; pick chooses the next of the open lots."""
    open_, out = {}, {}
    for account, seq, side, quantity, price in rows:
        own = open_.setdefault(account, [])
        if side == "BUY":
            own.append([seq, quantity, price])
            continue
        while quantity > 1e-9 and own:
            lot = pick(own)
            part = min(quantity, lot[1])
            out[account, lot[0], seq] = (out.get((account, lot[0], seq), (0,))[0] + part, price - lot[2])
            quantity, lot[1] = quantity - part, lot[1] - part
            if lot[1] <= 1e-9:
                own.remove(lot)
    return {k: (round(q, 6), round(q * gain, 6)) for k, (q, gain) in out.items()}


@pytest.mark.parametrize("amounts", [[1, 2, 5, 40], [0.1, 0.2, 0.3, 0.7, 1.15]])
def test_last_in_first_out(spark, amounts):
    rows = orders(400, 2, amounts)
    side = lambda name: spark.createDataFrame([(a, i, q, p) for a, i, s, q, p in rows if s == name], f"a int, seq long, quantity {'double' if isinstance(amounts[0], float) else 'long'}, price double")
    got = {(r.a, r.buy_seq, r.sell_seq): (round(float(r.quantity), 6), round(float(r.pnl), 6)) for r in execution.match_lots_lifo(side("BUY"), side("SELL"), "a").collect()}
    assert got == pairs(rows, lambda own: own[-1]) and len(got) > 100


def test_first_in_first_out_of_fractions(spark):
    r = random.Random(9)
    amounts = [0.1, 0.2, 0.3, 0.5, 0.7]
    rows = [(0, i, "BUY" if i < 200 else "SELL", r.choice(amounts), float(i)) for i in range(400)]
    side = lambda name: spark.createDataFrame([(a, i, q, p) for a, i, s, q, p in rows if s == name], "a int, seq long, quantity double, price double")
    got = {(x.a, x.buy_seq, x.sell_seq): (round(float(x.quantity), 6), round(float(x.pnl), 6)) for x in execution.match_lots(side("BUY"), side("SELL"), "a").collect()}
    assert got == pairs(rows, lambda own: own[0]) and min(q for q, _ in got.values()) > 0.05


@pytest.mark.parametrize("highest", [True, False])
def test_lots_by_cost_in_batch_and_on_a_stream(spark, tmp_path, highest):
    rows = orders(300, 3, [0.1, 0.2, 1.0, 2.5])
    want = pairs(rows, lambda own: (max if highest else min)(own, key=lambda lot: (lot[2], -lot[0] if highest else lot[0])))
    schema = "a int, seq long, side string, quantity double, price double"
    read = lambda df: {(int(r.account) if r.account is not None else None, r.buy_seq, r.sell_seq): (round(r.quantity, 6), round(r.pnl, 6)) for r in df.collect()}
    assert read(lots.match_by_cost(spark.createDataFrame(rows, schema), "a", highest)) == want
    for i in range(0, 300, 100):
        spark.createDataFrame(rows[i : i + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = lots.stream_by_cost(stream, "a", highest).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert read(spark.read.parquet(str(tmp_path / "out"))) == want
    held = {(a, p) for a, lot_rows in left_of(rows, highest).items() for _, _, p in lot_rows}
    assert out.lastProgress.stateOperators[0].numRowsTotal <= len(held) + 5


def left_of(rows, highest):
    open_ = {}
    for account, seq, side, quantity, price in rows:
        own = open_.setdefault(account, [])
        if side == "BUY":
            own.append([seq, quantity, price])
        while side == "SELL" and quantity > 1e-9 and own:
            lot = (max if highest else min)(own, key=lambda x: (x[2], -x[0] if highest else x[0]))
            part = min(quantity, lot[1])
            quantity, lot[1] = quantity - part, lot[1] - part
            if lot[1] <= 1e-9:
                own.remove(lot)
    return open_
