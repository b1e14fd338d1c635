import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.operators import simulator as S

DAY = dt.date(2020, 1, 1)


def bar(close, **more):
    return {"open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 1_000_000, "buy": False, "sell": False, **more}


def play(days, **options):
    s = S.Settings(**{"slippage_bps": 0, **options})
    book, out = S.Ledger(s.cash), []
    for i, bars in enumerate(days):
        out += S.step(s, book, DAY + dt.timedelta(days=i), bars, "t", last=i == len(days) - 1)
    return book, out


def kinds(out, kind):
    return [e for e in out if e["kind"] == kind]


def test_signal_fills_at_the_next_open():
    book, out = play([{"A": bar(100, buy=True)}, {"A": bar(110)}, {"A": bar(120)}], max_alloc=0.5)
    fill = kinds(out, "fill")[0]
    assert (fill["date"], fill["price"], fill["quantity"]) == (DAY + dt.timedelta(days=1), 110, 500)
    assert book.cash == 100_000 - 500 * 110


def test_cash_is_conserved():
    days = [{"A": bar(100 + i, buy=i % 7 == 0, sell=i % 7 == 4), "B": bar(50 - i / 4, buy=i % 5 == 0, sell=i % 5 == 3)} for i in range(60)]
    book, out = play(days, fee_bps=5, us_fees=True)
    flow = sum((-1 if e["action"] in ("BUY", "COVER") else 1) * e["quantity"] * e["price"] - e["fees"] for e in kinds(out, "fill"))
    assert book.cash == pytest.approx(100_000 + flow)
    assert all(n > 0 for n in (book.held(x) for x in book.lots))


def test_oversized_buy_shrinks_to_cash():
    book, out = play([{"A": bar(100, buy=True)}, {"A": bar(150)}, {"A": bar(150)}], max_alloc=1.0)
    assert kinds(out, "fill")[0]["quantity"] == 666 and book.cash >= 0


def test_stop_beats_target_on_the_same_day():
    wild = {"A": {**bar(100), "high": 150.0, "low": 50.0}}
    _, out = play([{"A": bar(100, buy=True)}, wild, {"A": bar(100)}], stop_loss=0.1, target=0.2)
    assert kinds(out, "trade")[0]["price"] == pytest.approx(90)


def test_trailing_stop_rises():
    days = [{"A": bar(100, buy=True)}, {"A": bar(100)}, {"A": bar(200)}, {"A": bar(150)}]
    _, out = play(days, trailing=0.1)
    assert kinds(out, "trade")[0]["price"] == pytest.approx(202 * 0.9)


def test_lots_and_fees_split():
    s, book = S.Settings(), S.Ledger(0.0, {"A": [S.Lot(100, 10.0, DAY, 1.0), S.Lot(50, 20.0, DAY, 1.0)]})
    t = S.close_lots(s, book, "A", 40, 15.0, DAY, 0.8)[0]
    assert t["fees"] == pytest.approx(0.4 + 0.8) and book.lots["A"][0].fee == pytest.approx(0.6)
    high = S.Ledger(0.0, {"A": [S.Lot(100, 10.0, DAY, 0.0), S.Lot(50, 20.0, DAY, 0.0)]})
    assert S.close_lots(S.Settings(lots="highest"), high, "A", 60, 15.0, DAY, 0.0)[0]["entry_price"] == 20
    with pytest.raises(ValueError):
        S.close_lots(s, book, "A", 1000, 15.0, DAY, 0.0)


def test_short_profit():
    days = [{"A": bar(50, short=True)}, {"A": bar(50)}, {"A": bar(40, cover=True)}, {"A": bar(40)}, {"A": bar(40)}]
    _, out = play(days, allow_short=True, max_alloc=0.05)
    t = kinds(out, "trade")[0]
    assert t["pnl"] == pytest.approx(100 * 10) and t["pnl_pct"] == pytest.approx(0.25)


def test_silent_symbol_is_closed_at_its_mark():
    days = [{"A": bar(100, buy=True), "B": bar(1)}, {"A": bar(100), "B": bar(1)}] + [{"B": bar(1)}] * 7
    _, out = play(days)
    assert kinds(out, "trade")[0]["date"] == DAY + dt.timedelta(days=7)


def test_kill_switch_and_limits():
    days = [{"A": bar(100, buy=True)}, {"A": bar(100)}, {"A": bar(40)}, {"A": bar(40, buy=True)}, {"A": bar(40)}]
    book, out = play(days, max_drawdown=0.2, max_alloc=0.9)
    assert book.halted and not book.lots and len(kinds(out, "fill")) == 1
    _, out = play([{x: bar(10, buy=True) for x in "ABC"}, {x: bar(10) for x in "ABC"}, {x: bar(10) for x in "ABC"}], max_positions=2)
    assert len(kinds(out, "fill")) == 2


def test_partial_fill_requeues():
    thin = {"A": {**bar(10), "volume": 1000}}
    _, out = play([{"A": bar(10, buy=True)}, thin, thin, thin], max_volume_share=0.1, requeue=True)
    assert [f["quantity"] for f in kinds(out, "fill")] == [100, 100, 100]


def test_limit_order_waits_until_expiry():
    days = [{"A": bar(100, buy=True, limit_price=90.0, expiry=DAY + dt.timedelta(days=5))}, {"A": bar(100)}, {"A": bar(90)}, {"A": bar(90)}]
    _, out = play(days)
    assert kinds(out, "fill")[0]["price"] == 90 and kinds(out, "fill")[0]["date"] == DAY + dt.timedelta(days=2)
    assert not kinds(play([{"A": bar(100, buy=True, limit_price=90.0)}, {"A": bar(100)}, {"A": bar(90)}, {"A": bar(90)}])[1], "fill")


def test_batch_equals_stream(spark):
    from quantloom.streaming import streams

    rows = [("r", s, DAY + dt.timedelta(days=i), float(100 + i), 101.0 + i, 99.0 + i, 100.0 + i, 1000.0, i % 5 == k, i % 5 == k + 2) for i in range(20) for k, s in enumerate("AB")]
    f = spark.createDataFrame(rows, "run_id string, symbol string, date date, open double, high double, low double, close double, volume double, buy boolean, sell boolean")
    batch = sorted((r.date, round(r.equity, 6)) for r in S.equity_of(S.simulate(f)).collect())
    from quantloom.session import shared_dir

    path = shared_dir(spark, "feed")
    f.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(f.schema).parquet(path)
    live = streams.drained(streams.ledger(stream, S.Settings()), "ledger")
    assert sorted((r.date, round(r.equity, 6)) for r in S.equity_of(live).collect()) == batch


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(1, 500), st.booleans(), st.booleans()), min_size=2, max_size=40))
def test_equity_is_cash_and_marks(path):
    book, out = play([{"A": bar(c, buy=b, sell=s)} for c, b, s in path], fee_per_trade=1.0, max_alloc=0.5)
    assert book.cash >= -1e-6
    assert kinds(out, "equity")[-1]["price"] == pytest.approx(book.total())
