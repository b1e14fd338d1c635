"""Registered queries do the whole job: no id subset of their input."""

import datetime as dt

import pytest
from compare import SF

from quantloom.operators import simulator as S
from quantloom.queries import simulation
from quantloom.sources import bars


def test_grid_search_runs_over_all_bars(spark, monkeypatch):
    class Seen(Exception):
        pass

    def simulate(features, *_, **__):
        raise Seen(features)

    monkeypatch.setattr(simulation.S, "simulate", simulate)
    with pytest.raises(Seen) as seen:
        simulation.grid_search(spark, SF)
    rows = seen.value.args[0].groupBy("run_id", "symbol").count().collect()
    want = {r.symbol: r["count"] for r in bars.brand_bars(spark, SF).groupBy("symbol").count().collect()}
    got = {}
    for r in rows:
        got.setdefault(r.run_id, {})[r.symbol] = r["count"]
    assert len(got) == 6 and all(x == want for x in got.values())


def test_equity_of_quantities_beyond_a_long(spark):
    days = [("r", "A", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0 + i % 2, 1e9, i == 0, i == 4) for i in range(8)]
    f = spark.createDataFrame(days, "run_id string, symbol string, date date, open double, high double, low double, close double, volume double, buy boolean, sell boolean")
    small = [(r.date, r.equity) for r in S.equity_of(S.simulate(f, S.Settings(cash=1e9))).orderBy("date").collect()]
    large = [(r.date, r.equity) for r in S.equity_of(S.simulate(f, S.Settings(cash=1e24), equity_only=True)).orderBy("date").collect()]
    assert [d for d, _ in large] == [d for d, _ in small] and [x / 1e24 for _, x in large] == pytest.approx([x / 1e9 for _, x in small])
