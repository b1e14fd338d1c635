"""The report of one run as text."""

import datetime as dt

import pytest

from quantloom import cli
from quantloom.sources import sinks


def curve(spark, values, run="r"):
    days = [dt.date(2020, 1, 30) + dt.timedelta(days=i) for i in range(len(values))]
    return spark.createDataFrame([(run, d, float(v)) for d, v in zip(days, values, strict=True)], "run_id string, date date, equity double")


TRADE = "run_id string, symbol string, entry_date date, exit_date date, entry_price double, exit_price double, quantity long, pnl double, pnl_pct double, holding_days int, fees double"


def test_console(spark):
    equity = curve(spark, [100, 110, 88, 99, 121, 120])
    d = dt.date(2020, 1, 31)
    trades = spark.createDataFrame([("r", "AA", d, d + dt.timedelta(days=2), 10.0, 12.0, 5, 10.0, 0.2, 2, 1.5), ("r", "BB", d, d, 10.0, 9.0, 5, -5.0, -0.1, 0, 0.5)], TRADE)
    text = sinks.console(equity, trades)
    lines = text.splitlines()
    assert "Year" + " " * 2 + "".join(f"{m:>8}" for m in [*sinks.MONTHS, "YTD"]) in lines
    table = next(x for x in lines if x.startswith("2020  ") and "%" in x)
    assert table.split() == ["2020", "10.0%", "9.1%", "20.0%"]
    assert any(x.startswith("2020") and x.split() == ["2020", "**", "**"] for x in lines)
    assert any(x.split() == ["2020-02-01", "2020-02-01", "2020-02-03", "-20.0%", "2"] for x in lines) and any("ongoing" in x for x in lines)
    assert any(x.split()[:2] == ["best_pnl", "10.0000"] for x in lines if x) and any(x.split()[:3] == ["AA", "2020-01-31", "2020-02-02"] for x in lines)
    assert "Deepest drawdowns" in sinks.console(equity, trades.limit(0)) and sinks.console(equity.limit(0), trades.limit(0)) == "no bars"


def test_analyses_of_one_run_refuse_several(spark):
    with pytest.raises(ValueError):
        cli._numbered(curve(spark, [1, 2]).unionByName(curve(spark, [1, 2], "other")))
