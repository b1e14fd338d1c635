import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantloom.functions.indicators import with_indicators
from quantloom.plans import rules
from quantloom.plans.strategies import get_strategy


def bars_of(spark, close, symbol="A"):
    rows = [(symbol, dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.999 * c, 1.01 * c, 0.99 * c, float(c), 1000) for i, c in enumerate(map(float, close))]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


def test_known_values(spark):
    out = with_indicators(bars_of(spark, [1, 2, 3, 4, 5]), {"s": {"fn": "sma", "period": 3}, "e": {"fn": "ema", "period": 3}})
    assert column(out, "s") == [None, None, 2, 3, 4]
    assert column(out, "e")[:2] == [None, None]
    assert column(out, "e")[2:] == pytest.approx([2.25, 3.125, 4.0625])


def test_rsi_of_gains_is_100(spark):
    r = column(with_indicators(bars_of(spark, range(100, 130)), {"r": {"fn": "rsi", "period": 14}}), "r")
    assert r[:13] == [None] * 13 and r[13:] == [100.0] * 17


def test_psar_follows_trend(spark):
    up = column(with_indicators(bars_of(spark, np.linspace(10, 20, 30)), {"p": {"fn": "psar"}}), "p")
    assert all(a <= b for a, b in zip(up, up[1:]))
    assert column(with_indicators(bars_of(spark, [5]), {"p": {"fn": "psar"}}), "p") == [None]


def test_symbols_do_not_mix(spark):
    both = bars_of(spark, [1, 2, 3]).unionByName(bars_of(spark, [10, 20, 30], "B"))
    assert column(with_indicators(both, {"s": {"fn": "sma", "period": 2}}), "s") == [None, 1.5, 2.5, None, 15, 25]


def test_flat_prices_give_nulls_not_errors(spark):
    flat = spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 0) for i in range(60)], "symbol string, date date, open double, high double, low double, close double, volume long")
    specs = {n: {"fn": n} for n in ("stochastic", "adx", "cci", "mfi", "vwap", "williams_r", "rsi", "ichimoku", "keltner")}
    assert with_indicators(flat, specs).count() == 60


def test_unknown_indicator(spark):
    with pytest.raises(ValueError):
        with_indicators(bars_of(spark, [1]), {"x": {"fn": "nothing"}})


def test_rules(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0, None], "b": [0.5, 3.0, 1.0]}))
    pick = lambda r, **k: [x[0] for x in df.select(rules.compile_rules(r, df.columns, **k)).collect()]
    assert pick([["a", ">", "b"]]) == [True, False, False]
    assert pick([["a", ">", 0], ["b", "<", 2]]) == [True, False, False]
    assert pick([["A", ">", 0]]) == [False] * 3  # names are exact
    assert pick([]) == [False] * 3
    assert pick([["x"], ["a", "~", 1]], lenient=True) == [None] * 3
    assert pick([["a", "!=", 2]], lenient=True) == [True, False, False]
    with pytest.raises(ValueError):
        rules.compile_rules([["a", "!=", 1]], ["a"])


def test_strategy_checks():
    with pytest.raises(ValueError):
        get_strategy("sma_crossover", {"sma_fast": 50, "sma_slow": 20})
    with pytest.raises(ValueError):
        get_strategy("no_such")
