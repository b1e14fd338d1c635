"""Exchange sessions by rule, and rebalance days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _nth(year: str, month: int, weekday: int, n: int) -> str:
    """SQL for the n-th weekday (0 Monday) of a month."""
    first = f"make_date({year}, {month}, 1)"
    return f"date_add({first}, (7 + {weekday} - weekday({first})) % 7 + {7 * (n - 1)})"


def _easter(y: str) -> str:
    """Western Easter Sunday by the anonymous Gregorian computus, as SQL over a column of years."""
    a, b, c = f"({y} % 19)", f"({y} div 100)", f"({y} % 100)"
    h = f"((19 * {a} + {b} - {b} div 4 - ({b} - ({b} + 8) div 25 + 1) div 3 + 15) % 30)"
    k = f"((32 + 2 * ({b} % 4) + 2 * ({c} div 4) - {h} - {c} % 4) % 7)"
    m = f"(({a} + 11 * {h} + 22 * {k}) div 451)"
    n = f"({h} + {k} - 7 * {m} + 114)"
    return f"make_date({y}, CAST({n} div 31 AS INT), CAST({n} % 31 + 1 AS INT))"


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Weekday holidays of the New York exchange: fixed days move to Monday or Friday, but New Year's not to Friday."""
    y = "year"
    moved = lambda d: f"CASE weekday({d}) WHEN 5 THEN date_sub({d}, 1) WHEN 6 THEN date_add({d}, 1) ELSE {d} END"
    new_year = f"make_date({y}, 1, 1)"
    days = [
        f"CASE weekday({new_year}) WHEN 5 THEN NULL WHEN 6 THEN date_add({new_year}, 1) ELSE {new_year} END",
        f"CASE WHEN {y} >= 1998 THEN {_nth(y, 1, 0, 3)} END", _nth(y, 2, 0, 3), f"date_sub({_easter(y)}, 2)",
        f"CASE WHEN weekday(make_date({y}, 5, 31)) >= 0 THEN date_sub(make_date({y}, 5, 31), weekday(make_date({y}, 5, 31))) END",
        f"CASE WHEN {y} >= 2022 THEN {moved(f'make_date({y}, 6, 19)')} END", moved(f"make_date({y}, 7, 4)"), _nth(y, 9, 0, 1), _nth(y, 11, 3, 4), moved(f"make_date({y}, 12, 25)"),
    ]
    return spark.sql(f"SELECT date FROM (SELECT explode(array({', '.join(days)})) AS date FROM (SELECT explode(sequence(CAST({first_year} AS INT), CAST({last_year} AS INT))) AS year)) WHERE date IS NOT NULL")


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Weekdays from start to end that are no holidays."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS date").where(F.weekday("date") < 5)
    return days.join(F.broadcast(holidays(spark, int(start[:4]), int(end[:4]))), "date", "left_anti")


def rebalance_days(dates: DataFrame, schedule: str) -> DataFrame:
    """date and rebalance: whether week, month or quarter differs from the session before; the first day counts."""
    return rebalance_flags(dates, {"rebalance": schedule})


def rebalance_flags(dates: DataFrame, schedules: dict[str, str]) -> DataFrame:
    """dates with a flag of each name for its schedule, all over one window."""
    w = Window.partitionBy(*[c for c in dates.columns if c != "date"]).orderBy("date")
    parts = {"weekly": F.weekofyear, "monthly": F.month, "quarterly": F.quarter}
    starts = lambda s: F.lit(True) if s == "daily" else F.coalesce(parts[s]("date") != F.lag(parts[s]("date")).over(w), F.lit(True))
    return dates.withColumns({name: starts(s) for name, s in schedules.items()})
