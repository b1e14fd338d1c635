"""The rule language: [left, operator, right] lists, compiled to one Column that Catalyst sees."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable] = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq}
LENIENT = OPERATORS | {"!=": operator.ne}


def _operand(x: object, columns: set[str]) -> Column:
    """A number, or a column by its exact name; NULL for a column that is not there."""
    if isinstance(x, str):
        return F.col(f"`{x}`").cast("double") if x in columns else F.lit(None).cast("double")
    return F.lit(float(x))


def validate(rules: list, known: set[str] | None = None) -> None:
    for rule in rules:
        if not isinstance(rule, (list, tuple)) or len(rule) != 3:
            raise ValueError(f"a rule is [left, operator, right], not {rule!r}")
        if rule[1] not in OPERATORS:
            raise ValueError(f"unknown operator {rule[1]!r}")
        if known is not None and isinstance(rule[0], str) and rule[0] not in known:
            raise ValueError(f"unknown column {rule[0]!r}")


def compile_rules(rules: list, columns: list[str], lenient: bool = False) -> Column:
    """True where all rules hold; a NULL on either side makes a rule false; no rules make false (lenient: NULL).

    lenient skips malformed rules and unknown operators, and knows `!=`."""
    names = set(columns)
    if lenient:
        rules = [r for r in rules if isinstance(r, (list, tuple)) and len(r) == 3 and r[1] in LENIENT]
        if not rules:
            return F.lit(None).cast("boolean")
    else:
        validate(rules)
        if not rules:
            return F.lit(False)
    tests = [F.coalesce(LENIENT[op](_operand(a, names), _operand(b, names)), F.lit(False)) for a, op, b in rules]
    return reduce(lambda x, y: x & y, tests)


def with_benchmark(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """bars with the benchmark's columns of the same date as bm_<column>."""
    renamed = benchmark.select("date", *[F.col(c).alias(f"bm_{c}") for c in benchmark.columns if c not in ("symbol", "date")])
    return bars.join(renamed, "date", "left")
