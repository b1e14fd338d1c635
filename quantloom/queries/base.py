"""The registry, rounding, and the SQL of derived bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_ORDER = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"
_BARS = "arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close"
CTE = {
    "mkt": f"mkt AS (SELECT symbol, date, {_BARS}, sum(q)::BIGINT AS volume FROM (SELECT 'MKT' AS symbol, l_shipdate::DATE AS date, l_extendedprice / l_quantity AS px, l_quantity AS q, {_ORDER} AS k FROM lineitem) GROUP BY ALL)",
    "brand": f"brand AS (SELECT symbol, date, {_BARS}, sum(q)::BIGINT AS volume FROM (SELECT p_brand AS symbol, l_shipdate::DATE AS date, l_extendedprice / l_quantity AS px, l_quantity AS q, {_ORDER} AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL)",
    "evt": f"evt AS (SELECT symbol, date, {_BARS}, count(*)::BIGINT AS volume FROM (SELECT event_type AS symbol, ts::DATE AS date, value AS px, (ts, event_id) AS k FROM events) GROUP BY ALL)",
    "evt_h": f"evt_h AS (SELECT symbol, date, {_BARS}, count(*)::BIGINT AS volume FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS date, value AS px, (ts, event_id) AS k FROM events) GROUP BY ALL)",
}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL that may name derived bars as ctes."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            own = [CTE[c] for c in ctes]
            text = sql.strip()
            if own:
                text = "WITH " + ", ".join(own) + (", " + text[5:].lstrip() if text.upper().startswith("WITH ") else " " + text)
            ORACLE_SQL[f.__name__] = text
        return f

    return keep


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """The keys as they are, all other doubles to 6 decimals."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" and f.name not in keys else F.col(f.name) for f in df.schema])
