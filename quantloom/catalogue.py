"""All registered queries over the supplied tables, with the SQL that each must equal."""

from __future__ import annotations

from .queries import analytics, base, enrichment, execution, formats, grids, indicators, loading, market, signals, simulation, streams, summaries

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
FLAGSHIP = "vec_backtest_sma"
MODULES = [market, indicators, signals, analytics, enrichment, summaries, execution, streams, loading, formats, grids, simulation]
