"""Cache-first loading and universes by snapshot."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import bars, readthrough, universe
from .base import query, rounded

C = F.col

_CAL = "cal AS (SELECT *, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT unnest(generate_series(DATE '1994-03-01', DATE '1997-10-31', INTERVAL 1 DAY))::DATE AS date) WHERE isodow(date) < 6)"
_FILL = "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"


def _filled_sql(name: str, source: str) -> str:
    """Bars of a source on every session of cal between the first and last of them."""
    return f"""{name}_s AS (SELECT symbol, min(date) AS f, max(date) AS l FROM {source} JOIN cal USING (date) GROUP BY symbol),
{name} AS (SELECT * FROM (SELECT s.symbol, c.date, last_value(b.close IGNORE NULLS) OVER w AS close, last_value(b.volume IGNORE NULLS) OVER w AS volume FROM {name}_s s JOIN cal c ON c.date BETWEEN f AND l LEFT JOIN {source} b ON b.symbol = s.symbol AND b.date = c.date
  WINDOW w AS (PARTITION BY s.symbol ORDER BY c.date {_FILL})) WHERE close IS NOT NULL)"""


@query(f"""WITH {_CAL}, up AS (SELECT upper(symbol) AS symbol, date, close, volume FROM brand),
kept AS (SELECT symbol, date, close, volume + 1000 AS volume FROM up WHERE symbol < 'BRAND#3' OR symbol < 'BRAND#5' AND day(date) <= 12),
c AS (SELECT symbol, count(*) AS m, any_value(f) AS f, any_value(l) AS l FROM (SELECT k.symbol, a.date, max(k.close IS NOT NULL) OVER (PARTITION BY s.symbol ORDER BY a.date {_FILL}) AS held, s.f, s.l, s.symbol
  FROM (SELECT symbol, min(date) AS f, max(date) AS l FROM kept GROUP BY symbol) s CROSS JOIN cal a LEFT JOIN kept k ON k.symbol = s.symbol AND k.date = a.date) t(ks, date, held, f, l, symbol) WHERE held GROUP BY symbol),
fresh AS (SELECT symbol FROM c WHERE f <= (SELECT min(date) FROM cal) AND l >= (SELECT max(date) FROM cal) AND m >= 0.9 * (SELECT max(n) FROM cal)),
used AS (SELECT * FROM kept WHERE symbol IN (FROM fresh) UNION ALL SELECT * FROM up WHERE symbol NOT IN (FROM fresh) AND date BETWEEN DATE '1994-03-01' AND DATE '1997-10-31'),
{_filled_sql('x', 'used')}
SELECT symbol, date, round(close, 6) AS close, volume::DOUBLE AS volume FROM x""", "brand")
def cache_first_load(spark: SparkSession, sf: str) -> DataFrame:
    """Some brands are cached whole, some in part, some not at all; cached volumes are marked by 1000 more."""
    b, path = bars.brand_bars(spark, sf).withColumn("symbol", F.upper("symbol")), shared_dir(spark, "read-through")
    bars.write_cache(b, f"{path}/source")
    held = b.where("symbol < 'BRAND#3' OR symbol < 'BRAND#5' AND day(date) <= 12").withColumn("volume", (C("volume") + 1000).cast("double"))
    bars.write_cache(held, f"{path}/cache")
    sessions = bars.weekdays(spark, "1994-01-01", "2002-12-31")
    out = readthrough.load(spark, b.select("symbol").distinct(), "1994-03-01", "1997-10-31", f"{path}/cache", sessions, readthrough.source(spark, f"{path}/source"))
    return rounded(out.select("symbol", "date", "close", "volume"))


_SEGMENTS = "seg AS (SELECT c_mktsegment AS key, 'N' || c_nationkey AS symbol, c_acctbal FROM customer)"


@query(f"""WITH {_SEGMENTS}, snap AS (SELECT key, list_sort(list(DISTINCT symbol)) AS symbols, CASE key WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 7 WHEN 'MACHINERY' THEN 30 ELSE 8 END AS age FROM seg WHERE c_acctbal < 0 AND key <> 'HOUSEHOLD' GROUP BY key),
page AS (SELECT key, list_sort(list(DISTINCT symbol)) AS symbols FROM seg WHERE c_acctbal > 5000 AND key <> 'MACHINERY' GROUP BY key),
u AS (SELECT k.key, s.age, CASE WHEN age <= 7 THEN 'fresh' WHEN p.key IS NOT NULL THEN 'fetched' WHEN age IS NOT NULL THEN 'stale' ELSE 'missing' END AS state, CASE WHEN age <= 7 OR p.key IS NULL THEN s.symbols ELSE p.symbols END AS symbols
  FROM (SELECT DISTINCT key FROM seg) k LEFT JOIN snap s USING (key) LEFT JOIN page p USING (key))
SELECT key, state, CASE state WHEN 'fetched' THEN TIMESTAMP '2024-03-31' ELSE TIMESTAMP '2024-03-31' - to_days(age) END AS loaded_at, array_to_string(symbols, ' ') AS symbols FROM u""")
def universe_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as indices of nations: snapshots of some days, pages of four of the five segments to load from."""
    c = bars.read_table(spark, sf, "customer").select(C("c_mktsegment").alias("key"), F.concat(F.lit("N"), "c_nationkey").alias("symbol"), "c_acctbal")
    now = dt.datetime(2024, 3, 31)
    age = F.when(C("key") == "AUTOMOBILE", 3).when(C("key") == "BUILDING", 7).when(C("key") == "MACHINERY", 30).otherwise(8)
    held = c.where("c_acctbal < 0 AND key <> 'HOUSEHOLD'").groupBy("key").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    held = held.select("key", F.date_sub(F.lit(now.date()), age).cast("timestamp_ntz").alias("loaded_at"), "symbols")
    cells = F.concat(F.lit("<tr><td>"), C("symbol"), F.lit("</td><td>of</td></tr>"))
    page = c.where("c_acctbal > 5000 AND key <> 'MACHINERY'").groupBy("key").agg(F.concat_ws("", F.collect_set(cells)).alias("rows"))
    html = F.concat(F.lit("<html><table class='x'><tr><th><b>Symbol</b></th><th>Name</th></tr>"), "rows", F.lit("</table><table><tr><td>no</td></tr></table></html>"))
    pages = page.select("key", html.alias("html"))
    out, _ = universe.refresh(spark, c, held, lambda keys: universe.constituents(pages.where(C("key").isin(keys))), now)
    return out.select("key", "state", "loaded_at", F.array_join("symbols", " ").alias("symbols"))
