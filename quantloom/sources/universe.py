"""Index constituents from tables in HTML files, kept as snapshots that are used while they are young."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .filing_formats import read_documents

C = F.col
TTL = dt.timedelta(days=7)
SNAPSHOTS = "key string, loaded_at timestamp_ntz, symbols array<string>"
# The indices of each market.
MARKETS = {"us": ["us_index"], "ca": ["ca_index"], "us_ca": ["us_index", "ca_index"]}


def _text(cell: Column) -> Column:
    """A cell's text without tags, with the character references that tickers have."""
    plain = F.regexp_replace(cell, r"(?s)<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def constituents(pages: DataFrame, header: str = "Symbol") -> DataFrame:
    """key, symbols of pages (key, html): the column named so, else the first one, of the page's first table, sorted.

    US tickers have a hyphen for a dot, Canadian ones end in .TO. Pages without a table with rows give no row."""
    cells = lambda row, tag: F.transform(F.regexp_extract_all(row, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), _text)
    table = F.regexp_extract("html", r"(?is)<table\b[^>]*>(.*?)</table\s*>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    parsed = pages.select("key", rows.alias("rows")).where(F.size("rows") > 0)
    parsed = parsed.withColumn("head", cells(F.get("rows", F.lit(0)), "t[dh]"))
    place = F.greatest(F.array_position("head", header), F.lit(1)).cast("int")
    listed = F.transform("rows", lambda r: F.get(cells(r, "td"), place - 1))
    named = parsed.select("key", F.array_sort(F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & (x != "") & (x != header)))).alias("symbols"))
    suffixed = F.transform("symbols", lambda s: F.when(F.endswith(s, F.lit(".TO")), s).otherwise(F.concat(s, F.lit(".TO"))))
    dashed = F.transform("symbols", lambda s: F.replace(s, F.lit("."), F.lit("-")))
    return named.select("key", F.when(C("key") == "ca_index", suffixed).when(C("key") == "us_index", dashed).otherwise(C("symbols")).alias("symbols")).where(F.size("symbols") > 0)


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """constituents of whole files in folders key=..."""
    return constituents(read_documents(spark, path, "html"))


def states(keys: DataFrame, snapshots: DataFrame, now: dt.datetime, ttl: dt.timedelta = TTL) -> DataFrame:
    """Each key with its snapshot as of now, the last one loaded by then, and its state: fresh, expired or missing."""
    last = snapshots.where(C("loaded_at") <= F.lit(now)).groupBy("key").agg(F.max(F.struct("loaded_at", "symbols")).alias("s"))
    state = F.when(C("s").isNull(), "missing").when(C("s.loaded_at") >= F.lit(now - ttl), "fresh").otherwise("expired")
    return keys.select("key").distinct().join(last, "key", "left").select("key", "s.loaded_at", "s.symbols", state.alias("state"))


def refresh(spark: SparkSession, keys: DataFrame, snapshots: DataFrame, fetch, now: dt.datetime, ttl: dt.timedelta = TTL) -> tuple[DataFrame, DataFrame]:
    """(universes, new snapshots). A fresh snapshot is used as it is; for the keys of others `fetch` (a list of keys to a
    frame of key, symbols) is asked once, and what it has is a new snapshot as of now; what it lacks falls back on the
    expired one. universes: key, symbols, loaded_at, state (fresh, fetched, stale or missing, then without symbols)."""
    now = now.replace(tzinfo=None)
    held = materialise(states(keys, snapshots, now, ttl), "universes")
    wanted = [r.key for r in held.where("state <> 'fresh'").collect()]  # a name for each page to load
    found = fetch(wanted).select("key", "symbols") if wanted else spark.createDataFrame([], "key string, symbols array<string>")
    found = materialise(found.where(C("key").isin(wanted)).withColumn("loaded_at", F.lit(now)).select("key", "loaded_at", "symbols"), "fetched-universes")
    new = found.select("key", C("loaded_at").alias("_at"), C("symbols").alias("_symbols"))
    both = held.join(new, "key", "left")
    state = F.when(C("_at").isNotNull(), "fetched").when(C("state") == "expired", "stale").otherwise(C("state"))
    return both.select("key", F.coalesce("_symbols", "symbols").alias("symbols"), F.coalesce("_at", "loaded_at").alias("loaded_at"), state.alias("state")), found


def tickers(universes: DataFrame, market: str) -> DataFrame:
    """The distinct symbols of a market's indices; an index without any is an error."""
    if market not in MARKETS:
        raise ValueError(f"unknown market {market!r}, not one of {sorted(MARKETS)}")
    own = universes.where(C("key").isin(MARKETS[market]))
    known = {r.key for r in own.where("symbols IS NOT NULL").select("key").collect()}
    if set(MARKETS[market]) - known:
        raise ValueError(f"no constituents of {sorted(set(MARKETS[market]) - known)}")
    return own.select(F.explode("symbols").alias("symbol")).distinct()
