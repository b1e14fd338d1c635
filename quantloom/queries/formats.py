"""Filings written from the tables in their own formats, and read from these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fundamentals import holdings_by_period
from ..sources import bars
from ..sources import filing_formats as formats
from .base import query, rounded

C = F.col
_PRICE = "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 0 ELSE o_totalprice / 100 END"
_CODE = "CASE o_orderpriority WHEN '2-HIGH' THEN 'S' WHEN '4-NOT SPECIFIED' THEN 'A' ELSE 'P' END"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return bars.read_table(spark, sf, "orders").withColumn("day", C("o_orderdate").cast("date"))


@query(f"""WITH o AS (SELECT *, o_orderdate::DATE AS day FROM orders), f AS (SELECT o_custkey, year(day) AS y, max(day) + 2 AS filed_date FROM o GROUP BY 1, 2),
t AS (SELECT c_mktsegment AS symbol, filed_date, day AS transaction_date, c_name AS insider_name, CASE WHEN o.o_custkey % 2 = 0 THEN 'Director' ELSE '' END AS insider_title, {_CODE} AS transaction_type,
  CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN -1 ELSE 1 END * (o_orderkey % 1000 + 1)::DOUBLE AS shares, {_PRICE} AS price, (o_orderkey % 77)::DOUBLE AS shares_after, o_orderkey % 3 > 0 AS is_direct
  FROM o JOIN f ON f.o_custkey = o.o_custkey AND f.y = year(day) JOIN customer ON c_custkey = o.o_custkey)
SELECT symbol, filed_date, transaction_date, insider_name, insider_title, transaction_type, shares, round(price, 6) AS price, shares_after, is_direct FROM t WHERE transaction_type <> 'A' AND price > 0""")
def filings_xml_insider(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders of a year as one ownership document."""
    value = lambda c: F.struct(c.cast("string").alias("value"))
    disposed = F.when(C("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "D").otherwise("A")
    deal = F.struct(
        value(C("day")).alias("transactionDate"), F.struct(F.expr(_CODE).alias("transactionCode")).alias("transactionCoding"),
        F.struct(value(C("o_orderkey") % 1000 + 1).alias("transactionShares"), value(F.expr(_PRICE)).alias("transactionPricePerShare"), value(disposed).alias("transactionAcquiredDisposedCode")).alias("transactionAmounts"),
        F.struct(value(C("o_orderkey") % 77).alias("sharesOwnedFollowingTransaction")).alias("postTransactionAmounts"), F.struct(value(F.when(C("o_orderkey") % 3 > 0, "D").otherwise("I")).alias("directOrIndirectOwnership")).alias("ownershipNature"),
    )
    filed = _orders(spark, sf).groupBy("o_custkey", F.year("day")).agg(F.date_add(F.max("day"), 2).alias("filed_date"), F.collect_list(deal).alias("deals"))
    known = filed.join(bars.read_table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    owner = F.array(F.struct(F.struct(C("c_name").alias("rptOwnerName")).alias("reportingOwnerId"), F.struct(F.when(C("o_custkey") % 2 == 0, "Director").alias("officerTitle")).alias("reportingOwnerRelationship")))
    form = F.struct(F.struct(C("c_mktsegment").alias("issuerTradingSymbol")).alias("issuer"), owner.alias("reportingOwner"), F.struct(C("deals").alias("nonDerivativeTransaction")).alias("nonDerivativeTable"))
    documents = known.select(C("c_mktsegment").alias("symbol"), "filed_date", F.to_xml(form, {"rowTag": "ownershipDocument"}).alias("xml"))
    return rounded(formats.insider_transactions(documents))


@query("""WITH o AS (SELECT *, o_orderdate::DATE AS day FROM orders), h AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low' END AS symbol, (date_trunc('quarter', day) + INTERVAL 3 MONTH)::DATE - 1 AS report_date, o_custkey,
  o_orderkey % 1000 + 1 AS shares, floor(o_totalprice)::BIGINT AS value FROM o)
SELECT symbol, report_date, max(report_date + 45 - (o_custkey % 5)::INTEGER) AS filed_date, count(DISTINCT o_custkey)::BIGINT AS total_holders, sum(shares)::BIGINT AS total_shares, sum(value)::BIGINT AS total_value FROM h WHERE symbol IS NOT NULL GROUP BY 1, 2""")
def filings_xml_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders of a quarter as the holdings of a manager, looked through for three issuers."""
    end = F.date_sub(F.add_months(F.trunc("day", "quarter"), 3), 1)
    position = F.struct(F.concat(F.lit("The "), F.upper("o_orderpriority"), F.lit(" & Co")).alias("nameOfIssuer"), F.floor("o_totalprice").cast("string").alias("value"), F.struct((C("o_orderkey") % 1000 + 1).cast("string").alias("sshPrnamt")).alias("shrsOrPrnAmt"))
    filed = _orders(spark, sf).groupBy(C("o_custkey").alias("manager_cik"), end.alias("report_date")).agg(F.collect_list(position).alias("infoTable"))
    filed = filed.select("manager_cik", "report_date", F.date_add("report_date", 45 - (C("manager_cik") % 5).cast("int")).alias("filed_date"), F.to_xml(F.struct("infoTable"), {"rowTag": "informationTable"}).alias("xml"))
    documents = filed.select("*", F.explode(F.array(*[F.lit(s) for s in ("Urgent", "High", "Low")])).alias("symbol"))
    return holdings_by_period(formats.manager_holdings(documents), ["symbol"])


@query("""WITH o AS (SELECT o_orderkey, c_mktsegment AS symbol, o_orderdate::DATE AS day FROM orders JOIN customer ON c_custkey = o_custkey),
i AS (SELECT *, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'Item 2.02' END, CASE WHEN o_orderkey % 3 = 0 THEN '5.02' END, CASE WHEN o_orderkey % 5 = 0 THEN '4.02' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Item 1.03' END, '9.01'], lambda x: x IS NOT NULL) AS items FROM o)
SELECT symbol, o_orderkey, day AS filed_date, CASE WHEN o_orderkey % 4 = 0 THEN day ELSE day - 3 END AS event_date, array_to_string(items, '|') AS items, o_orderkey % 2 = 0 AS has_earnings, false AS has_acquisition, o_orderkey % 3 = 0 AS has_officer_change,
  o_orderkey % 5 = 0 AS has_restatement, false AS has_material_agreement, false AS has_delisting_notice, o_orderkey % 7 = 0 AS has_bankruptcy FROM i""")
def filings_items(spark: SparkSession, sf: str) -> DataFrame:
    k = C("o_orderkey")
    o = _orders(spark, sf).join(bars.read_table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    items = F.concat_ws(", ", F.when(k % 2 == 0, "Item 2.02"), F.when(k % 3 == 0, "5.02"), F.when(k % 5 == 0, "4.02"), F.when(k % 7 == 0, "Item 1.03"), F.lit("9.01"))
    # The order's key travels with the symbol, so that equal rows can be told apart.
    rows = o.select(F.concat_ws("\t", "c_mktsegment", k).alias("symbol"), C("day").alias("filed_date"), F.when(k % 4 > 0, F.date_sub("day", 3)).alias("report_date"), items.alias("items"))
    out = formats.events(rows).withColumns({"o_orderkey": F.split("symbol", "\t")[1].cast("long"), "symbol": F.split("symbol", "\t")[0], "items": F.array_join("items", "|")})
    return out


_TAGS = {"revenue": ["Revenues", "SalesRevenueNet"], "net_income": ["NetIncomeLoss", "ProfitLoss"], "total_assets": ["Assets"]}
_CONCEPT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Revenues' WHEN '2-HIGH' THEN 'SalesRevenueNet' WHEN '3-MEDIUM' THEN 'NetIncomeLoss' WHEN '4-NOT SPECIFIED' THEN 'ProfitLoss' ELSE 'Assets' END"


@query(f"""WITH f AS (SELECT o_custkey::VARCHAR AS symbol, {_CONCEPT} AS tag, o_orderdate::DATE AS period_end, o_orderdate::DATE + (o_orderkey % 40)::INTEGER AS filed_date, o_totalprice AS value, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form FROM orders),
m AS (SELECT *, CASE WHEN tag IN ('Revenues', 'SalesRevenueNet') THEN 'revenue' WHEN tag = 'Assets' THEN 'total_assets' ELSE 'net_income' END AS metric, CASE WHEN tag IN ('SalesRevenueNet', 'ProfitLoss') THEN 1 ELSE 0 END AS rank FROM f),
r AS (SELECT *, min(rank) OVER (PARTITION BY symbol, metric) AS first FROM m)
SELECT symbol, metric, period_end, arg_max(filed_date, (filed_date, value, form)) AS filed_date, round(arg_max(value, (filed_date, value, form)), 6) AS value, arg_max(form, (filed_date, value, form)) AS form FROM r WHERE rank = first AND form <> '8-K' GROUP BY 1, 2, 3""")
def facts_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as a company's facts in one JSON document, taken apart as variants."""
    fact = F.struct(C("day").cast("string").alias("end"), F.date_add("day", (C("o_orderkey") % 40).cast("int")).cast("string").alias("filed"), C("o_totalprice").alias("val"), F.when(C("o_orderstatus") == "F", "10-K").when(C("o_orderstatus") == "O", "10-Q").otherwise("8-K").alias("form"))
    concepts = _orders(spark, sf).groupBy(C("o_custkey").cast("string").alias("symbol"), F.expr(_CONCEPT).alias("concept")).agg(F.collect_list(fact).alias("facts"))
    entry = F.struct("concept", F.struct(F.struct(C("facts").alias("USD")).alias("units")).alias("about"))
    companies = concepts.groupBy("symbol").agg(F.map_from_entries(F.collect_list(entry)).alias("us-gaap"))
    documents = companies.select("symbol", F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("json"))
    return rounded(formats.financials(formats.company_facts(documents), _TAGS))
