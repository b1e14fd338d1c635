"""Filings in their own formats: ownership and holdings documents in XML, item codes, company facts in nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col

# Names of elements and attributes of the formats, transaction codes that count, items by event.
_VALUE = "STRUCT<value: STRING>"
OWNERSHIP = f"""periodOfReport STRING, issuer STRUCT<issuerTradingSymbol: STRING>,
reportingOwner ARRAY<STRUCT<reportingOwnerId: STRUCT<rptOwnerName: STRING>, reportingOwnerRelationship: STRUCT<officerTitle: STRING>>>,
nonDerivativeTable STRUCT<nonDerivativeTransaction: ARRAY<STRUCT<transactionDate: {_VALUE}, transactionCoding: STRUCT<transactionCode: STRING>,
transactionAmounts: STRUCT<transactionShares: {_VALUE}, transactionPricePerShare: {_VALUE}, transactionAcquiredDisposedCode: {_VALUE}>,
postTransactionAmounts: STRUCT<sharesOwnedFollowingTransaction: {_VALUE}>, ownershipNature: STRUCT<directOrIndirectOwnership: {_VALUE}>>>>"""
HOLDINGS = "infoTable ARRAY<STRUCT<nameOfIssuer: STRING, value: STRING, shrsOrPrnAmt: STRUCT<sshPrnamt: STRING>>>"
CODES = ("P", "S")
ITEMS = {"2.02": "earnings", "2.01": "acquisition", "5.02": "officer_change", "4.02": "restatement", "1.01": "material_agreement", "3.01": "delisting", "1.02": "bankruptcy", "1.03": "bankruptcy"}
FLAGS = {"has_earnings": "earnings", "has_acquisition": "acquisition", "has_officer_change": "officer_change", "has_restatement": "restatement", "has_material_agreement": "material_agreement", "has_delisting_notice": "delisting", "has_bankruptcy": "bankruptcy"}
PERIODIC = ("10-Q", "10-K")

_XML = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


def read_documents(spark: SparkSession, path: str, column: str = "xml") -> DataFrame:
    """Whole files as one column, with the columns of symbol=, filed_date= and other such folders around them."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", column)


def _number(c: str) -> Column:
    """0 for what is missing or no number."""
    return F.coalesce(F.expr(f"try_cast(trim({c}) as double)"), F.lit(0.0))


def insider_transactions(documents: DataFrame) -> DataFrame:
    """Open-market purchases and sales in ownership documents (symbol, filed_date, xml): symbol, filed_date,
    transaction_date, insider_name, insider_title, transaction_type, shares, price, shares_after, is_direct.

    Sales and whatever is disposed of count below 0; without a price it was no purchase; a transaction without a date
    is dated as filed; the first of several owners is named. Documents that are no XML give no row."""
    parsed = documents.select("symbol", "filed_date", F.from_xml("xml", OWNERSHIP, _XML).alias("d"))
    owner = F.get("d.reportingOwner", F.lit(0))
    rows = parsed.select("symbol", "filed_date", owner.alias("o"), F.explode("d.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    shares = F.abs(_number("t.transactionAmounts.transactionShares.value"))
    code, disposed = F.trim("t.transactionCoding.transactionCode"), F.trim("t.transactionAmounts.transactionAcquiredDisposedCode.value")
    out = rows.select(
        "symbol", "filed_date", F.coalesce(F.expr("try_cast(trim(t.transactionDate.value) as date)"), "filed_date").alias("transaction_date"),
        F.coalesce("o.reportingOwnerId.rptOwnerName", F.lit("")).alias("insider_name"), F.coalesce("o.reportingOwnerRelationship.officerTitle", F.lit("")).alias("insider_title"), code.alias("transaction_type"),
        F.when((code == "S") | F.coalesce(disposed == "D", F.lit(False)), -shares).otherwise(shares).alias("shares"), _number("t.transactionAmounts.transactionPricePerShare.value").alias("price"),
        _number("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("shares_after"), (F.coalesce(F.trim("t.ownershipNature.directOrIndirectOwnership.value"), F.lit("D")) == "D").alias("is_direct"),
    )
    return out.where(C("transaction_type").isin(*CODES) & (C("price") != 0))


def manager_holdings(documents: DataFrame) -> DataFrame:
    """Of holdings documents (symbol, report_date, filed_date, manager_cik, xml) what each manager holds of the symbol:
    the positions whose issuer's name has the symbol in it, whatever the case, summed. No such position, no row."""
    rows = documents.select("symbol", "report_date", "filed_date", "manager_cik", F.explode(F.from_xml("xml", HOLDINGS, _XML)["infoTable"]).alias("t"))
    own = rows.where(F.contains(F.lower("t.nameOfIssuer"), F.lower("symbol")))
    return own.groupBy("symbol", "report_date", "filed_date", "manager_cik").agg(F.sum(_number("t.shrsOrPrnAmt.sshPrnamt")).cast("long").alias("shares_held"), F.sum(_number("t.value")).cast("long").alias("value_held"))


def events(rows: DataFrame) -> DataFrame:
    """Current reports (symbol, filed_date, report_date, items: codes with commas between, `Item ` before them or not) with the
    codes as a list and a flag for each kind of event. Without a report date it is the day of filing."""
    codes = F.filter(F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    kinds = F.create_map(*[F.lit(x) for pair in ITEMS.items() for x in pair])
    of = F.transform(codes, lambda x: F.coalesce(F.try_element_at(kinds, F.trim(F.replace(x, F.lit("Item"), F.lit("")))), F.lit("")))
    out = rows.select("symbol", "filed_date", F.coalesce("report_date", "filed_date").alias("event_date"), codes.alias("items"), of.alias("_kinds"))
    return out.select("symbol", "filed_date", "event_date", "items", *[F.array_contains("_kinds", kind).alias(flag) for flag, kind in FLAGS.items()])


def company_facts(documents: DataFrame) -> DataFrame:
    """All facts of company documents (symbol, json), nested as taxonomy, concept, unit and list of facts: symbol, concept
    with the taxonomy before it, unit, period_end, filed_date, value, form. What is no JSON gives no row."""
    sql = """
    SELECT symbol, concat(taxonomy.key, ':', concept.key) AS concept, unit.key AS unit, try_cast(try_variant_get(fact.value, '$.end', 'string') AS date) AS period_end,
      try_cast(try_variant_get(fact.value, '$.filed', 'string') AS date) AS filed_date, try_variant_get(fact.value, '$.val', 'double') AS value, try_variant_get(fact.value, '$.form', 'string') AS form
    FROM (SELECT symbol, try_variant_get(try_parse_json(json), '$.facts', 'variant') AS facts FROM {documents}),
      LATERAL variant_explode(facts) AS taxonomy, LATERAL variant_explode(taxonomy.value) AS concept,
      LATERAL variant_explode(try_variant_get(concept.value, '$.units', 'variant')) AS unit, LATERAL variant_explode(unit.value) AS fact"""
    return documents.sparkSession.sql(sql, documents=documents)


def financials(facts: DataFrame, tags: dict[str, list[str]]) -> DataFrame:
    """symbol, metric, period_end, filed_date, value, form: for each metric the facts of the first of its tags that the
    company has a value of, from periodic reports alone, of one period the one filed last (then the largest)."""
    spark = facts.sparkSession
    named = [(metric, tag, rank) for metric, own in tags.items() for rank, tag in enumerate(own)]
    known = spark.createDataFrame(named, "metric string, tag string, rank int")
    rows = facts.where("period_end IS NOT NULL AND value IS NOT NULL").withColumn("tag", F.regexp_replace("concept", "^[^:]*:", "")).join(F.broadcast(known), "tag")
    first = rows.withColumn("_first", F.min("rank").over(Window.partitionBy("symbol", "metric"))).where("rank = _first").where(C("form").isin(*PERIODIC))
    last = F.max(F.struct("filed_date", "value", "form")).alias("r")
    return first.groupBy("symbol", "metric", "period_end").agg(last).select("symbol", "metric", "period_end", "r.filed_date", "r.value", "r.form")
