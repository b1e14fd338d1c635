"""Filings in their own formats, odd ones among them."""

import datetime as dt

from pyspark.sql import functions as F

from quantloom.sources import filing_formats as formats
from quantloom.sources import filings

D = dt.date(2024, 3, 5)


def deal(code, shares, price, disposed="A", day="2024-03-01", direct="D"):
    v = lambda x: f"<value>{x}</value>"
    return f"""<nonDerivativeTransaction><transactionDate>{v(day)}</transactionDate><transactionCoding><transactionFormType>4</transactionFormType><transactionCode>{code}</transactionCode></transactionCoding>
    <transactionAmounts><transactionShares>{v(shares)}</transactionShares><transactionPricePerShare>{v(price) if price is not None else '<footnoteId id="F1"/>'}</transactionPricePerShare><transactionAcquiredDisposedCode>{v(disposed)}</transactionAcquiredDisposedCode></transactionAmounts>
    <postTransactionAmounts><sharesOwnedFollowingTransaction>{v(900)}</sharesOwnedFollowingTransaction></postTransactionAmounts><ownershipNature><directOrIndirectOwnership>{v(direct)}</directOrIndirectOwnership></ownershipNature></nonDerivativeTransaction>"""


def ownership(*deals, title="<officerTitle>CEO &amp; Chair</officerTitle>"):
    return f"""<?xml version="1.0"?><ownershipDocument><issuer><issuerTradingSymbol>ABC</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Doe J</rptOwnerName></reportingOwnerId>
    <reportingOwnerRelationship>{title}</reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{"".join(deals)}</nonDerivativeTable></ownershipDocument>"""


def test_ownership_documents(spark):
    rows = [
        ("ABC", D, ownership(deal("P", 10, 2.5), deal("S", 20, 3), deal("P", 5, 4, "D", direct="I"), deal("A", 7, 1), deal("P", 8, 0), deal("P", 8, None), deal("P", "many", 2, day="no day"))),
        ("ABC", D, ownership(deal("S", -30, 1.5), title="<isDirector>1</isDirector>")), ("ABC", D, ownership()), ("ABC", D, "no xml <"), ("ABC", D, None), ("ABC", D, ""),
    ]
    got = formats.insider_transactions(spark.createDataFrame(rows, "symbol string, filed_date date, xml string")).collect()
    short = sorted((r.transaction_type, r.shares, r.price, r.transaction_date, r.insider_title, r.is_direct, r.shares_after) for r in got)
    first = dt.date(2024, 3, 1)
    assert short == sorted([("P", 10.0, 2.5, first, "CEO & Chair", True, 900.0), ("S", -20.0, 3.0, first, "CEO & Chair", True, 900.0), ("P", -5.0, 4.0, first, "CEO & Chair", False, 900.0), ("P", 0.0, 2.0, D, "CEO & Chair", True, 900.0), ("S", -30.0, 1.5, first, "", True, 900.0)])


def test_holdings_documents(spark):
    table = '<ns1:informationTable xmlns:ns1="urn:x"><ns1:infoTable><ns1:nameOfIssuer>Acme ABC Corp</ns1:nameOfIssuer><ns1:value>5</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>100</ns1:sshPrnamt></ns1:shrsOrPrnAmt></ns1:infoTable>'
    table += "<ns1:infoTable><ns1:nameOfIssuer>abc second</ns1:nameOfIssuer><ns1:value>7</ns1:value></ns1:infoTable><ns1:infoTable><ns1:nameOfIssuer>Other</ns1:nameOfIssuer><ns1:value>9</ns1:value></ns1:infoTable></ns1:informationTable>"
    rows = [("ABC", D, D, 1, table), ("zzz", D, D, 1, table), ("ABC", D, D, 2, None)]
    got = formats.manager_holdings(spark.createDataFrame(rows, "symbol string, report_date date, filed_date date, manager_cik long, xml string")).collect()
    assert [(r.symbol, r.manager_cik, r.shares_held, r.value_held) for r in got] == [("ABC", 1, 100, 12)]


def test_items(spark):
    rows = [("A", D, None, " Item 2.02 ,5.02,"), ("B", D, dt.date(2024, 3, 1), "9.99"), ("C", D, None, None)]
    got = {r.symbol: r for r in formats.events(spark.createDataFrame(rows, "symbol string, filed_date date, report_date date, items string")).collect()}
    assert got["A"].items == ["Item 2.02", "5.02"] and got["A"].has_earnings and got["A"].has_officer_change and not got["A"].has_bankruptcy and got["A"].event_date == D
    assert got["B"].event_date == dt.date(2024, 3, 1) and not got["B"].has_earnings and got["C"].items == []


def test_company_facts(spark):
    fact = lambda end, val, filed, form="10-K": f'{{"end": "{end}", "val": {val}, "filed": "{filed}", "form": "{form}", "fy": 2023}}'
    a = f'{{"cik": 1, "facts": {{"dei": {{"Shares": {{"units": {{"shares": [{fact("2023-12-31", 9, "2024-02-01")}]}}}}}}, "us-gaap": {{"Revenues": {{"label": "x", "units": {{"USD": [{fact("2023-12-31", 1.5, "2024-02-01")}, {fact("2023-12-31", 2.5, "2024-03-01")}, {fact("2023-09-30", 3, "2023-11-01", "8-K")}, {fact("bad", 4, "2023-11-01")}]}}}}, "Sales": {{"units": {{"USD": [{fact("2022-12-31", 8, "2023-02-01")}]}}}}}}}}}}'
    rows = [("A", a), ("B", f'{{"facts": {{"us-gaap": {{"Revenues": {{"units": {{"USD": []}}}}, "Sales": {{"units": {{"USD": [{fact("2022-12-31", 8, "2023-02-01", "10-Q")}]}}}}}}}}}}'), ("C", "{}"), ("D", "no json"), ("E", None)]
    facts = formats.company_facts(spark.createDataFrame(rows, "symbol string, json string"))
    assert facts.count() == 7 and {r.concept for r in facts.collect()} == {"dei:Shares", "us-gaap:Revenues", "us-gaap:Sales"}
    got = sorted((r.symbol, r.metric, r.period_end, r.value, r.form) for r in formats.financials(facts, {"revenue": ["Revenues", "Sales"]}).collect())
    assert got == [("A", "revenue", dt.date(2023, 12, 31), 2.5, "10-K"), ("B", "revenue", dt.date(2022, 12, 31), 8.0, "10-Q")]


def test_documents_from_files(spark, tmp_path):
    for i, symbol in enumerate("AB"):
        folder = tmp_path / f"symbol={symbol}" / "filed_date=2024-03-05"
        folder.mkdir(parents=True)
        (folder / f"{i}.xml").write_text(ownership(deal("P", 10 + i, 2)))
    got = formats.insider_transactions(formats.read_documents(spark, str(tmp_path))).collect()
    assert sorted((r.symbol, r.filed_date, r.shares) for r in got) == [("A", D, 10.0), ("B", D, 11.0)]


def test_a_filing_without_date_replaces_no_dated_one(spark):
    schema = "symbol string, metric string, period_end date, filed_date date, value double"
    old = spark.createDataFrame([("A", "m", D, D, 1.0), ("B", "m", D, None, 2.0), (None, "m", None, D, 5.0)], schema)
    new = spark.createDataFrame([("A", "m", D, D, 3.0), ("A", "m", D, None, 4.0), ("B", "m", D, None, 6.0), (None, "m", None, None, 7.0)], schema)
    got = {r.symbol: r.value for r in filings.merged(old, new, "financials").collect()}
    assert got == {"A": 3.0, "B": 6.0, None: 7.0}
    both = filings.merged(None, new.unionByName(old), "financials").where(F.col("symbol") == "A").first()
    assert (both.filed_date, both.value) == (D, 1.0)
