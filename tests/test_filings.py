import json
from datetime import datetime

import pytest

from ledgerloom.operators import filings as m
from ledgerloom.sources import files


def company(spark, recent, cik="320193"):
    body = json.dumps({"cik": cik, "name": "N", "filings": {"recent": recent}, "unknown": 1})
    return m.explode_recent(files.submissions_from(spark.createDataFrame([(body,)], "body string")))


def test_explode_and_complete(spark):
    rows = company(spark, {
        "accessionNumber": ["0000320193-23-000106", "a2", "a3", "a4"], "form": ["10-K", "", "8-K"], "primaryDocument": ["aapl-20230930.htm", "x", "y", "z"],
        "acceptanceDateTime": ["2023-11-03T00:00:00.000Z", "2023-01-01", "bad", "2023-01-01"], "isXBRL": [1, 0], "size": [5],
    })
    assert rows.count() == 4
    got = m.complete(rows).collect()
    assert [(r.cik, r.accession_number, r.form_type, r.acceptance_date, r.primary_document, r.is_xbrl, r["size"]) for r in got] == [
        ("320193", "0000320193-23-000106", "10-K", datetime(2023, 11, 3), "aapl-20230930.htm", True, 5)
    ]


def test_only_accession_numbers(spark):
    rows = company(spark, {"accessionNumber": ["a", "b"]})
    assert [(r.pos, r.form_type, r.is_xbrl) for r in rows.collect()] == [(0, None, False), (1, None, False)]
    assert m.complete(rows).count() == 0
    assert m.with_xbrl(company(spark, {"accessionNumber": ["a"], "isXRBL": [1]})).count() == 1


@pytest.fixture
def two(spark):
    rows = [("123", "0001-23-001", "10-K", datetime(2023, 1, 1), "doc.xml", True), ("123", "0001-23-002", "10-Q", datetime(2023, 4, 1, 23), "doc2.xml", True)]
    return spark.createDataFrame(rows, "cik string, accession_number string, form_type string, acceptance_date timestamp, primary_document string, is_xbrl boolean")


def test_filters_and_urls(two):
    assert [r.accession_number for r in m.by_form(two, "10-K").collect()] == ["0001-23-001"]
    assert m.by_form(two, "10-k").count() == 0
    assert m.in_dates(two, "2023-01-01", "2023-04-01").count() == 2
    assert m.in_dates(two, "2023-01-02", None).count() == 1
    assert [r.accession_number for r in m.latest(two, 1).collect()] == ["0001-23-002"]
    assert m.latest(two, 0).count() == m.latest(two, None).count() == 2
    r = m.with_urls(two).orderBy("accession_number").first()
    assert r.base_url == "https://www.sec.gov/Archives/edgar/data/123/000123001/"
    assert r.document_url == r.base_url + "doc.xml" and r.submission_url == r.base_url + "0001-23-001.txt"


def test_form_filter_reaches_the_scan(spark, tmp_path, two):
    two.write.parquet(f"{tmp_path}/f")
    plan = m.by_form(spark.read.parquet(f"{tmp_path}/f"), "10-K")._jdf.queryExecution().toString()
    assert "EqualTo(form_type,10-K)" in plan


def test_tickers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("aapl\t320193\n\nbad\nx\ty\tz\nmsft\tnone\ndup\t1\nDUP\t2\nbig\t18446744073709551615\nover\t18446744073709551616\nneg\t-5\n")
    known = files.ticker_map(spark, str(tmp_path / "t.txt"))
    assert {tuple(r) for r in known.collect()} == {("AAPL", "0000320193"), ("DUP", "0000000002"), ("BIG", "18446744073709551615")}
    assert m.lookup_ticker(spark, " aapl ", known) == "0000320193"
    with pytest.raises(ValueError, match="not found"):
        m.lookup_ticker(spark, "nope", known)
    assert [tuple(r) for r in m.batch_lookup(spark, ["Dup", "nope", "AAPL", "dup"], known).collect()] == [(0, "DUP", "0000000002"), (2, "AAPL", "0000320193"), (3, "DUP", "0000000002")]
    (tmp_path / "e.txt").write_text("\n")
    with pytest.raises(ValueError, match="no tickers"):
        files.ticker_map(spark, str(tmp_path / "e.txt"))


def test_company_facts(spark):
    df = spark.createDataFrame([('{"cik": 7, "entityName": "E", "facts": {"us-gaap": {"a": 1}, "dei": {}}}',), ("broken",)], "body string")
    got = files.company_facts(df).select("cik", "entity_name", "taxonomy").collect()
    assert {tuple(r) for r in got} == {(7, "E", "us-gaap"), (7, "E", "dei")}
