import gzip
import json
import os
from datetime import date

import pytest

from ledgerloom.plans import cli, downloads
from ledgerloom.shipping import ship

ship(__name__)
AGENT = "tests tests@example.com"


def transport(url, headers):
    if url.endswith("ticker.txt"):
        return 200, {}, b"aapl\t320193\nmsft\t789019\nold\tx\n"
    if "/submissions/CIK0000320193.json" in url:
        recent = {
            "accessionNumber": ["0000320193-23-000106", "0000320193-22-000108", "0000320193-23-000077"],
            "form": ["10-K", "10-K", "10-Q"],
            "acceptanceDateTime": ["2023-11-03T18:30:00.000Z", "2022-10-28T18:01:00.000Z", "2023-08-04T12:00:00.000Z"],
            "primaryDocument": ["a.htm", "b.htm", "c.htm"],
        }
        return 200, {"content-encoding": "gzip"}, gzip.compress(json.dumps({"cik": "320193", "filings": {"recent": recent}}).encode())
    if url.endswith(".json"):
        return 404, {}, b""
    if url.endswith("b.htm"):
        return 404, {}, b""
    return 200, {}, f"<html><body>Revenue rose in {url[-5:]}.</body></html>".encode()


@pytest.fixture
def filings(spark):
    ciks = spark.createDataFrame([("320193",), ("789019",)], "cik string")
    return downloads.company_filings(ciks, AGENT, transport=transport)


def test_choose_and_land(spark, filings, tmp_path):
    assert {r.accession_number[-6:] for r in downloads.choose(filings, "10-K").collect()} == {"000106", "000108"}
    dated = downloads.choose(filings, None, date(2023, 8, 4), date(2023, 11, 3))
    assert {r.primary_document for r in dated.collect()} == {"a.htm", "c.htm"}
    assert [r.primary_document for r in downloads.choose(filings, None, limit=1).collect()] == ["a.htm"]
    landed = downloads.land(downloads.choose(filings, "10-K"), str(tmp_path), AGENT, transport=transport)
    got = {r.primary_document: (r.url, r.text, r.error) for r in landed.collect()}
    assert got["a.htm"] == ("https://www.sec.gov/Archives/edgar/data/0000320193/000032019323000106/a.htm", "<html><body>Revenue rose in a.htm.</body></html>", None)
    assert got["b.htm"][1] is None and got["b.htm"][2].startswith("not_found")
    assert [(r.fetched, r.failed) for r in downloads.status(landed).collect()] == [(1, 1)]
    assert [r.document for r in downloads.as_files(landed).collect()] == ["a.htm"]
    whole = downloads.land(filings, str(tmp_path), AGENT, "submission", transport=transport)
    assert all(r.url.endswith(f"{r.accession_number}.txt") for r in whole.collect())
    downloads.discard(landed)
    assert len(os.listdir(tmp_path / "landed")) == 1 and whole.count() == 3
    with pytest.raises(ValueError, match="document or submission"):
        downloads.land(filings, str(tmp_path), AGENT, "other")


def test_unknown_companies_are_rows(spark):
    ciks = spark.createDataFrame([("789019",)], "cik string")
    row = downloads.fetch_submissions(ciks, AGENT, transport=transport).first()
    assert row.asked == "789019" and row.error.startswith("not_found")
    assert downloads.fetch_facts(ciks, AGENT, transport=transport).count() == 0


def test_command_line_fetches_by_date_and_uses_the_prompt(spark, tmp_path):
    prompt = tmp_path / "p.yml"
    prompt.write_text("template: |\n  Company: {symbol}\n  Topic: {search_term}\n\n  Part:\n  Revenue by prompt. {chunk}\n")
    keep = tmp_path / "in" / "sec-edgar-filings" / "own.html"
    keep.parent.mkdir(parents=True)
    keep.write_text("mine")
    args = ["AAPL", "NOPE", "--fetch", "--limit", "5", "--start_date", "2023-01-01", "--end_date", "2023-12-31", "--prompt_file", str(prompt), "--downloads", str(tmp_path / "in"), "--output", str(tmp_path / "out")]
    rows = cli.main(args, spark, transport)
    assert sorted((r[0], r[1], r[3]) for r in rows) == [("AAPL", True, 1), ("NOPE", False, 0)]
    made = [json.loads(p.read_text()) for p in (tmp_path / "out/summaries").glob("aapl*.json")]
    assert [m["summaries"][0]["summary"] for m in made] == ["Revenue by prompt."]
    assert keep.exists() and not os.listdir(tmp_path / "in" / "landed")
