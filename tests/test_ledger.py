import json

from ledgerloom.plans import downloads
from ledgerloom.shipping import ship

ship(__name__)
AGENT = "tests tests@example.com"


def archive(log, tickers=b"aapl\t320193\nmsft\t789019\ngoog\t1\ngoogl\t1\nbad\t7\n"):
    """A transport that writes down each URL and fails where the tests want it to."""

    def answer(url, headers):
        with open(log, "a") as f:
            f.write(url + "\n")
        if url.endswith("ticker.txt"):
            return (200, {}, tickers) if tickers is not None else (403, {}, b"")
        if url.endswith("CIK0000789019.json"):
            return 404, {}, b""
        if url.endswith("CIK0000000007.json"):
            return 200, {}, b'{"cik": 7}'
        if url.endswith(".json"):
            recent = {"accessionNumber": ["1-23-1", "1-23-2"], "form": ["10-K", "10-K"], "acceptanceDateTime": ["2023-01-02", "2023-01-03"], "primaryDocument": ["a.htm", "b.htm"]}
            return 200, {}, json.dumps({"cik": "1", "filings": {"recent": recent}}).encode()
        if "/0000320193/" in url and url.endswith("b.htm"):
            return 404, {}, b""
        return 200, {}, b"<html>Revenue</html>"

    return answer


def asked(spark, *symbols):
    return spark.createDataFrame([(s,) for s in symbols], "symbol string")


def test_status_follows_from_the_ledger_and_each_url_is_fetched_once(spark, tmp_path):
    log = str(tmp_path / "log")
    symbols = asked(spark, "AAPL", "MSFT", "NOPE", "GOOG", "GOOGL", "BAD", "GOOG")
    landed, ledger, said = downloads.download_filings(symbols, str(tmp_path), AGENT, "10-K", limit=2, transport=archive(log))
    for _ in range(2):  # reading it again fetches nothing
        got = {r.symbol: (r.ok, r.error) for r in said.collect()}
        assert landed.count() == 6 and ledger.count() == 12
    assert got == {
        "AAPL": (False, "document: not_found: status 404"), "MSFT": (False, "submissions: not_found: status 404"), "NOPE": (False, "not_found"),
        "BAD": (False, "submissions: json: no list of filings"), "GOOG": (True, None), "GOOGL": (True, None),
    }
    urls = open(log).read().split()
    assert len(urls) == len(set(urls)) == 9  # two symbols of one company share their requests
    kept = {(r.symbol, r.kind, r.status, r.attempts) for r in ledger.collect()}
    assert {(None, "tickers", 200, 1), ("MSFT", "submissions", 404, 1), ("AAPL", "document", 404, 1), ("AAPL", "document", 200, 1)} <= kept
    downloads.discard(landed)
    assert not any((tmp_path / "landed").iterdir()) and ledger.count() == 12


def test_a_ticker_map_that_fails_is_told_of_every_symbol(spark, tmp_path):
    said = downloads.download_filings(asked(spark, "AAPL", "NOPE"), str(tmp_path), AGENT, transport=archive(str(tmp_path / "log"), None))[2]
    assert {r.symbol: (r.ok, r.error) for r in said.collect()} == dict.fromkeys(("AAPL", "NOPE"), (False, "tickers: invalid_response: status 403"))
    none = downloads.download_filings(asked(spark, "AAPL").limit(0), str(tmp_path), AGENT, transport=archive(str(tmp_path / "log")))
    assert none[2].count() == 0 and none[0].count() == 0


def test_attempts_are_counted(spark, tmp_path):
    count = str(tmp_path / "n")

    def shaky(url, headers):
        with open(count, "a+") as f:
            f.write("x")
            f.seek(0)
            n = len(f.read())
        if n < 3:
            raise OSError("reset")
        return 200, {}, b"hi"

    from ledgerloom.sources.http import fetch

    row = fetch(spark.createDataFrame([("https://sec.gov/a",)], "url string"), AGENT, transport=shaky).first()
    assert (row.text, row.status, row.attempts, row.error) == ("hi", 200, 3, None)
