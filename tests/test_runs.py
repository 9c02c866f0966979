import json
import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import RunConfig, Settings, check_user_agent, form_of
from ledgerloom.operators.collection import manifest, read_collection, upsert
from ledgerloom.plans import cli
from ledgerloom.plans.pipeline import run
from ledgerloom.sources import files
from ledgerloom.streaming.incremental import summarize_stream


@pytest.fixture
def tree(tmp_path):
    def put(symbol, accession, body, form="10-K", name="primary-document.html", age=0):
        path = tmp_path / "in" / files.TREE / symbol / form / accession / name
        path.parent.mkdir(parents=True)
        path.write_text(body)
        os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))

    put("AAPL", "0001", "<html><body>Revenue rose. Costs fell.</body></html>", age=50)
    put("AAPL", "0002", "<html><body>Revenue fell.</body></html>")
    put("AAPL", "0003", "<html><body>Nothing to see.</body></html>", age=99, name="d.htm")
    put("MSFT", "0001", "<html><body>No such word.</body></html>")
    put("MSFT", "0009", "<html><body>Revenue, quarterly.</body></html>", form="10-Q")
    return str(tmp_path / "in")


def files_read(df):
    """The number of files that a scan without a shuffle opens."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    scan = plan.collectLeaves().head()
    return scan.metrics().apply("numFiles").value()


def test_scan(spark, tree):
    assert files.html_files(spark, tree).count() == 5
    one = files.html_files(spark, tree, [" aapl "], "10-K", 1).collect()
    assert [(r.symbol, r.form, r.accession, r.document) for r in one] == [("AAPL", "10-K", "0002", "primary-document.html")]
    assert "Revenue fell" in one[0].html
    assert files.html_files(spark, tree, ["AAPL"], "10-K", 0).count() == 3
    few = files.bodies(spark, [f"{tree}/{files.TREE}"], [one[0].path])
    assert few.count() == 1
    assert files_read(few) == 1
    assert files.html_files(spark, tree, ["NOPE"]).count() == 0
    status = {r.symbol: (r.ok, r.error) for r in files.symbol_status(spark, tree, ["aapl", "nope", "AAPL"]).collect()}
    assert status == {"AAPL": (True, None), "NOPE": (False, "missing")}
    with pytest.raises(ValueError, match="no symbols"):
        files.symbol_status(spark, tree, [" "])


def test_winners_are_read_in_parts(spark, tree, monkeypatch):
    """However many winners there are, files that lost are not opened."""
    monkeypatch.setattr(files, "LISTED", 1)
    got = files.html_files(spark, tree, ["AAPL", "MSFT"], "10-K", 2)
    assert sorted((r.symbol, r.accession) for r in got.collect()) == [("AAPL", "0001"), ("AAPL", "0002"), ("MSFT", "0001")]
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1 + 3  # the listing, and a scan for each part
    monkeypatch.setattr(files, "LISTED", 100)
    few = files.bodies(spark, [f"{tree}/{files.TREE}"], [r.path for r in got.collect()])
    assert files_read(few) == 3
    assert files.html_files(spark, tree, ["NOPE"], "10-K", 2).count() == 0


def test_pipeline(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    config = RunConfig(keyword="Revenue")
    got = {r.symbol: (r.ok, r.documents, r.matches, r.points) for r in run(spark, tree, out, ["AAPL", "MSFT", "NOPE"], config).collect()}
    assert got == {"AAPL": (True, 2, 2, 2), "MSFT": (True, 0, 0, 0), "NOPE": (False, 0, 0, 0)}
    rows = {p.name: json.loads(p.read_text()) for p in (tmp_path / "out/summaries").glob("*.json")}
    assert {n: r["summaries"][0]["summary"] for n, r in rows.items()} == {f"aapl_revenue_{a}_primary-document.summary.json": s for a, s in (("0001", "Revenue rose."), ("0002", "Revenue fell."))}
    assert {(r["symbol"], r["document"], r["collection"]) for r in rows.values()} == {("AAPL", "primary-document.html", "filings_aapl-revenue")}
    ids = lambda: {r.id for r in read_collection(spark, f"{out}/collections").where("collection = 'filings_aapl-revenue'").collect()}
    first = ids()
    run(spark, tree, out, ["AAPL"], config)
    assert len(first) == 2 and ids() == first


def test_dry_run_and_cli(spark, tree, tmp_path):
    out = str(tmp_path / "dry")
    rows = cli.main(["AAPL", "--dry-run", "--limit", "5", "--keyword", "revenue", "--downloads", tree, "--output", out, "--no-cleanup", "--log-format", "json"], spark)
    assert [(r[0], r[1], r[3]) for r in rows] == [("AAPL", True, 2)]
    assert not os.path.exists(f"{out}/collections") and os.path.exists(f"{tree}/{files.TREE}")
    cli.main(["AAPL", "--dry-run", "--fresh", "--downloads", tree, "--output", out], spark)
    assert files.html_files(spark, tree).count() == 5  # input is never deleted
    a = cli.arguments([])
    assert (a.symbols, a.limit, a.end_date - a.start_date) == (["AAPL"], 1, timedelta(days=365))


def test_runs_keep_the_outputs_of_others(spark, tree, tmp_path):
    out = tmp_path / "out"
    names = lambda: {p.name.split("_0")[0] for p in (out / "summaries").glob("*.json")}
    run(spark, tree, str(out), ["AAPL"], RunConfig(keyword="revenue"))
    run(spark, tree, str(out), ["MSFT"], RunConfig(keyword="word"))
    assert names() == {"aapl_revenue", "msft_word"}
    before = {p: p.stat().st_mtime_ns for p in (out / "summaries").glob("aapl*")}
    run(spark, tree, str(out), ["AAPL", "MSFT"], RunConfig(keyword="such"))
    assert names() == {"aapl_revenue", "msft_word", "msft_such"}
    assert before == {p: p.stat().st_mtime_ns for p in before}
    assert not list((out / "summaries/_staging").iterdir())


def test_stream(spark, tree, tmp_path):
    """Both branches; the second time there is nothing new, and a batch that is done again adds nothing."""
    out, state = str(tmp_path / "s"), str(tmp_path / "state")
    for _ in range(2):
        summarize_stream(spark, tree, out, state, RunConfig(keyword="revenue")).awaitTermination(120)
        assert spark.read.json(f"{out}/summaries").count() == 3
        points, at = read_collection(spark, f"{out}/collections"), manifest(spark, f"{out}/collections")
        assert points.count() == 3 and at["version"] == 1 and at["batches"] == {state: 0}
    upsert(points.limit(1).withColumn("id", F.lit("other")), f"{out}/collections", (state, 0))
    assert read_collection(spark, f"{out}/collections").count() == 3
    os.unlink(f"{state}/commits/0")  # as if it had failed after its sinks: Spark repeats the batch
    (tmp_path / "state/commits/.0.crc").unlink(missing_ok=True)
    summarize_stream(spark, tree, out, state, RunConfig(keyword="revenue")).awaitTermination(120)
    assert manifest(spark, f"{out}/collections")["version"] == 1 and spark.read.json(f"{out}/summaries").count() == 3


def test_config():
    day = date(2024, 1, 1)
    RunConfig(keyword="x", start_date=day, end_date=date.today() + timedelta(days=5))
    for bad in (
        {"keyword": " "}, {"mode": "weekly"}, {"limit": 0}, {"batch_size": 0}, {"max_retries": 0}, {"max_new_tokens": 0},
        {"start_date": day, "end_date": day - timedelta(days=1)}, {"start_date": date(1992, 1, 1)}, {"start_date": date.today() + timedelta(days=1)}, {"chunk_overlap": 2000},
    ):
        with pytest.raises(ValueError):  # noqa: PT011
            RunConfig(**{"keyword": "x", **bad})
    assert form_of("annual") == "10-K" and form_of("quarterly") == "10-Q"
    assert check_user_agent("me me@example.com")
    for bad in ("", "no address here", "a@b.c"):
        with pytest.raises(ValueError, match="user agent"):
            check_user_agent(bad)


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("STORE_PORT=7000\n# c\nunknown=1\nEMAIL='a@b.example'\n")
    monkeypatch.setenv("EMAIL", "c@d.example")
    got = Settings.load(str(tmp_path / ".env"))
    assert (got.store_port, got.email, got.store_location) == (7000, "c@d.example", "http://localhost:7000")
    assert Settings(store_url="https://s").store_location == "https://s"
    for bad in ({"store_port": 0}, {"distance": "L1"}, {"environment": "x"}):
        with pytest.raises(ValueError):  # noqa: PT011
            Settings(**bad)


def test_settings_act(spark, tree, tmp_path, monkeypatch):
    """The embedding model, the vector size and the store reach a run."""
    from ledgerloom.config import PLACEHOLDER
    from ledgerloom.operators import vectors
    from ledgerloom.plans import downloads
    from ledgerloom.plans.pipeline import run_files
    from ledgerloom.sources.files import html_files, symbol_status

    sent = tmp_path / "sent"
    sent.mkdir()

    def store(method, url, headers, body):
        if method == "GET" or url.startswith("http://broken"):
            return 404, {}, b""
        (sent / f"{os.getpid()}-{len(os.listdir(sent))}").write_text(f"{method} {url}")
        return 200, {}, b"{}"

    files_, status = html_files(spark, tree, ["AAPL"], "10-K"), symbol_status(spark, tree, ["AAPL"], "10-K")
    config = RunConfig(keyword="revenue", embedding_model="hashing:16", store_location="http://store:1")
    run_files(spark, files_, status, str(tmp_path / "out"), config, sending=store)
    assert {len(r.vector) for r in read_collection(spark, f"{tmp_path}/out/collections").collect()} == {16}
    asked = {p.read_text() for p in sent.iterdir()}
    assert asked == {"PUT http://store:1/collections/filings_aapl-revenue", "PUT http://store:1/collections/filings_aapl-revenue/points?wait=true"}
    with pytest.raises(Exception, match="404"):  # noqa: PT011
        run_files(spark, files_, status, str(tmp_path / "out"), RunConfig(keyword="revenue", store_location="http://broken"), sending=store)
    assert vectors.dimension(vectors.embedder("hashing", 8)) == 8 and vectors.dimension(vectors.embedder("hashing:9")) == 9
    with pytest.raises(ValueError, match="no embedder"):
        vectors.embedder("other")
    monkeypatch.setitem(vectors.EMBEDDERS, "fixed", lambda rest, size: lambda: vectors.hashing_embedder(5))
    with pytest.raises(ValueError, match="5 numbers"):
        vectors.embedder("fixed", 7)
    assert Settings(environment="development").agent == PLACEHOLDER and Settings(environment="production", email="a b@c.example").agent == "a b@c.example"
    with pytest.raises(ValueError, match="EMAIL"):
        Settings(environment="production").agent  # noqa: B018
    shown = downloads.Symbols(["msft ", "AAPL", "aapl", " "], "d")
    assert str(shown) == "2 symbol(s): AAPL,MSFT" and repr(shown) == "Symbols([AAPL,MSFT], folder='d')" and str(downloads.Symbols([], "d")) == "0 symbol(s): none"
    with pytest.raises(ValueError, match="no symbols"):
        downloads.download_symbols(spark, [" "], str(tmp_path), "a b@c.example", "10-K", None, None)


def test_prompts(tmp_path):
    p = tmp_path / "p.yml"
    p.write_text("template: |\n  For {symbol}\n  on {search_term}:\n  {chunk}\ninput_variables:\n  - symbol\n")
    assert files.prompt_template(str(p), "") == "For {symbol}\non {search_term}:\n{chunk}\n"
    default = "{symbol}{search_term}{chunk}"
    assert files.prompt_template(str(tmp_path / "none"), default) == default
    with pytest.raises(ValueError, match="lacks"):
        files.prompt_template(None, "{symbol}")
