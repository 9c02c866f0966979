"""The download branch: filings chosen by form, date and number, fetched inside Spark tasks and landed as tables.

Only what is chosen is fetched, and each URL once: every step of a run lands its
answers as a Parquet table, one part for each reading task, and later steps read
that. Bodies never pass the driver. What became of each request is kept in a
ledger (symbol, kind, url, status, attempts, error), from which the status of a
symbol follows. The landed documents can be read as the pipeline's files, and
:func:`discard` deletes what a run landed and nothing else; ledgers stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.filings import by_form, complete, explode_recent, in_dates, latest, lookup_tickers, with_urls
from ledgerloom.schemas import SUBMISSIONS
from ledgerloom.sources.files import company_facts, submissions_from, ticker_rows
from ledgerloom.sources.http import fetch
from ledgerloom.sources.shared import delete
from ledgerloom.sources.submissions import sections_of

# Where the archive keeps what is fetched.
SUBMISSIONS_URL = "https://data.sec.gov/submissions/CIK{}.json"
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK{}.json"
TICKERS_URL = "https://www.sec.gov/include/ticker.txt"


def _fetched(ciks: DataFrame, pattern: str, agent: str, **http) -> DataFrame:
    before, after = pattern.split("{}")
    padded = F.lpad(F.col("cik").cast("string"), 10, "0")
    return fetch(ciks.withColumn("url", F.concat(F.lit(before), padded, F.lit(after))), agent, **http)


def fetch_tickers(spark: SparkSession, agent: str, **http) -> DataFrame:
    """``(ticker, cik)`` of all companies; a row order within the file decides repeats."""
    got = fetch(spark.createDataFrame([(TICKERS_URL,)], "url string"), agent, **http)
    lines = got.select(F.posexplode(F.split("text", "\n")).alias("at", "value"))
    return ticker_rows(lines, order="at")


def fetch_submissions(ciks: DataFrame, agent: str, **http) -> DataFrame:
    """Submissions of each company of ``ciks`` (a column ``cik``), and ``error`` where there are none."""
    got = _fetched(ciks.select("cik"), SUBMISSIONS_URL, agent, **http)
    return got.select(F.from_json("text", SUBMISSIONS).alias("s"), F.col("cik").alias("asked"), "error").select("asked", "s.*", "error")


def fetch_facts(ciks: DataFrame, agent: str, **http) -> DataFrame:
    """The facts of each company of ``ciks``, a row for each taxonomy."""
    return company_facts(_fetched(ciks.select("cik"), FACTS_URL, agent, **http), "text")


def company_filings(ciks: DataFrame, agent: str, **http) -> DataFrame:
    """Complete recent filings of each company of ``ciks``, by CIK of ten digits."""
    got = fetch_submissions(ciks, agent, **http).where("error is null")
    return complete(explode_recent(got)).withColumn("cik", F.lpad("cik", 10, "0"))


def choose(filings: DataFrame, form: str | None = None, start: date | None = None, end: date | None = None, limit: int | None = None, by: str = "cik") -> DataFrame:
    """Filings of a form, accepted from ``start`` to ``end``, the newest ``limit`` of each company."""
    if form is not None:
        filings = by_form(filings, form)
    if start is not None or end is not None:
        filings = in_dates(filings, start, end)
    return latest(filings, limit, by)


def _landed(rows: DataFrame, path: str, agent: str, **http) -> DataFrame:
    """Fetch ``rows`` once, into a table at ``path``, and read it back."""
    fetch(rows, agent, **http).write.parquet(path)
    out = rows.sparkSession.read.parquet(path)
    out.landed_path = path
    return out


def land(filings: DataFrame, root: str, agent: str, what: str = "document", path: str | None = None, **http) -> DataFrame:
    """Fetch each filing's primary ``document`` or whole ``submission`` into a new table under ``root`` and read it back.

    Columns are those of ``filings`` and ``url, body, text, status, attempts, error``. A rerun lands a table of its own and leaves others alone.
    """
    if what not in ("document", "submission"):
        raise ValueError("what must be document or submission")
    rows = with_urls(filings).withColumn("url", F.col(f"{what}_url")).drop("base_url", "document_url", "submission_url")
    return _landed(rows, path or f"{root}/landed/{what}-{uuid.uuid4().hex}", agent, **http)


def discard(landed: DataFrame) -> None:
    """Delete the tables that the run of ``landed`` made, and nothing else."""
    delete(landed.sparkSession, landed.landed_path)


def status(landed: DataFrame) -> DataFrame:
    """``(cik, fetched, failed)``."""
    return landed.groupBy("cik").agg(F.count_if(F.col("error").isNull()).alias("fetched"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def as_files(landed: DataFrame) -> DataFrame:
    """Landed documents with the columns of :func:`ledgerloom.sources.files.html_files`; ``symbol`` is the landed one, else the CIK."""
    symbol = F.col("symbol") if "symbol" in landed.columns else F.col("cik")
    good = landed.where("error is null and text is not null")
    return good.select(F.col("url").alias("path"), symbol.alias("symbol"), F.col("form_type").alias("form"), F.col("accession_number").alias("accession"), F.col("primary_document").alias("document"), F.col("acceptance_date").alias("mtime"), F.col("text").alias("html"))


def submission_files(landed: DataFrame) -> DataFrame:
    """Landed full submissions with the columns of :func:`as_files`: a row for each of their documents that is HTML or text of the filing's form."""
    symbol = F.col("symbol") if "symbol" in landed.columns else F.col("cik")
    good = landed.where("error is null and text is not null")
    rows = good.select(F.col("url").alias("path"), symbol.alias("symbol"), F.col("form_type").alias("form"), F.col("accession_number").alias("accession"), F.col("acceptance_date").alias("mtime"), "text")
    found = sections_of(rows).where((F.col("type") == F.col("form")) & F.col("body").isNotNull())
    return found.select("path", "symbol", "form", "accession", F.coalesce("filename", F.concat(F.lit("document-"), F.col("sequence").cast("string"))).alias("document"), "mtime", F.col("body").alias("html"))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows that differ in their symbol only, as one with ``symbols``: a company's tickers share its requests."""
    return rows.groupBy(*[c for c in rows.columns if c != "symbol"]).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def _each(landed: DataFrame) -> DataFrame:
    """A row for each symbol again; bodies are repeated as they are read, not as they are kept."""
    out = landed.withColumn("symbol", F.explode("symbols")).drop("symbols")
    out.landed_path = landed.landed_path
    return out


#: What the requests of a run are for, in the order in which a failure counts.
KINDS = ("tickers", "submissions", "document", "submission")


def ledger_rows(landed: DataFrame, kind: str, symbol: str | None = None) -> DataFrame:
    """``(symbol, kind, url, status, attempts, error)`` of the requests whose answers are in ``landed``; a shared one has a row for each symbol."""
    of = F.col(symbol) if symbol else F.lit(None).cast("string")
    return landed.select(of.alias("symbol"), F.lit(kind).alias("kind"), "url", "status", "attempts", "error")


def symbol_statuses(asked: DataFrame, known: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(symbol, ok, error)`` for each symbol of ``asked``: false if any request for it, or for the ticker map, failed, or if it is not in the map.

    ``known`` has ``(symbol, error)`` of the lookup. Of several failures the one of the earliest kind and lowest URL is told.
    """
    failed = ledger.where("error is not null")
    order = F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.col("url"))
    first = failed.groupBy("symbol").agg(F.min_by(F.concat("kind", F.lit(": "), "error"), order).alias("failure"))
    common = first.where("symbol is null").first()  # one request for all: the ticker map's
    said = F.lit(common["failure"]) if common else F.coalesce("error", "failure")
    rows = asked.join(known.select("symbol", "error"), "symbol", "left").join(first.where("symbol is not null"), "symbol", "left")
    return rows.select("symbol", said.isNull().alias("ok"), said.alias("error"))


def download_filings(asked: DataFrame, root: str, agent: str, form: str | None = None, start: date | None = None, end: date | None = None, limit: int | None = None, what: str = "document", **http) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Land the newest filings of each symbol of ``asked`` (a column ``symbol``).

    Returns the landed documents, the ledger of all requests and the status of each symbol. Each request is made by
    one task and its answer written before anything reads it, so no plan fetches it again.
    """
    spark, run = asked.sparkSession, uuid.uuid4().hex
    at = f"{root}/landed/run-{run}"
    asked = asked.select("symbol").distinct()
    tickers = _landed(spark.createDataFrame([(TICKERS_URL,)], "url string"), f"{at}/tickers", agent, **http)
    lines = tickers.select(F.posexplode(F.split("text", "\n")).alias("at", "value"))
    known = lookup_tickers(asked.withColumnRenamed("symbol", "ticker"), ticker_rows(lines, order="at")).withColumnRenamed("ticker", "symbol")
    before, after = SUBMISSIONS_URL.split("{}")
    links = known.where("error is null").select("symbol", "cik", F.concat(F.lit(before), F.lpad("cik", 10, "0"), F.lit(after)).alias("url"))
    histories = _landed(_shared(links), f"{at}/submissions", agent, **http)
    read = _each(histories).withColumn("s", F.from_json("text", SUBMISSIONS))
    broken = F.when(F.col("error").isNull() & F.col("s.filings.recent.accessionNumber").isNull(), "json: no list of filings")
    read = read.withColumn("error", F.coalesce("error", broken))
    good = read.where("error is null").select("symbol", F.col("cik").alias("asked"), "s.*")
    found = complete(explode_recent(good, "symbol", "asked")).withColumn("cik", F.col("asked")).drop("asked")
    filings = choose(found, form, start, end, limit, by="symbol")  # two symbols of a company have a limit each
    landed = _each(land(_shared(filings), root, agent, what, f"{at}/documents", **http))
    rows = ledger_rows(tickers, "tickers").unionByName(ledger_rows(read, "submissions", "symbol")).unionByName(ledger_rows(landed, what, "symbol"))
    rows.write.parquet(f"{root}/ledger/run-{run}")
    ledger = spark.read.schema(rows.schema).parquet(f"{root}/ledger/run-{run}")
    landed.landed_path = at
    return landed, ledger, symbol_statuses(asked, known, ledger)


class Symbols:
    """Symbols to download, each once, in order, and how they are shown."""

    def __init__(self, symbols: Iterable[str], folder: str):
        self.symbols, self.folder = sorted({s.strip().upper() for s in symbols if s.strip()}), folder

    def __repr__(self) -> str:
        return f"Symbols([{','.join(self.symbols) or 'none'}], folder={self.folder!r})"

    def __str__(self) -> str:
        return f"{len(self.symbols)} symbol(s): {','.join(self.symbols) or 'none'}"


def download_symbols(spark: SparkSession, symbols: list[str], root: str, agent: str, form: str, start: date, end: date, limit: int | None = None, what: str = "document", **http) -> tuple[DataFrame, DataFrame]:
    """:func:`download_filings` of a list of symbols: the landed documents and ``(symbol, ok, error)``."""
    wanted = Symbols(symbols, root).symbols
    if not wanted:
        raise ValueError("no symbols given")
    asked = spark.createDataFrame([(s,) for s in wanted], "symbol string")
    landed, _, said = download_filings(asked, root, agent, form, start, end, limit, what, **http)
    return landed, said
