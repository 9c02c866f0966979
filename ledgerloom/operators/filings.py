"""Filings: from a company's parallel arrays to rows, filters, ranks, URLs and ticker lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import symbol
from ledgerloom.functions.times import on_or_between, parse_utc

ARCHIVES = "https://www.sec.gov/Archives/edgar/data"


def explode_recent(submissions: DataFrame, *keep: str) -> DataFrame:
    """One row for each recent filing, by position; shorter arrays give nulls. Keeps the dates, act, items and size, and columns named in ``keep``."""
    r = "filings.recent."
    first = F.col(r + "accessionNumber")
    pad = lambda name: F.coalesce(F.col(r + name), F.expr("array()"))
    zipped = F.arrays_zip(
        first.alias("accession_number"), pad("form").alias("form_type"), pad("acceptanceDateTime").alias("accepted"), pad("primaryDocument").alias("primary_document"),
        pad("isXBRL").alias("x1"), pad("isXRBL").alias("x2"), pad("filingDate").alias("filing_date"), pad("reportDate").alias("report_date"),
        pad("act").alias("act"), pad("items").alias("items"), pad("size").alias("size"),
    )
    rows = submissions.select("cik", *keep, F.posexplode(F.slice(zipped, 1, F.size(first))).alias("pos", "f"))
    flag = F.coalesce(F.col("f.x1"), F.col("f.x2"), F.lit(0)) == 1
    return rows.select(
        *keep, "cik", "pos", "f.accession_number", "f.form_type", parse_utc(F.col("f.accepted")).alias("acceptance_date"), "f.primary_document",
        flag.alias("is_xbrl"), *[F.col(f"f.{n}").cast("string").alias(n) for n in ("filing_date", "report_date", "act", "items")], F.col("f.size").cast("long").alias("size"),
    )


def complete(filings: DataFrame) -> DataFrame:
    """Rows that have a document, a form and a readable acceptance time."""
    return filings.where((F.length("primary_document") > 0) & (F.length("form_type") > 0) & F.col("acceptance_date").isNotNull())


def by_form(filings: DataFrame, form: str) -> DataFrame:
    return filings.where(F.col("form_type") == form)


def with_xbrl(filings: DataFrame) -> DataFrame:
    return filings.where("is_xbrl")


def in_dates(filings: DataFrame, start=None, end=None) -> DataFrame:
    """Accepted on any day from ``start`` to ``end``, both included."""
    return filings.where(on_or_between(F.col("acceptance_date"), start, end))


def latest(filings: DataFrame, n: int | None, by: str = "cik", when: str = "acceptance_date", tie: str = "accession_number") -> DataFrame:
    """The newest ``n`` of each company; none or 0 is no limit. Rows beyond rank n are dropped before the shuffle."""
    if not n:
        return filings
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col(when).desc(), F.col(tie)))
    return filings.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def base_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit(f"{ARCHIVES}/"), cik, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"))


def with_urls(filings: DataFrame) -> DataFrame:
    """Adds the folder, the primary document's and the full submission text's URLs."""
    base = base_url(F.col("cik"), F.col("accession_number"))
    return filings.withColumns(
        {
            "base_url": base,
            "document_url": F.concat(base, F.col("primary_document")),
            "submission_url": F.concat(base, F.col("accession_number"), F.lit(".txt")),
        }
    )


def lookup_tickers(asked: DataFrame, tickers: DataFrame) -> DataFrame:
    """``asked`` (a column ``ticker``) with ``cik``, or ``error`` = ``not_found``. Spark broadcasts either side if its size allows."""
    wanted = asked.withColumn("ticker", symbol(F.col("ticker")))
    known = tickers.select("ticker", "cik")
    return wanted.join(known, "ticker", "left").withColumn("error", F.when(F.col("cik").isNull(), "not_found"))


def batch_lookup(spark: SparkSession, asked: Iterable[str], tickers: DataFrame) -> DataFrame:
    """``(pos, ticker, cik)`` of the asked tickers that are known, in the order asked, repeats kept."""
    rows = spark.createDataFrame(list(enumerate(asked)), "pos int, ticker string")
    return lookup_tickers(rows, tickers).where("error is null").select("pos", "ticker", "cik").orderBy("pos")


def lookup_ticker(spark: SparkSession, ticker: str, tickers: DataFrame) -> str:
    """The CIK of one ticker; ValueError if it is not known."""
    found = batch_lookup(spark, [ticker], tickers).first()
    if found is None:
        raise ValueError(f"ticker not found: {ticker}")
    return found["cik"]


def distinct_symbols(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """Trimmed, upper-cased, distinct and sorted."""
    return symbols.select(symbol(F.col(column)).alias("symbol")).where("length(symbol) > 0").distinct().orderBy("symbol")
