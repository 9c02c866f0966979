"""Full submission texts: a header and marked sections, one for each document of a filing.

Sections are split off by the scan itself: the mark before a section is the
scan's line separator. So a file is cut like any large text file, its sections
are read by as many tasks as its size asks, and no task holds more of it than a
section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks of the archive's submission format.
SECTION = "\n<DOCUMENT>\n"
OPENED, CLOSED = "<TEXT>", "</TEXT>"
FIELDS = {"type": "TYPE", "sequence": "SEQUENCE", "filename": "FILENAME", "description": "DESCRIPTION"}
HEADER = {"form_type": "CONFORMED SUBMISSION TYPE", "accession_number": "ACCESSION NUMBER", "filed": "FILED AS OF DATE", "company": "COMPANY CONFORMED NAME", "cik": "CENTRAL INDEX KEY"}


def _field(head: Column, pattern: str) -> Column:
    found = F.regexp_extract(head, rf"(?m)^{pattern}[ \t]*(.*?)[ \t\r]*$", 1)
    return F.nullif(found, F.lit(""))


def _section(raw: Column) -> dict[str, Column]:
    head = F.substring_index(raw, OPENED, 1)
    out = {name: _field(head, f"<{mark}>") for name, mark in FIELDS.items()}
    out["sequence"] = out["sequence"].try_cast("int")
    # From the first opening mark to the last closing one, without the line ends beside them; all of it if it is not closed.
    body = F.regexp_replace(F.substring(raw, F.locate(OPENED, raw) + len(OPENED), F.length(raw)), r"^\r?\n", "")
    closed = F.substring(body, F.lit(1), F.length(body) - F.length(F.substring_index(body, CLOSED, -1)) - len(CLOSED))
    text = F.when(F.contains(body, F.lit(CLOSED)), F.regexp_replace(closed, r"\r?\n\z", "")).otherwise(body)
    return out | {"body": F.when(F.locate(OPENED, raw) > 0, text)}


def _raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    read = spark.read.option("lineSep", SECTION).text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\A<DOCUMENT>\n", "").alias("raw"))


def _is_section(raw: Column) -> Column:
    return F.rlike(raw, F.lit(r"\A\s*<TYPE>"))


def submission_sections(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, type, sequence, filename, description, body)``: a row for each document in the submission texts at ``path``."""
    raw = _raw(spark, path).where(_is_section(F.col("raw")))
    return raw.select("path", *[c.alias(n) for n, c in _section(F.col("raw")).items()])


def submission_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, form_type, accession_number, filed, company, cik)`` of the submission texts at ``path``."""
    raw = _raw(spark, path).where(~_is_section(F.col("raw")))
    return raw.select("path", *header_fields(F.col("raw"))).where("accession_number is not null")


def header_fields(text: Column) -> list[Column]:
    """What a submission's header says; read up to its first section only."""
    head = F.substring_index(text, SECTION, 1)
    return [_field(head, rf"\s*{mark}:").alias(name) for name, mark in HEADER.items()]


def sections_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """The same of a column: a row for each section of each text, with the other columns of ``texts``."""
    keep = [c for c in texts.columns if c != text]
    split = texts.select(*keep, F.explode(F.split(F.concat(F.lit("\n"), F.col(text)), SECTION)).alias("_raw")).where(_is_section(F.col("_raw")))
    return split.select(*keep, *[c.alias(n) for n, c in _section(F.col("_raw")).items()])
