"""Format detection, form inference and document parsing as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import html_title, size_bytes

# Form types that a bare token may be.
KNOWN_FORMS = ("10-K405", "10-KT", "10-K", "10-QT", "10-Q", "8-K", "6-K", "20-F", "40-F", "DEF 14A", "S-1", "S-3", "S-4", "S-8", "13F-HR", "SC 13D", "SC 13G", "424B3", "424B4", "424B5")
_FORM = r"[0-9A-Z]+(?:-[0-9A-Z]+)?(?:/A)?"


def as_json(c: Column) -> Column:
    """The content as a variant if it begins as a JSON object or list does and can be read, else null."""
    return F.when(F.rlike(c, F.lit(r"^\s*[\[{]")), F.try_parse_json(c))


def is_json(c: Column) -> Column:
    return as_json(c).isNotNull()


def detect_format(c: Column, json: Column | None = None) -> Column:
    """``HTML``, ``XML``, ``JSON`` or ``Text``, from how the content begins. ``json`` is :func:`as_json` of it where that is known."""
    json = as_json(c) if json is None else json
    return (
        F.when(F.rlike(c, F.lit(r"(?i)^\s*(<!doctype html|<html)|<html[\s>]")), "HTML")
        .when(F.rlike(c, F.lit(r"^\s*<\?xml")), "XML")
        .when(json.isNotNull(), "JSON")
        .when(F.rlike(c, F.lit(r"^\s*<[a-zA-Z]")), "HTML")
        .when(c.isNotNull(), "Text")
    )


def infer_form_type(c: Column, json: Column | None = None) -> Column:
    """The stated submission type, a JSON ``submissionType``, ``FORM X``, or a known form standing alone; else null."""
    bare = "|".join(KNOWN_FORMS)
    json = as_json(c) if json is None else json
    found = [
        F.regexp_extract(c, rf"CONFORMED SUBMISSION TYPE:\s*({_FORM})", 1),
        F.try_variant_get(json, "$.submissionType", "string"),
        F.regexp_extract(c, rf"(?:FORM|Form)\s+({_FORM})", 1),
        F.regexp_extract(c, rf"(?:^|[^0-9A-Za-z-])((?:{bare})(?:/A)?)(?:[^0-9A-Za-z-]|$)", 1),
    ]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def with_document(df: DataFrame, content: str) -> DataFrame:
    """``df`` with ``form_type, format, title, size_bytes, error`` of a content; error is set where a required part is missing.

    In steps, so that the JSON, the format and the form of a row are each worked out once.
    """
    c, json, kind, form = F.col(content), F.col("_json"), F.col("format"), F.col("form_type")
    out = df.withColumn("_json", as_json(c))
    out = out.withColumns({"format": detect_format(c, json), "form_type": infer_form_type(c, json)})
    title = F.when(kind == "JSON", F.try_variant_get(json, "$.entityName", "string")).when(kind == "HTML", html_title(c))
    error = F.when(c.isNull(), "no content").when(F.rlike(c, F.lit(r"^\s*[\[{]")) & json.isNull(), "malformed JSON").when(form.isNull(), "no form type")
    return out.withColumns({"title": title, "size_bytes": size_bytes(c), "error": error}).drop("_json")


def parse_document(c: Column) -> Column:
    """``struct<form_type, format, title, size_bytes, error>`` as one expression; :func:`with_document` does less work over a table."""
    json = as_json(c)
    kind, form = detect_format(c, json), infer_form_type(c, json)
    title = F.when(kind == "JSON", F.try_variant_get(json, "$.entityName", "string")).when(kind == "HTML", html_title(c))
    error = F.when(c.isNull(), "no content").when(F.rlike(c, F.lit(r"^\s*[\[{]")) & json.isNull(), "malformed JSON").when(form.isNull(), "no form type")
    return F.struct(form.alias("form_type"), kind.alias("format"), title.alias("title"), size_bytes(c).alias("size_bytes"), error.alias("error"))


def response_error(status: Column) -> Column:
    """The kind of error of an HTTP status, null for 200."""
    return F.when(status == 200, None).when(status == 429, "rate_limited").when(status == 404, "not_found").otherwise("invalid_response")


def response_info(headers: Column) -> Column:
    """``struct<remaining, reset, content_type>`` from a map of lower-case header names; unreadable numbers are null."""
    number = lambda name, kind: F.try_element_at(headers, F.lit(name)).try_cast(kind)
    return F.struct(
        number("x-ratelimit-remaining", "int").alias("remaining"),
        number("x-ratelimit-reset", "long").alias("reset"),
        F.try_element_at(headers, F.lit("content-type")).alias("content_type"),
    )


def is_rate_limit_low(info: Column) -> Column:
    return F.coalesce(info["remaining"] < 2, F.lit(False))


def is_allowed_url(url: Column, domain: str = "sec.gov") -> Column:
    """HTTPS, and the host is ``domain`` or under it; a domain elsewhere in the URL does not count."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.startswith(url, F.lit("https://")) & ((host == domain) | F.endswith(host, F.lit(f".{domain}"))), F.lit(False))


_FIELDS = (("summary", "string"), ("points", "array<string>"), ("confidence", "double"), ("error", "string"), ("raw_output", "string"))


def _taken(v: Column) -> Column:
    """What a summary record is judged by: the kinds of the whole and of each field, and the fields."""
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    kinds = [F.coalesce(F.schema_of_variant(part(n)), F.lit("VOID")).alias(f"{n}_kind") for n, _ in _FIELDS]
    return F.struct(F.schema_of_variant(v).alias("kind"), *kinds, *[F.try_variant_get(v, f"$.{n}", t).alias(n) for n, t in _FIELDS])


def _record(found: Column, raw: Column) -> Column:
    kind = lambda name: found[f"{name}_kind"]
    fits = F.coalesce(F.startswith(found["kind"], F.lit("OBJECT")), F.lit(False)) & kind("points").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    for name in ("summary", "error", "raw_output"):
        fits = fits & kind(name).isin("STRING", "VOID")
    number = F.rlike(kind("confidence"), F.lit("^(BIGINT|DOUBLE|DECIMAL)")) & F.coalesce(found["confidence"].between(0, 1), F.lit(False))
    error = F.when(found["kind"].isNull(), "not JSON").otherwise("not a summary record").alias("error")
    wrong = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in _FIELDS[:3]], error, raw.alias("raw_output"))
    return F.when(fits & ((kind("confidence") == "VOID") | number), F.struct(*[found[n].alias(n) for n, _ in _FIELDS])).otherwise(wrong)


def parse_summary(raw: Column) -> Column:
    """The summary record in a model's answer. An answer that is not one gives a record with ``error`` and ``raw_output``.

    JSON types are checked, which ``from_json`` would not do: text, list of text, and a number from 0 to 1. The answer is
    parsed once: transforming an array of one names what was worked out.
    """
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return once(F.try_parse_json(raw), lambda v: once(_taken(v), lambda found: _record(found, raw)))


def with_summary(df: DataFrame, raw: str, out: str) -> DataFrame:
    """``df`` with :func:`parse_summary` of a column, in steps of a plan, which generated code runs."""
    parsed = df.withColumn("_variant", F.try_parse_json(raw)).withColumn("_found", _taken(F.col("_variant")))
    return parsed.withColumn(out, _record(F.col("_found"), F.col(raw))).drop("_variant", "_found")
