import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import parsing


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("content", "form", "kind", "title", "error"),
    [
        ("<html><title>Apple Inc. 10-K</title><body>FORM 10-K Annual Report</body></html>", "10-K", "HTML", "Apple Inc. 10-K", None),
        ('{"submissionType":"8-K","entityName":"Test Company"}', "8-K", "JSON", "Test Company", None),
        ("<html><body>FORM 10-Q</body></html>", "10-Q", "HTML", None, None),
        ('{"submissionType":"10-K"}', "10-K", "JSON", None, None),
        ("CONFORMED SUBMISSION TYPE: 10-Q\nsecond line", "10-Q", "Text", None, None),
        ("Filing type is 10-K for this document", "10-K", "Text", None, None),
        ("<html><body>nothing</body></html>", None, "HTML", None, "no form type"),
        ('{"submissionType": ', None, "Text", None, "malformed JSON"),
        ('<?xml version="1.0"?><doc>FORM 10-K</doc>', "10-K", "XML", None, None),
        (None, None, None, None, "no content"),
    ],
)
def test_documents(spark, content, form, kind, title, error):
    got = one(spark, parsing.parse_document, content)
    assert (got["form_type"], got["format"], got["title"], got["error"]) == (form, kind, title, error)
    assert got["size_bytes"] == (None if content is None else len(content.encode()))


def test_large_document(spark):
    got = one(spark, parsing.parse_document, "<html><body>FORM 10-K" + "x" * 1_000_000 + " </body></html>")
    assert got["size_bytes"] > 1_000_000


def test_summaries(spark):
    ok = one(spark, parsing.parse_summary, '{"summary":"ok","points":["x"],"confidence":0.7,"extra":1}')
    assert (ok["summary"], ok["points"], ok["confidence"], ok["error"], ok["raw_output"]) == ("ok", ["x"], 0.7, None, None)
    for raw in ("not json", '{"summary":"ok","confidence":1.5}', '{"summary":5}', '{"points":"x"}', "[1]", '"text"'):
        bad = one(spark, parsing.parse_summary, raw)
        assert bad["error"] and bad["raw_output"] == raw and bad["summary"] is None
    assert one(spark, parsing.parse_summary, '{"summary":null,"confidence":1}')["confidence"] == 1.0


def test_responses(spark):
    assert [one(spark, parsing.response_error, s, "int") for s in (200, 429, 404, 500)] == [None, "rate_limited", "not_found", "invalid_response"]
    info = one(spark, parsing.response_info, {"x-ratelimit-remaining": "1", "x-ratelimit-reset": "soon", "content-type": "a/b"}, "map<string,string>")
    assert tuple(info) == (1, None, "a/b")
    low = lambda c: parsing.is_rate_limit_low(parsing.response_info(c))
    assert [one(spark, low, m, "map<string,string>") for m in ({"x-ratelimit-remaining": "1"}, {"x-ratelimit-remaining": "2"}, {})] == [True, False, False]


def test_urls(spark):
    urls = {"https://www.sec.gov/a": True, "https://sec.gov": True, "http://sec.gov/a": False, "https://other.example/?sec.gov": False, "https://notsec.gov/": False, "nonsense": False}
    assert {u: one(spark, parsing.is_allowed_url, u) for u in urls} == urls


def test_summaries_are_parsed_once(spark):
    raws = ['{"summary":"ok","points":["x"],"confidence":0.7}', "no", None, "[]", '{"summary":5}', '{"confidence":2}', '{"points":[]}', '{"points":[1]}', '{"error":"e","raw_output":"r"}', '{"confidence":"1"}', "{}", '{"summary":{"a":1}}']
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    steps, one = parsing.with_summary(df, "raw", "s"), df.withColumn("s", parsing.parse_summary(F.col("raw")))
    assert steps.collect() == one.collect()
    assert [r.s.error for r in steps.collect()] == [None, "not JSON", "not JSON", "not a summary record", "not a summary record", "not a summary record", None, "not a summary record", "e", "not a summary record", None, "not a summary record"]
    for made in (steps, one):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
