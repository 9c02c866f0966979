import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text, times


def values(spark, f, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_normalize_cik(spark):
    got = values(spark, text.normalize_cik, "320193", "0000320193", "CIK0000320193", "CIK-320193", "0000-320193", "1", "12345678901", "none", None)
    assert got == ["0000320193"] * 5 + ["0000000001", "12345678901", None, None]


def test_names(spark):
    assert values(spark, text.slugify, "Net Revenue!", "--a__b--", "", None) == ["net-revenue", "a-b", "", None]
    assert values(spark, text.safe_name, "a b/c?.html", "x" * 200) == ["a_b_c_.html", "x" * 120]
    assert values(spark, lambda c: text.collection_slug(c, "Net Income"), "aapl") == ["filings_aapl-net-income"]
    assert values(spark, lambda c: text.collection_slug(c, "Net Income", None), "aapl") == ["aapl-net-income"]
    assert values(spark, text.symbol, "\t aapl\n") == ["AAPL"]


def test_html(spark):
    page = "<html><head><title> A\n B </title><style>x{}</style></head><body><!-- c --><script>if (a<b) {}</script><p>Tom &amp; &lt;b&gt;</p></body></html>"
    assert values(spark, text.html_title, page, "<p>no</p>", None) == ["A B", None, None]
    assert values(spark, text.html_text, page, None) == ["A B Tom & <b>", None]


def test_keyword_is_plain_text(spark):
    assert values(spark, lambda c: text.has_keyword(c, "50%_x"), "A 50%_X b", "50aax", None) == [True, False, None]


def test_prompt(spark):
    got = values(spark, lambda c: text.format_prompt('{{"a": {x}}} {y}', x=c, y=F.lit(3)), "one", None)
    assert got == ['{"a": one} 3', '{"a": } 3']


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2023-11-03T18:30:00.000Z", "2023-11-03 18:30:00"),
        ("2023-11-03T18:30:00+02:00", "2023-11-03 16:30:00"),
        ("2023-11-03", "2023-11-03 00:00:00"),
        *[(x, None) for x in ("2023/11/03", "2023/11/31", "invalid", "2023-13-45", "2023", "2023-11", "2023-11-03T18:30:00", "", None)],
    ],
)
def test_parse_utc(spark, raw, want):
    got = values(spark, lambda c: F.date_format(times.parse_utc(c), "yyyy-MM-dd HH:mm:ss"), raw)
    assert got == [want]


def test_mode(spark):
    assert values(spark, times.form_of_mode, "annual", "quarterly", "weekly") == ["10-K", "10-Q", None]
