import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def tidy(row):
    return tuple("" if x is None else f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    sql = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    assert sorted(map(tidy, df.select(*columns).collect())) == sorted(map(tidy, sql.select(*[f'"{c}"' for c in columns]).fetchall()))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.SQL.keys()))
def test_other_queries_give_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


CUT_OFF = "<title>of the&amp;&amp</title><p>the rest &quot"  # references whose semicolons were cut off
LONG = "<p>The " + "ß" * 1980 + ".</p>"  # one sentence as long as a chunk


@pytest.mark.parametrize(("name", "html"), [("html_text", CUT_OFF), ("page_envelopes", CUT_OFF), ("filing_summaries", CUT_OFF), ("filing_summaries", LONG)])
def test_queries_on_odd_pages_agree_with_sql(spark, tmp_path, name, html):
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df, sql = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
    assert sorted(map(tidy, df.select(*sql.columns).collect())) == sorted(map(tidy, sql.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_training_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for top, _, names in os.walk(f"{root}/ledgerloom"):
        for n in names:
            if n.endswith(".py") and "/llm" not in top:
                with open(f"{top}/{n}") as f:
                    assert "ledgerloom.llm" not in f.read(), n
