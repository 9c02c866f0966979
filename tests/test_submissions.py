import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import submissions as m

NAMES = ["type", "sequence", "filename", "description", "body"]


def plain(text):
    """Sections line by line."""
    out, here = [], None
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if line == "<DOCUMENT>" and i + 1 < len(lines):
            here = []
            out.append(here)
        elif here is not None:
            here.append(line)
    found = []
    for lines in out:
        at = next((i for i, x in enumerate(lines) if x == "<TEXT>"), len(lines))
        fields = {x[1:].split(">", 1)[0]: x.split(">", 1)[1].strip(" \t") for x in lines[:at] if x.startswith("<") and ">" in x}
        end = max((i for i, x in enumerate(lines) if x == "</TEXT>"), default=len(lines))
        body = "\n".join(lines[at + 1 : end]) if at < len(lines) else None
        number = fields.get("SEQUENCE", "")
        found.append((fields.get("TYPE") or None, int(number) if number.isdigit() else None, fields.get("FILENAME") or None, fields.get("DESCRIPTION") or None, body))
    return found


def submission(made, k, large=0):
    text = f"<SEC-DOCUMENT>{k}.txt\n<SEC-HEADER>\nACCESSION NUMBER:\t\t{k:010d}-23-000001\nCONFORMED SUBMISSION TYPE:\t10-K\nFILED AS OF DATE:\t\t20230102\n\tCOMPANY DATA:\n\t\tCOMPANY CONFORMED NAME:\t\t\tCompany {k} \n\t\tCENTRAL INDEX KEY:\t\t\t{k:010d}\n</SEC-HEADER>"
    for i in range(1, made.randrange(2, 6)):
        fields = [f"<TYPE>{made.choice(['10-K', 'EX-1', 'GRAPHIC'])}", f"<SEQUENCE>{made.choice([i, 'x'])}", *made.sample([f"<FILENAME>f{i}.htm", f"<DESCRIPTION>two  words {i}"], made.randrange(3))]
        lines = [made.choice(["", "a line", "<TEXT> in it", "<html><p>x", "  é\t", "<TYPE>no field"]) for _ in range(made.randrange(6))]
        if large and i == 1:
            lines += [f"line {j}" for j in range(large)]
        text += "\n<DOCUMENT>\n" + "\n".join([*fields, "<TEXT>", *lines, "</TEXT>", "</DOCUMENT>"])
    return text + "\n</SEC-DOCUMENT>\n"


@pytest.fixture(scope="module")
def texts():
    made = random.Random(11)
    return [submission(made, k, 300_000 if k == 3 else 0) for k in range(12)]


def key(row):
    return tuple(str(x) for x in row)


def test_sections_of_files(spark, tmp_path, texts):
    """Small splits, and a section larger than several of them and than a batch."""
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.txt").write_text(text, newline="")
    (tmp_path / "whole.txt").write_text("".join(texts), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = m.submission_sections(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 20
        for name, text in [*((f"{k}.txt", t) for k, t in enumerate(texts)), ("whole.txt", "".join(texts))]:
            rows = got.where(F.endswith("path", F.lit(f"/{name}"))).select(*NAMES).collect()
            assert sorted(map(key, rows)) == sorted(map(key, plain(text))), name
        assert max(len(r.body) for r in got.where("body is not null").collect()) > 3_000_000
        heads = {r.cik: (r.form_type, r.accession_number, r.filed, r.company) for r in m.submission_headers(spark, [str(tmp_path / f"{k}.txt") for k in range(12)]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert heads == {f"{k:010d}": ("10-K", f"{k:010d}-23-000001", "20230102", f"Company {k}") for k in range(12)}


def test_sections_of_a_column(spark, texts):
    df = spark.createDataFrame([*enumerate(texts), (90, None), (91, ""), (92, "<DOCUMENT>\n<TYPE>10-K\n<TEXT>\nopen"), (93, "a\n<DOCUMENT>\n<TYPE>EX\nno text")], "k int, text string")
    got = m.sections_of(df)
    for k, text in enumerate(texts):
        assert sorted(map(key, got.where(F.col("k") == k).select(*NAMES).collect())) == sorted(map(key, plain(text)))
    assert [(r.k, r.type, r.body) for r in got.where("k >= 90").orderBy("k").collect()] == [(92, "10-K", "open"), (93, "EX", None)]


def test_the_pipeline_reads_submissions(spark, tmp_path):
    import json

    from ledgerloom.plans import cli
    from test_downloads import transport

    def whole(url, headers):
        if url.endswith(".txt") and "/edgar/data/" in url:
            return 200, {}, b"<SEC-HEADER>\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>10-K\n<SEQUENCE>1\n<FILENAME>main.htm\n<TEXT>\n<p>Revenue rose.\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-1\n<TEXT>\nRevenue elsewhere.\n</TEXT>\n</DOCUMENT>\n"
        return transport(url, headers)

    rows = cli.main(["AAPL", "--fetch", "--what", "submission", "--limit", "1", "--start_date", "2023-01-01", "--end_date", "2023-12-31", "--dry-run", "--downloads", str(tmp_path / "in"), "--output", str(tmp_path / "out")], spark, whole)
    assert [(r[0], r[1], r[3]) for r in rows] == [("AAPL", True, 1)]
    (made,) = (tmp_path / "out/summaries").glob("*.json")
    assert made.name.endswith("_main.summary.json") and json.loads(made.read_text())["summaries"][0]["summary"] == "Revenue rose."
