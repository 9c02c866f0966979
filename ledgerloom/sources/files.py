"""Filing trees on disk, company submissions, ticker maps and prompt files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.schemas import SUBMISSIONS

TREE = "sec-edgar-filings"
#: Paths of chosen files that one scan is given.
LISTED = 10_000


def _listed(spark: SparkSession, root: str, symbols: list[str] | None, form: str | None) -> tuple[list[str], dict[str, str]]:
    """Folders to read, and a status for each symbol whose folder is missing."""
    if symbols is None:
        return [f"{root}/{TREE}"], {}
    found, missing = [], {}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for s in sorted({s.strip().upper() for s in symbols}):
        path = f"{root}/{TREE}/{s}" + (f"/{form}" if form else "")
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            found.append(path)
        else:
            missing[s] = "missing"
    return found, missing


def _reader(spark: SparkSession):
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm}")


def _placed(df: DataFrame) -> DataFrame:
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = lambda i: F.element_at(parts, F.lit(-i))
    return df.select("*", F.col("_metadata.file_path").alias("path"), at(4).alias("symbol"), at(3).alias("form"), at(2).alias("accession"), at(1).alias("document"), F.col("_metadata.file_modification_time").alias("mtime"))


def html_files(spark: SparkSession, root: str, symbols: list[str] | None = None, form: str | None = None, limit: int | None = None) -> DataFrame:
    """``(path, symbol, form, accession, document, mtime, html)`` of the newest ``limit`` files of each symbol.

    Only the folders of the asked symbols and form are listed. Files are ranked by what their listing says, before
    a body is read; then only the files of the winners are, by scans of ``LISTED`` paths each. What passes the driver is
    the winners' paths, ``limit`` of each symbol.
    """
    paths, _ = _listed(spark, root, symbols, form)
    if not paths:
        return spark.createDataFrame([], "path string, symbol string, form string, accession string, document string, mtime timestamp, html string")
    listed = _placed(_reader(spark).format("binaryFile").load(paths).select("_metadata"))
    chosen = listed.select("path", "symbol", "form", "accession", "document", "mtime")
    if not limit:
        return chosen.join(bodies(spark, paths), "path")
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("mtime").desc(), "path"))
    chosen = chosen.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
    winners = [r["path"] for r in chosen.select("path").toLocalIterator()]
    read = [bodies(spark, paths, winners[i : i + LISTED]) for i in range(0, max(1, len(winners)), LISTED)]
    return chosen.join(reduce(DataFrame.unionAll, read), "path")


def bodies(spark: SparkSession, paths: list[str], only: list[str] | None = None) -> DataFrame:
    """``(path, html)`` of the files under ``paths``, or of those in ``only``, which prunes the files that are opened."""
    read = _reader(spark).format("text").option("wholetext", True).load(paths)
    if only is not None:
        read = read.where(F.col("_metadata.file_path").isin(only))
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def symbol_status(spark: SparkSession, root: str, symbols: list[str], form: str | None = None) -> DataFrame:
    """``(symbol, ok, error)``: whether each symbol has a folder. A missing one does not stop the others."""
    if not [s for s in symbols if s.strip()]:
        raise ValueError("no symbols given")
    _, missing = _listed(spark, root, symbols, form)
    rows = [(s, s not in missing, missing.get(s)) for s in sorted({s.strip().upper() for s in symbols})]
    return spark.createDataFrame(rows, "symbol string, ok boolean, error string")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Company submissions from JSON files, one company a file."""
    return spark.read.schema(SUBMISSIONS).option("multiLine", True).json(path)


def submissions_from(bodies: DataFrame, body: str = "body") -> DataFrame:
    return bodies.select(F.from_json(body, SUBMISSIONS, {"mode": "PERMISSIVE"}).alias("s")).select("s.*")


def company_facts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``(cik, entity_name, taxonomy, concepts)``: a row for each taxonomy of a company's facts."""
    v = bodies.select(F.try_parse_json(body).alias("v")).where("v is not null")
    top = v.select(F.try_variant_get("v", "$.cik", "bigint").alias("cik"), F.try_variant_get("v", "$.entityName", "string").alias("entity_name"), F.try_variant_get("v", "$.facts", "map<string,variant>").alias("facts"))
    return top.select("cik", "entity_name", F.explode("facts").alias("taxonomy", "concepts"))


def ticker_rows(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """``(ticker, cik)`` from tab-separated lines; lines that do not fit are dropped, and of repeats the last one counts."""
    parts = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), "\t")
    number = F.element_at(parts, 2).try_cast("decimal(20,0)")
    kept = lines.select(F.upper(F.element_at(parts, 1)).alias("ticker"), number.alias("n"), F.expr(order or "0").alias("o"), F.size(parts).alias("k"), F.element_at(parts, 2).alias("raw")).where("k = 2")
    kept = kept.where(F.rlike("raw", F.lit(r"^\+?\d+$")) & (F.col("n") <= F.lit("18446744073709551615").cast("decimal(20,0)")))
    digits = F.col("n").cast("string")
    return kept.groupBy("ticker").agg(F.max_by(F.lpad(digits, F.greatest(F.lit(10), F.length(digits)), F.lit("0")), "o").alias("cik"))


def ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """The ticker map in the files at ``path``; ValueError if no line fits. Line order is the offset in the file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    found = ticker_rows(lines, order="at")
    if found.isEmpty():
        raise ValueError(f"no tickers in {path}")
    return found


def prompt_template(path: str | None, default: str) -> str:
    """The ``template`` of a prompt file, or the default if there is no such file. It must use the three fields."""
    import os
    import textwrap

    text = default
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            body = f.read()
        lines = body.split("\n")
        start = next((i for i, x in enumerate(lines) if x.startswith("template:")), None)
        if start is None:
            raise ValueError(f"{path} has no template")
        held = []
        for x in lines[start + 1 :]:
            if x and not x[0].isspace():
                break
            held.append(x)
        text = textwrap.dedent("\n".join(held)).strip("\n") + "\n"
    for name in ("symbol", "search_term", "chunk"):
        if "{" + name + "}" not in text:
            raise ValueError(f"the prompt template lacks {{{name}}}")
    return text
