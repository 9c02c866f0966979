"""Command line of the filings pipeline."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
import shutil
from collections.abc import Iterator
from datetime import date, timedelta
from pathlib import Path

from ledgerloom.config import MODES, RunConfig, Settings, form_of
from ledgerloom.operators.summarize import PROMPT, model
from ledgerloom.sources.files import prompt_template

FORMATS = {"simple": "%(levelname)s %(message)s", "detailed": "%(asctime)s %(name)s %(levelname)s %(message)s", "json": None}


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})


def set_up_logging(level: str = "INFO", kind: str = "simple", file: str | None = None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        handlers.append(logging.FileHandler(file))
    for h in handlers:
        h.setFormatter(JsonFormatter() if kind == "json" else logging.Formatter(FORMATS[kind]))
    logging.basicConfig(level=level, handlers=handlers, force=True)


@contextlib.contextmanager
def log_level(name: str, level: int) -> Iterator[None]:
    """Another level for a logger, for a while."""
    logger = logging.getLogger(name)
    before = logger.level
    logger.setLevel(level)
    try:
        yield
    finally:
        logger.setLevel(before)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    today = date.today()
    p = argparse.ArgumentParser(prog="ledgerloom", description="Summarise filings that mention a keyword.")
    p.add_argument("symbols", nargs="*", default=["AAPL"])
    p.add_argument("--mode", choices=[*MODES], default="annual")
    p.add_argument("--start_date", type=date.fromisoformat, default=today - timedelta(days=365))
    p.add_argument("--end_date", type=date.fromisoformat, default=today)
    p.add_argument("--keyword", default="revenue")
    p.add_argument("--prompt_file")
    p.add_argument("--model_name", default="extractive")
    p.add_argument("--limit", type=int, default=1)
    p.add_argument("--max-new-tokens", type=int, default=1024)
    p.add_argument("--max-retries", type=int, default=2)
    p.add_argument("--batch-size", type=int, default=16)
    for flag in ("--no-require-json", "--fresh", "--no-cleanup", "--verbose", "--dry-run"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--log-format", choices=[*FORMATS])
    p.add_argument("--log-file")
    p.add_argument("--fetch", action="store_true", help="fetch filings accepted between the dates instead of reading the tree under --downloads")
    p.add_argument("--what", choices=("document", "submission"), default="document", help="with --fetch: primary documents, or full submissions and the documents of the form in them")
    p.add_argument("--downloads", default="data/downloads")
    p.add_argument("--output", default="data/output")
    return p.parse_args(argv)


def prepare(output: str, downloads: str, fresh: bool) -> None:
    """Make both folders. ``fresh`` empties the output and forgets what earlier runs landed; a tree of filings there is input and stays."""
    if fresh:
        shutil.rmtree(output, ignore_errors=True)
        shutil.rmtree(f"{downloads}/landed", ignore_errors=True)
    for folder in (output, downloads):
        Path(folder).mkdir(parents=True, exist_ok=True)


def main(argv: list[str] | None = None, spark=None, transport=None) -> list[tuple]:
    """Run for the given symbols; cleaning up deletes what this run fetched, never other files."""
    a = arguments(argv)
    settings = Settings.load()
    set_up_logging("DEBUG" if a.verbose else settings.log_level, a.log_format or settings.log_format, a.log_file)
    config = RunConfig(
        keyword=a.keyword, mode=a.mode, start_date=a.start_date, end_date=a.end_date, limit=a.limit, max_new_tokens=a.max_new_tokens,
        max_retries=a.max_retries, batch_size=a.batch_size, require_json=not a.no_require_json, dry_run=a.dry_run,
        collection_prefix=settings.collection_prefix, template=prompt_template(a.prompt_file, PROMPT), embedding_batch=settings.embedding_batch_size, distance=settings.distance,
        embedding_model=settings.embedding_model, vector_size=settings.vector_size, store_timeout=settings.store_timeout,
        store_location=settings.store_location if settings.store == "http" else None,
    )
    from pyspark.sql import SparkSession

    from ledgerloom.plans import downloads
    from ledgerloom.plans.pipeline import run, run_files

    prepare(a.output, a.downloads, a.fresh)
    spark = spark or SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    logging.getLogger("ledgerloom").info("%s", downloads.Symbols(a.symbols, a.downloads))
    if a.fetch:
        http = {"transport": transport} if transport else {}
        landed, said = downloads.download_symbols(spark, a.symbols, a.downloads, settings.agent, form_of(a.mode), a.start_date, a.end_date, a.limit, a.what, **http)
        files = downloads.as_files(landed) if a.what == "document" else downloads.submission_files(landed)
        done = run_files(spark, files, said, a.output, config, model(a.model_name))
    else:
        done = run(spark, a.downloads, a.output, a.symbols, config, model(a.model_name))
    rows = [tuple(r) for r in done.collect()]  # a row for each symbol
    for r in rows:
        logging.getLogger("ledgerloom").info("%s ok=%s error=%s documents=%s matches=%s points=%s", *r)
    if a.fetch and not a.no_cleanup:
        downloads.discard(landed)
    return rows


if __name__ == "__main__":
    main()
