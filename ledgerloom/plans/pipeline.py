"""The filings pipeline: files to text, chunks, matches, vectors and summaries, as one lazy plan for each branch."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.config import RunConfig, form_of
from ledgerloom.functions.text import collection_slug, has_keyword, html_text, safe_name, slugify
from ledgerloom.operators.chunking import matching_chunks
from ledgerloom.operators.summarize import PROMPT, Model, envelopes, extractive_model, summarize
from ledgerloom.operators.collection import upsert
from ledgerloom.operators.vectors import dimension, embed, embedder, with_ids
from ledgerloom.operators.remote import ensure_remote, push_points
from ledgerloom.sources.files import html_files, symbol_status
from ledgerloom.sources.http import Sending, urllib_sending
from ledgerloom.sources.named import register

KEYS = ["symbol", "form", "accession", "document"]


def matches(files: DataFrame, config: RunConfig, chunker: str = "fixed") -> DataFrame:
    """Chunks of the files' text that have the keyword, with the document's keys."""
    docs = files.select(*KEYS, html_text(F.col("html"), bare=config.bare_references).alias("text"))
    if chunker == "recursive":
        keyed = docs.withColumn("doc_id", F.to_json(F.struct(*KEYS)))
        cut = matching_chunks(keyed, config.keyword, chunker, config.chunk_size, config.chunk_overlap)
        key = F.from_json("doc_id", ", ".join(f"{k} string" for k in KEYS))
        return cut.select(*[key[k].alias(k) for k in KEYS], "chunk_pos", "start_index", "text")
    return matching_chunks(docs, config.keyword, chunker, config.chunk_size, config.chunk_overlap)


def points(found: DataFrame, config: RunConfig, collection: Column) -> DataFrame:
    """Vector points of the matching chunks, with deterministic ids."""
    rows = found.select(*KEYS, "chunk_pos", "text", F.col("document").alias("source"), F.lit(config.keyword).alias("keyword"), collection.alias("collection"))
    made = with_ids(embed(rows, embedder(config.embedding_model, config.vector_size), batch=config.embedding_batch), "collection", "accession", "document", "chunk_pos", "text")
    return made.select("id", "collection", "vector", "source", "symbol", "keyword", "text")


def summaries(found: DataFrame, config: RunConfig, ask: Model = extractive_model) -> DataFrame:
    """One envelope for each document with at least one match."""
    most = None if getattr(ask, "whole", False) else 4 * config.max_new_tokens
    got = summarize(found, KEYS, config.keyword, ask, config.batch_size, config.max_retries, config.require_json, most, config.template or PROMPT)
    slug = collection_slug(F.col("symbol"), config.keyword, config.collection_prefix)
    return envelopes(got, KEYS).withColumn("collection", slug)


def output_name(config: RunConfig):
    """``<symbol>_<keyword>_<accession>_<stem>.summary.json``: the accession keeps filings with equal file names apart."""
    stem = safe_name(F.regexp_replace("document", r"\.[^.]*$", ""))
    return F.concat_ws("_", F.lower("symbol"), slugify(F.lit(config.keyword)), safe_name(F.col("accession")), F.concat(stem, F.lit(".summary.json")))


def stage_counts(chunks: DataFrame, keyword: str, symbol: str, document: str) -> DataFrame:
    """``(symbol, n_chunks, n_relevant, n_docs)``: how many chunks there are, how many have the keyword, and of how many documents."""
    relevant = F.count_if(has_keyword(F.col("text"), keyword)).alias("n_relevant")
    return chunks.groupBy(F.col(symbol).alias("symbol")).agg(F.count("*").alias("n_chunks"), relevant, F.countDistinct(document).alias("n_docs"))


def run(spark: SparkSession, root: str, out: str, symbols: list[str], config: RunConfig, ask: Model = extractive_model) -> DataFrame:
    """:func:`run_files` over the newest files of a tree, for all symbols."""
    status = symbol_status(spark, root, symbols, form_of(config.mode))
    return run_files(spark, html_files(spark, root, symbols, form_of(config.mode), config.limit), status, out, config, ask)


def named(made: DataFrame, config: RunConfig) -> DataFrame:
    """``(name, content)``: the envelopes as JSON with their output names. Documents whose names would be the same get a hash of their keys."""
    name = output_name(config)
    mark = F.substring(F.sha2(F.to_json(F.struct(*KEYS)), 256), 1, 8)
    several = F.count("*").over(W.partitionBy("name")) > 1
    apart = F.regexp_replace("name", r"\.summary\.json$", F.concat(F.lit("_"), mark, F.lit(".summary.json")))
    content = F.to_json(F.struct("symbol", "form", "accession", "document", "collection", "summaries"), {"pretty": "true", "ignoreNullFields": "false"})
    return made.withColumn("name", name).select(F.when(several, apart).otherwise(F.col("name")).alias("name"), content.alias("content"))


def keep_points(found: DataFrame, config: RunConfig, out: str, batch: tuple[str, int] | None = None, sending: Sending = urllib_sending) -> None:
    """Embed matching chunks and put them into the collection under ``out``, and into the vector store if one is set.

    A store request that fails is an error: its points are in the files, and the next run sends them again.
    """
    made = points(found, config, collection_slug(F.col("symbol"), config.keyword, config.collection_prefix))
    size = dimension(embedder(config.embedding_model, config.vector_size))
    upsert(made, f"{out}/collections", batch, size=size, metric=config.distance)
    if config.store_location:
        send = partial(sending, timeout=config.store_timeout) if sending is urllib_sending else sending
        for row in made.select("collection").distinct().collect():  # one for each symbol
            ensure_remote(config.store_location, row["collection"], size, config.distance, send)
        failed = push_points(made, config.store_location, sending=send).where("error is not null").first()
        if failed:
            raise RuntimeError(f"the vector store did not take points of {failed['collection']}: {failed['error']}")


def run_files(spark: SparkSession, files: DataFrame, status: DataFrame, out: str, config: RunConfig, ask: Model = extractive_model, sending: Sending = urllib_sending) -> DataFrame:
    """Write each document's summaries as a JSON file of its name under ``out`` and points unless dry.

    Returns ``status`` (a row for each symbol) with the numbers of its documents written, chunks that match and points kept.
    A run replaces the files of the names it makes and no others. All symbols' points go in one upsert to one collection,
    told apart by ``collection``.
    """
    register(spark)
    found = matches(files, config).persist()  # both sinks and the counts read it
    try:
        if not config.dry_run:
            keep_points(found, config, out, sending=sending)
        named(summaries(found, config, ask), config).write.format("ledgerloom_files").mode("append").option("path", f"{out}/summaries").save()
        kept = F.count("*") if not config.dry_run else F.lit(0).cast("long")
        per = found.groupBy("symbol").agg(F.countDistinct(F.struct(*KEYS)).alias("documents"), F.count("*").alias("matches"), kept.alias("points"))
        done = status.join(spark.createDataFrame(per.collect(), per.schema), "symbol", "left")  # a row for each symbol
    finally:
        found.unpersist()
    return done.fillna(0, ["documents", "matches", "points"])
