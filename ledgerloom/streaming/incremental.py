"""Summaries and vectors of filings as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.config import RunConfig
from ledgerloom.operators.summarize import Model, extractive_model
from ledgerloom.plans.pipeline import keep_points, matches, summaries
from ledgerloom.sources.files import TREE


def incoming(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of whole HTML files under the tree, with the keys in their path."""
    lines = (
        spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{html,htm}").option("maxFilesPerTrigger", files_per_batch).load(f"{root}/{TREE}")
    )
    parts = F.split(F.col("_metadata.file_path"), "/")
    names = {"symbol": -4, "form": -3, "accession": -2, "document": -1}
    return lines.select(F.col("value").alias("html"), *[F.element_at(parts, F.lit(i)).alias(n) for n, i in names.items()])


def summarize_stream(spark: SparkSession, root: str, out: str, checkpoint: str, config: RunConfig, ask: Model = extractive_model) -> StreamingQuery:
    """Envelopes and, unless dry, points of each batch of new files.

    A batch that is done again after a failure counts once: its envelopes go to a folder of its own, which is written
    anew, and its points are refused by the collection if their commit was the one before the failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = matches(batch, config).persist()
        try:
            if not config.dry_run:
                keep_points(found, config, out, (checkpoint, number))
            summaries(found, config, ask).write.mode("overwrite").json(f"{out}/summaries/batch={number}")
        finally:
            found.unpersist()

    return incoming(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
