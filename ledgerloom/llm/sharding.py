"""Sharding by weighted rendezvous hashing.

Method: a record's key and each shard's number are hashed together to a
uniform u; the record goes to the shard with the smallest -ln(u) / weight. Its
place depends on its own key and the list of shards only, so one more shard
takes records but moves none between the old ones (law ``key``). The law binds
single records: equal texts with different ids may part.

Scale: the choice is a row-wise expression. Numbering the rows of a shard does
not sort a shard in one task: equal rows are counted first, each shard is cut by the hash of
whole rows into pieces of about ``piece_rows`` rows, a count per piece gives its first slot, and rows are
numbered within their piece. So an id or a row that holds a third of all is spread like any other.
Only ids and two numbers are shuffled, not texts.

Nulls and edge cases: a null text has no bytes and the crc32 of the empty
text; a null doc_id hashes as the empty text; repeated rows fall in one shard
with different slots; a column of the input that has the name of a new one is kept under a name that ends in ``_in``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, table

DIGITS = 13


def shard_of(key: Column, weights: list[float]) -> Column:
    """The number of the shard with the best score for ``key``; the lower number on a tie."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        digest = F.md5(F.encode(F.concat(F.lit(f"{shard}:"), text), "UTF-8"))
        u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))

    return F.least(*[score(i, w) for i, w in enumerate(weights)])["shard"]


def place(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """``docs`` with an int column ``shard``, and ``grown_shard`` if a second list of weights is given."""
    new = {"shard", "grown_shard"} if grown else {"shard"}
    names = [c.lower() for c in docs.columns]
    for c in docs.columns:
        if c.lower() in new:
            kept = f"{c}_in"
            while kept.lower() in names:
                kept += "_in"
            docs = docs.withColumnRenamed(c, kept)
    out = docs.withColumn("shard", shard_of(F.col("doc_id"), weights))
    return out.withColumn("grown_shard", shard_of(F.col("doc_id"), grown)) if grown else out


def number_slots(placed: DataFrame, piece_rows: int = 20_000) -> DataFrame:
    """``placed`` with ``slot``: 0, 1, 2 ... within each shard. Its columns must be such that rows can be grouped by them.

    Copies of a row that has more than ``piece_rows`` are made by blocks of so many, which are dealt anew: no task makes them all, or holds their numbers.
    """
    shards = max(1, placed.select("shard").distinct().count())
    pieces = max(1, math.ceil(placed.count() / shards / piece_rows))
    row = F.struct(*[placed[c] for c in placed.columns])
    held = placed.select(row.alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    piece = F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int")
    cut = held.select("row", "n", F.col("row.shard").alias("shard"), piece.alias("piece"))
    counts = cut.groupBy("shard", "piece").agg(F.sum("n").alias("n"))
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("shard", "piece").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = cut.withColumn("at", F.sum("n").over(within) - F.col("n"))
    joined = numbered.join(first, ["shard", "piece"]).select("row", "n", (F.col("first") + F.col("at")).cast("long").alias("at"))
    block, many = F.lit(piece_rows).cast("long"), F.col("n") > piece_rows
    blocks = joined.where(many).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, block)))
    blocks = blocks.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "from")  # by number: few blocks make many rows
    copies = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + block, F.col("n")) - 1)).alias("copy")
    rows = joined.where(~many).withColumn("from", F.lit(0).cast("long")).unionByName(blocks).select("row", "at", copies)
    return rows.select("row.*", (F.col("at") + F.col("copy")).alias("slot"))


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 24 equal shards, and its shard among 25."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    placed = materialize(place(docs, [1.0] * 24, [1.0] * 25), "placed")
    return number_slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
