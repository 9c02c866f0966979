"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Code used inside tasks travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ship(module_name: str) -> None:
    """Send the functions of a module to the executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local-mode session gets a temporary folder;
    on a cluster that would lose data, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame, free: bool = True) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more, and, if ``free``, let go of finished shuffles.

    Shuffle files go once the driver's JVM has collected what refers to them; in a
    long run of jobs it may not do so by itself before the disks fill up.
    """
    spark = tables[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(conf).delete(path, True)
    if free:
        release(spark)


def release(spark: SparkSession) -> None:
    """Let go of finished shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_of_id(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8"))


def row_key() -> list[Column]:
    """128 bits that name a row by its id and text; never null, so safe to join on."""
    return [
        F.xxhash64("doc_id", "text").alias("key1"),
        F.xxhash64(F.lit("k"), "text", "doc_id").alias("key2"),
    ]


def bit_map(keys: DataFrame, bits: int = 25) -> np.ndarray:
    """Words of 32 bits, a power of two of them, in which the last bits of each hash in the only column of ``keys`` name a bit that is set.

    It has ``2 ** bits`` bits at most, less for fewer keys, so what reaches the driver and the tasks is bounded.
    """
    places = keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)).alias("place"))
    words = places.select(F.shiftright("place", 5).alias("word"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    packed = np.zeros(1 << (bits - 5), np.uint32)
    packed[got.column("word").to_numpy()] = got.column("bit").to_numpy().astype(np.uint32)
    held = int(np.bitwise_count(packed).sum())
    while len(packed) > 2 * max(16, held):  # 32 bits a key or more, as far as there are so many
        packed = packed[: len(packed) // 2] | packed[len(packed) // 2 :]
    return packed


def in_bit_map(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each long hash whether its bit of :func:`bit_map` is set."""
    place = hashes & (len(packed) * 32 - 1)
    return packed[place >> 5] >> (place & 31).astype(np.uint32) & 1 == 1


def maybe_among(keys: DataFrame, bits: int = 25) -> Callable[[Column], Column]:
    """A test whether a long hash may be one of the only column of ``keys``: never false for one of them, and seldom true for others.

    It is a :func:`bit_map`. Beyond some millions of keys it says yes more often: it may only save work, such as sending rows to a join.
    """
    packed = bit_map(keys, bits)

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bit_map(packed, hashes.to_numpy(np.int64)))

    return test


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Label each node of an undirected graph with the smallest node it reaches.

    ``edges`` has long columns ``a`` and ``b``. Alternates large-star and
    small-star steps, each two aggregations and joins by node, until the edges
    stop changing; every round is written to the shared folder. Returns
    ``(node, root)`` for each node that has an edge.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = _signature(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
            ).alias("e")
        )
        earlier, edges = edges, materialize(small.select("e.*").where("a <> b").distinct(), "edges")
        before, mark = mark, _signature(edges)
        discard(earlier, free=False)
        if before == mark:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(got[0]), int(got[1])
