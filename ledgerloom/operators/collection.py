"""Vector collections on a shared file system: points in buckets by id, layers of them, and numbered manifests.

A collection is a folder:

* ``collection.json``: its size, metric and number of buckets, fixed when it is made
* ``segments/<name>/bucket=<b>``: Parquet files that are written once and never changed
* ``manifests/<version>.json``: for each bucket the segments that hold it, oldest
  first, and the last batch of each stream

An upsert writes its points as a further layer of the buckets they fall in and
reads nothing of what is there, so its cost follows its own rows. A bucket that
has reached ``LAYERS`` layers is merged by the upsert that touches it next, and
only that bucket is read and written. A commit is one new manifest, made under a
name that must not exist: of two writers that began at the same version the
later one is refused. Readers take the newest manifest and keep to it; later
commits and merges do not touch its files until :func:`vacuum` does.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.schemas import POINT
from ledgerloom.sources.shared import delete

LAYERS = 4
BUCKETS = 64
METRICS = ("Cosine", "Euclid", "Dot")


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict:
    where, fs = _fs(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def _publish(spark: SparkSession, path: str, value: dict) -> bool:
    """Write a file that must not exist yet; false if it does. Nobody sees a part of it."""
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    (temporary, fs), final = _fs(spark, part), _fs(spark, path)[0]
    out = fs.create(temporary, False)
    out.write(json.dumps(value).encode())
    out.close()
    if fs.getScheme() != "file":
        done = fs.rename(temporary, final)  # refuses a name that exists
    else:
        try:
            os.link(temporary.toUri().getPath(), final.toUri().getPath())  # a local rename would replace it
            done = True
        except FileExistsError:
            done = False
    fs.delete(temporary, False)
    return done


def ensure_collection(spark: SparkSession, path: str, size: int | None = None, metric: str = "Cosine", load=None, buckets: int = BUCKETS) -> dict:
    """The collection's properties; made from the arguments if it does not exist, else read and left as they are."""
    where, fs = _fs(spark, f"{path}/collection.json")
    if not fs.exists(where):
        if size is None:
            from ledgerloom.operators.vectors import dimension, hashing_embedder

            size = dimension(load or hashing_embedder)
        _publish(spark, f"{path}/collection.json", {"size": size, "metric": metric if metric in METRICS else "Cosine", "buckets": buckets})
    return _read(spark, f"{path}/collection.json")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The newest manifest, or one of a version; an empty one of version 0 if nothing was committed."""
    if version is None:
        found = [n for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]
        if not found:
            return {"version": 0, "buckets": {}, "batches": {}}
        version = int(found[-1][:-5])
    return _read(spark, f"{path}/manifests/{version:020d}.json")


def _layered(spark: SparkSession, path: str, buckets: dict[str, list[str]]) -> DataFrame | None:
    """The newest point of each id in the given buckets. Buckets of one layer are read as they are."""
    at = lambda b, segment: f"{path}/segments/{segment}/bucket={b}"
    read = lambda paths: spark.read.parquet(*paths)
    single = [at(b, layers[0]) for b, layers in buckets.items() if len(layers) == 1]
    several = {b: layers for b, layers in buckets.items() if len(layers) > 1}
    parts = [read(single)] if single else []
    if several:
        deep = None
        for i in range(max(map(len, several.values()))):
            layer = read([at(b, layers[i]) for b, layers in several.items() if len(layers) > i]).withColumn("_layer", F.lit(i))
            deep = layer if deep is None else deep.unionByName(layer, allowMissingColumns=True)
        newest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("_layer").desc()))
        parts.append(deep.withColumn("_newest", newest).where("_newest = 1").drop("_layer", "_newest"))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_collection(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All points as of the newest commit, or of an earlier version that was not vacuumed."""
    found = _layered(spark, path, manifest(spark, path, version)["buckets"])
    return spark.createDataFrame([], POINT) if found is None else found


def _write(points: DataFrame, path: str) -> tuple[str, list[str]]:
    """Write points with a column ``bucket`` as a new segment; its name and the buckets it has. One task writes a bucket."""
    name = uuid.uuid4().hex
    points.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/segments/{name}")
    return name, [n.partition("=")[2] for n in _names(points.sparkSession, f"{path}/segments/{name}") if n.startswith("bucket=")]


def upsert(points: DataFrame, path: str, batch: tuple[str, int] | None = None, base: dict | None = None, **collection) -> DataFrame:
    """Add points to a collection, over those of the same ids, and return their ids.

    ``batch`` names a stream and its batch: one that was committed before adds nothing, so a stream that repeats a
    batch after a failure adds it once. ``base`` is the manifest to build on, the newest unless given; if another
    commit has come since, this one is refused with :class:`CommitConflict` and leaves nothing.
    """
    spark = points.sparkSession
    n = ensure_collection(spark, path, **collection)["buckets"]
    new = points.dropDuplicates(["id"])  # of one id any: ids name the text they stand for
    base = base or manifest(spark, path)
    if batch is not None and base["batches"].get(batch[0], -1) >= batch[1]:
        return new.select("id")
    segment, touched = _write(new.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), path)
    buckets = {b: list(layers) for b, layers in base["buckets"].items()}
    for b in touched:
        buckets.setdefault(b, []).append(segment)
    made = [segment]
    if deep := {b: buckets[b] for b in touched if len(buckets[b]) > LAYERS}:
        merged = _layered(spark, path, deep).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        whole, _ = _write(merged, path)
        buckets.update({b: [whole] for b in deep})
        made.append(whole)
    batches = base["batches"] | ({batch[0]: batch[1]} if batch else {})
    if touched or batch:
        version = base["version"] + 1
        if not _publish(spark, f"{path}/manifests/{version:020d}.json", {"version": version, "buckets": buckets, "batches": batches}):
            for name in made:
                delete(spark, f"{path}/segments/{name}")
            raise CommitConflict(f"version {version} of {path} was committed by another writer")
    return new.select("id")


def rebucket(spark: SparkSession, path: str, buckets: int, to: str) -> None:
    """Copy a collection to another folder with another number of buckets, for one that has outgrown its own."""
    properties = ensure_collection(spark, path)
    held = read_collection(spark, path)
    upsert(held, to, size=properties["size"], metric=properties["metric"], buckets=buckets)


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86_400) -> int:
    """Delete manifests before the newest ``keep``, and segments that none of these name and that are older than so many seconds; how many."""
    names = [n for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]
    live = {s for n in names[-keep:] for layers in _read(spark, f"{path}/manifests/{n}")["buckets"].values() for s in layers}
    for n in names[:-keep]:
        delete(spark, f"{path}/manifests/{n}")
    where, fs = _fs(spark, f"{path}/segments")
    now, gone = spark.sparkContext._jvm.System.currentTimeMillis(), 0
    for f in fs.listStatus(where) if fs.exists(where) else []:
        if f.getPath().getName() not in live and now - f.getModificationTime() >= older_than * 1000:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone
