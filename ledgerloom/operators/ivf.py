"""An inverted-file index for vector search: points filed under the nearest of some centroids, so that a query reads a few files.

Centroids are fitted on a bounded sample of ``SAMPLE`` rows (those whose keys hash
lowest); every row is then filed. How many lists a search reads is settled by a
measurement: a bounded sample of rows is searched for in full, and as many lists
are read as it takes to find ``RECALL`` of what that search found. A list knows how far its farthest point lies
from its centroid, so a search can be made exact: lists that could still hold a
nearer point than the k-th found so far are read as well. The exact way without
an index is :func:`ledgerloom.operators.vectors.search_all`.

Rows without a vector, and for cosine those of length zero, have no place and are
left out, as in a search without an index.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.vectors import measure
from ledgerloom.operators.vectors import QUERY_TILE, best, matrix, nearest_of, search_all
from ledgerloom.shipping import ship
from ledgerloom.sources.shared import scratch

ship(__name__)

SAMPLE = 20_000
MOST_LISTS = 1 << 14
RECALL, MEASURED = 0.95, 256
#: Slack of bounds, above what rounding scores to nine digits can hide.
SLACK = 1e-4
METRICS = ("cosine", "euclid")
#: Distances to centroids that are held at once, and rows of ``(query, vector, bound, lists, shelf)`` in one batch.
CELLS, PAIRS = 1 << 20, 1 << 13


@dataclass
class Index:
    """What a search needs on the driver: ``path``, metric and key, centroids, radii and numbers of points by list, and lists to read."""

    path: str
    metric: str
    key: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    probes: int = 1


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as points whose distances order like the metric."""
    return x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)
    return np.sqrt(np.maximum(square, 0))


def _slices(rows: int, lists: int) -> Iterator[slice]:
    """So few of the rows at a time that their distances to all centroids are ``CELLS`` numbers at most."""
    step = max(1, CELLS // max(1, lists))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def _parts(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut by :func:`_slices`."""
    for batch in batches:
        for some in _slices(batch.num_rows, lists):
            yield batch.slice(some.start, some.stop - some.start)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from distinct rows of the sample; a list that loses all its rows moves to the row farthest from its own."""
    made, x = np.random.default_rng(seed), np.unique(x, axis=0)
    centroids = x[made.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        nearest, away = np.zeros(len(x), np.int64), np.zeros(len(x))
        for some in _slices(len(x), len(centroids)):
            d = _distances(x[some], centroids)
            nearest[some], away[some] = d.argmin(1), d.min(1)
        sums, n = np.zeros_like(centroids), np.bincount(nearest, minlength=len(centroids))
        np.add.at(sums, nearest, x)
        far = iter(np.argsort(-away, kind="stable"))
        centroids = np.stack([sums[i] / n[i] if n[i] else x[next(far)] for i in range(len(centroids))])
    return centroids


def build(vectors: DataFrame, path: str, vector: str = "vector", key: str = "id", metric: str = "Cosine", lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL, k: int = 10) -> Index:
    """File all rows of ``vectors`` under ``path``. ``lists`` is the root of the number of rows unless given, 16,384 at most.

    ``recall`` is what searches for ``k`` points are to reach; it is measured on ``MEASURED`` rows.
    """
    metric = metric.lower()
    if metric not in METRICS:
        raise ValueError(f"no index for {metric}: its scores are no distances; use search_all")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null")
    if metric == "cosine":
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    lists = min(MOST_LISTS, lists or max(1, math.isqrt(rows.count())))
    some = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").collect()
    centroids = fit_centroids(_placed(np.array([r.vector for r in some]), metric), lists) if some else np.zeros((0, 0))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, len(centroids)):
            d = _distances(_placed(matrix(batch.column(1)), metric), centroids)
            nearest = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest])], names=["key", "vector", "list", "away"])

    kind = vectors.schema[key].dataType.simpleString()
    filed = rows.mapInArrow(file, f"key {kind}, vector array<double>, list int, away double")
    # By range of list and a hash: a list that holds a third of all rows is cut like the others.
    filed.withColumn("spread", F.xxhash64("key")).repartitionByRange("list", "spread").drop("spread").write.partitionBy("list").parquet(f"{path}/lists")
    spark = vectors.sparkSession
    back = spark.read.schema(f"key {kind}, vector array<double>, away double, list int").parquet(f"{path}/lists")
    known = back.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").join(known, "list", "left").fillna({"radius": 0.0, "n": 0})
    probes = _measured(back, centroids, metric, recall, k)
    table.withColumns({"metric": F.lit(metric), "key": F.lit(key), "probes": F.lit(probes)}).coalesce(1).write.parquet(f"{path}/centroids")
    return load(spark, path, metric, key)


def _measured(filed: DataFrame, centroids: np.ndarray, metric: str, recall: float, k: int) -> int:
    """The least number of lists, nearest to a query first, that hold ``recall`` of the ``k`` points nearest to the rows of a sample."""
    asked = filed.orderBy(F.xxhash64(F.lit("measure"), "key"), "key").limit(MEASURED)
    found = search_all(filed, asked, k, metric, "vector", "key").select("query", "key")
    rows = found.join(filed.select("key", "list"), "key").join(asked.select(F.col("key").alias("query"), "vector"), "query").select("vector", "list").collect()
    if not rows:
        return 1
    x, own, place = _placed(np.array([r["vector"] for r in rows]), metric), np.array([r["list"] for r in rows]), np.zeros(len(rows), np.int64)
    for some in _slices(len(x), len(centroids)):
        order = np.argsort(_distances(x[some], centroids), axis=1, kind="stable")
        place[some] = (order == own[some, None]).argmax(1)
    return int(np.sort(place)[math.ceil(recall * len(place)) - 1]) + 1


def load(spark: SparkSession, path: str, metric: str = "cosine", key: str = "id") -> Index:
    """An index that was built before; ``metric`` and ``key`` are those of an empty one only."""
    held = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])  # one row a list
    if held:
        metric, key = held[0]["metric"], held[0]["key"]
    columns = (np.array([r[c] for r in held]) for c in ("centroid", "radius", "n"))
    return Index(path, metric, key, *columns, held[0]["probes"] if held else 1)


def _shelves(sizes: np.ndarray, point_block: int) -> np.ndarray:
    """The shelf of each list: neighbours by number share one as long as they have ``point_block`` points at most; a larger list has its own."""
    shelf, at, filled = np.zeros(len(sizes), np.int32), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if filled and n and filled + n > point_block:
            at, filled = at + 1, 0
        shelf[i], filled = at, filled + n
    return shelf


def _asked(queries: DataFrame, index: Index, shelf: np.ndarray, lists: Callable) -> DataFrame:
    """``(query, vector, bound, lists, shelf)``: a row for each shelf with any of the lists that ``lists(distances, bound)`` chooses for a query of ``(query, vector, bound)``."""
    centroids, metric = index.centroids, index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, len(centroids)) if len(centroids) else ():
            d = _distances(_placed(matrix(batch.column(1)), metric), centroids)
            row, chosen = (x.astype(np.int32) for x in np.nonzero(lists(d, batch.column(2).to_numpy(zero_copy_only=False))))
            on = shelf[chosen]
            starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(on) != 0)][: len(row)])
            ends = np.r_[starts, len(row)].astype(np.int32)
            for i in range(0, len(starts), PAIRS):
                at, cut = starts[i : i + PAIRS], ends[i : i + PAIRS + 1]
                named = pa.ListArray.from_arrays(pa.array(cut - cut[0]), pa.array(chosen[cut[0] : cut[-1]]))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[at])) for c in batch.columns), named, pa.array(on[at])], names=["query", "vector", "bound", "lists", "shelf"])

    kind = queries.schema["query"].dataType.simpleString()
    return queries.select("query", "vector", "bound").mapInArrow(run, f"query {kind}, vector array<double>, bound double, lists array<int>, shelf int")


def _nearest_in_lists(left: pa.Table, right: pa.Table, k: int, metric: str) -> pa.Table:
    """``(query, key, score)``: the ``k`` best rows of ``right`` for each of ``left``, of the lists it names and with costs up to its ``bound``.

    A list at a time meets the queries that name it, a tile of them at once. What was found is cut to ``k`` a query whenever it is twice that.
    """
    right = right.take(pc.sort_indices(right["key"])) if len(left) else right[:0]
    queries, points = (matrix(x["vector"]) if len(right) else np.zeros((0, 0)) for x in (left, right))
    lists = left["lists"].combine_chunks()
    parent, named = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
    of, kth = right["list"].to_numpy(), left["bound"].to_numpy().copy()
    by_list = np.argsort(of, kind="stable")
    by_name = np.argsort(named, kind="stable")
    of, parent, named = of[by_list], parent[by_name], named[by_name]
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    held, new, rows = nothing, [], 0

    def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, at, cost, last = best(*(np.concatenate(x) for x in zip(held, *new, strict=True)), k)
        kth[row[last]] = np.minimum(kth[row[last]], cost[last])
        return row, at, cost

    for one in np.unique(of):
        mine = by_list[slice(*np.searchsorted(of, [one, one + 1]))]
        asking = parent[slice(*np.searchsorted(named, [one, one + 1]))]
        for begin in range(0, len(asking), QUERY_TILE):
            some = asking[begin : begin + QUERY_TILE]
            row, at, cost = nearest_of(queries[some], points[mine], k, metric, kth[some])
            new.append((some[row], mine[at], cost))
            rows += len(row)
        if rows > 2 * k * len(left):
            held, new, rows = cut(), [], 0
    row, at, cost = cut()
    score = cost if measure(metric)[1] else -cost
    return pa.table({"query": left["query"].take(pa.array(row)), "key": right["key"].take(pa.array(at)), "score": pa.array(score)})


def _read_lists(queries: DataFrame, index: Index, lists: Callable, k: int, query_block: int, point_block: int) -> DataFrame:
    """``(query, key, score)``: for each row of ``(query, vector, bound)``, the ``k`` best points of each shelf, of the lists chosen and with costs up to ``bound``.

    Lists stand on shelves of ``point_block`` points, so that a query is sent once for many lists and gives ``k`` rows for them
    together. On a shelf each block of queries meets each block of points in one task, so neither a list with most points nor
    one that most queries ask for is one task's work. Only the lists on shelves that are asked for are read.
    """
    spark, metric = queries.sparkSession, index.metric
    shelf = _shelves(index.sizes, point_block)
    asked = _asked(queries, index, shelf, lists)
    counts = {r["shelf"]: r["count"] for r in asked.groupBy("shelf").count().collect()}  # one row a shelf
    kind = asked.schema["query"].dataType.simpleString()
    out = f"query {kind}, key {kind}, score double"
    if not counts:
        return spark.createDataFrame([], out)
    points_on = np.bincount(shelf, weights=index.sizes)
    blocks = {i: (-(-n // query_block), max(1, -(-int(points_on[i]) // point_block))) for i, n in counts.items()}
    wanted = [(i, int(s), *blocks[s]) for i, s in enumerate(shelf.tolist()) if s in blocks and index.sizes[i]]
    points = spark.read.schema(f"key {kind}, vector array<double>, away double, list int").parquet(f"{index.path}/lists")
    points = points.where(F.col("list").isin([i for i, *_ in wanted]))
    by_list = F.broadcast(spark.createDataFrame(wanted, "list int, shelf int, qs int, ps int"))
    by_shelf = F.broadcast(spark.createDataFrame([(s, *b) for s, b in blocks.items()], "shelf int, qs int, ps int"))

    def dealt(df: DataFrame, name: str, mine: str, theirs: str, other: str, *columns: str) -> DataFrame:
        own = F.pmod(F.xxhash64(name), F.col(mine)).cast("int").alias(mine[0])
        every = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias(other)
        return df.select("shelf", name, "vector", *columns, own, every)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest_in_lists(left, right, k, metric)

    keys = ["shelf", "q", "p"]
    q = dealt(asked.join(by_shelf, "shelf"), "query", "qs", "ps", "p", "bound", "lists")
    p = dealt(points.join(by_list, "list"), "key", "ps", "qs", "q", "list")
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(run, out)


def _ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    order = F.col("score").asc() if metric == "euclid" else F.col("score").desc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "key")))
    return ranked.where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, vector: str = "vector", key: str | None = None, query_block: int = 1024, point_block: int = 32_768) -> DataFrame:
    """``(query, key, score, rank)``: the ``k`` nearest points that are filed in the ``probes`` lists nearest to each query.

    ``exact`` also reads the lists whose bound says that they may hold a nearer point, and so gives what a search of all
    points gives. Unless given, ``probes`` is the index's own number.
    """
    probes = probes or index.probes
    asked = queries.select(F.col(key or index.key).alias("query"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null")
    if index.metric == "cosine":
        asked = asked.where(F.exists("vector", lambda x: x != 0))
    radii, sizes, metric = index.radii, index.sizes, index.metric

    def nearest(d: np.ndarray, _) -> np.ndarray:
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, np.argsort(np.where(sizes > 0, d, np.inf), axis=1, kind="stable")[:, :probes], True, 1)
        return out & (sizes > 0)

    def open_still(d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        away = np.sqrt(np.maximum(2 + 2 * bound, 0)) if metric == "cosine" else bound
        return (d - radii <= away[:, None] + SLACK) & (sizes > 0) & ~nearest(d, None)

    all_of = asked.withColumn("bound", F.lit(float("inf")))
    first = _ranked(_read_lists(all_of, index, nearest, k, query_block, point_block), k, index.metric)
    if exact:
        # What was found is both the bound of what follows and a part of the result: written, it is made once.
        path = scratch(asked.sparkSession, "found")
        first.write.parquet(path)
        first = asked.sparkSession.read.schema(first.schema).parquet(path)
        cost = F.col("score") if index.metric == "euclid" else -F.col("score")
        bounds = first.groupBy("query").agg(F.when(F.count("*") == k, F.max(cost)).alias("bound"))
        wide = asked.join(bounds, "query", "left").fillna({"bound": float("inf")})
        more = _read_lists(wide, index, open_still, k, query_block, point_block)
        first = _ranked(first.drop("rank").unionByName(more), k, index.metric)
    return first.withColumnRenamed("key", index.key)


def recall(found: DataFrame, truth: DataFrame, key: str = "id") -> float:
    """The share of the rows of an exact search that another one has too."""
    pair = ["query", key]
    return truth.select(*pair).join(found.select(*pair), pair, "left_semi").count() / max(1, truth.count())
