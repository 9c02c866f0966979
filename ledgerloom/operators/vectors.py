"""Embedding, vector collections and search."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import stable_id
from ledgerloom.functions.vectors import measure
from ledgerloom.shipping import ship

ship(__name__)

#: An embedder takes texts and gives a matrix with a row for each.
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(size: int = 64) -> Embedder:
    """Signed feature hashing of lower-cased words, scaled to length one. Offline and the same everywhere."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                out[i, code % size] += 1 if code >> 31 else -1
            length = np.linalg.norm(out[i])
            if length:
                out[i] /= length
        return out

    return embed


#: Embedders by name; ``prefix:rest`` names are looked up by their prefix and called with the rest. Each gives what a worker loads.
EMBEDDERS: dict[str, Callable[[str, int | None], Callable[[], Embedder]]] = {"hashing": lambda rest, size: lambda: hashing_embedder(size or int(rest or 64))}


def embedder(name: str, size: int | None = None) -> Callable[[], Embedder]:
    """The loader of an embedder; ValueError if there is none of that name, or if its vectors have another ``size`` than asked for."""
    kind, _, rest = name.partition(":")
    if kind not in EMBEDDERS:
        raise ValueError(f"no embedder {kind!r}; register it in EMBEDDERS")
    load = EMBEDDERS[kind](rest, size)
    if size is not None and dimension(load) != size:
        raise ValueError(f"{name} gives vectors of {dimension(load)} numbers, not {size}")
    return load


def embed(df: DataFrame, load: Callable[[], Embedder] = hashing_embedder, text: str = "text", batch: int = 32) -> DataFrame:
    """Adds ``vector``. ``load`` runs once for each worker; texts go to it ``batch`` at a time, and only so many are held as strings."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for part in parts:
            made = [np.asarray(encode([t or "" for t in part[i : i + batch].to_pylist()]), np.float32) for i in range(0, len(part), batch)]
            rows = np.concatenate(made) if made else np.zeros((0, 1), np.float32)
            starts = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            yield pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(rows.ravel()))

    return df.withColumn("vector", run(F.col(text)))


def dimension(load: Callable[[], Embedder] = hashing_embedder) -> int:
    """The length of the vectors, from one probe."""
    return len(load()(["probe"])[0])


def with_ids(points: DataFrame, *parts: str) -> DataFrame:
    return points.withColumn("id", stable_id(*[F.col(p) for p in parts]))


def merge_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """The points of both by id; those that come again replace the ones there."""
    return old.join(new, "id", "left_anti").unionByName(new, allowMissingColumns=True)


def search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "Cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """The ``k`` nearest points with their ``score``; each task keeps only its own k before they meet."""
    score, ascending = measure(metric)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", score(F.col(vector), q)).where("score is not null")
    return scored.orderBy(F.col("score").asc() if ascending else F.col("score").desc(), key).limit(k)


def scores(metric: str, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """A score of each query (rows) and point (columns); NaN where a vector of length zero has no angle."""
    name = metric.lower()
    products = queries @ points.T
    if name == "dot":
        return products
    q, p = (np.linalg.norm(x, axis=1) for x in (queries, points))
    if name == "euclid":
        # Row by row: differences keep the digits that the products would lose.
        return np.stack([np.linalg.norm(points - x, axis=1) for x in queries]) if len(queries) else products
    with np.errstate(divide="ignore", invalid="ignore"):
        return products / np.outer(q, p)


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors as rows of doubles, without an object for each number."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if pc.count_distinct(pc.list_value_length(vectors)).as_py() > 1:
        raise ValueError("vectors of several lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), -1)


#: Queries and points whose scores are held at once, whatever the blocks; pairs whose differences are; and what rounding to nine digits can hide.
QUERY_TILE, POINT_TILE, DIFFERENCES = 256, 4096, 8192
HIDDEN = 1e-8


def _slack(cost: np.ndarray) -> np.ndarray:
    return cost + HIDDEN + 1e-12 * np.abs(cost)


def best(row: np.ndarray, at: np.ndarray, cost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` least costs of each row, in order, of equal ones the earlier places; and which of them are the k-th."""
    order = np.lexsort((at, cost, row))
    row, at, cost = row[order], at[order], cost[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, at, cost, place = (x[place < k] for x in (row, at, cost, place))
    return row, at, cost, place == k - 1


def _within(queries: np.ndarray, points: np.ndarray, k: int, metric: str, kth: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of points, and costs, of all pairs that ``kth`` allows; in the ``first`` tile, also at most the k-th of its own.

    Squares of Euclidean distances are made by products, less exact than differences by ``lost`` at most. They rule pairs out;
    the costs of the others are made from differences.
    """
    sign, euclid = (1.0 if measure(metric)[1] else -1.0), metric.lower() == "euclid"
    if not euclid:
        got, lost = sign * scores(metric, queries, points), 0.0
    else:
        with np.errstate(over="ignore", invalid="ignore"):
            q, p = ((x * x).sum(1) for x in (queries, points))
            got = queries @ points.T
            got *= -2
            got += q[:, None]
            got += p
            lost = 4 * (points.shape[1] + 8) * np.finfo(float).eps * (q + p.max())
    most = kth
    if first and got.shape[1] > k:
        most = np.partition(got, k - 1, axis=1)[:, k - 1]  # NaN comes last
        most = np.sqrt(np.maximum(most + lost, 0)) if euclid else most
        most = np.minimum(np.where(np.isnan(most), np.inf, most), kth)
    limit = _slack(most)
    if not euclid:
        row, at = np.nonzero(got <= limit[:, None])  # never NaN
        return row, at, got[row, at]
    row, at = np.nonzero(~(got > (limit * limit + lost)[:, None]))  # NaN is for the differences to tell
    parts = [slice(i, i + DIFFERENCES) for i in range(0, len(row), DIFFERENCES)]
    cost = np.concatenate([np.zeros(0), *(np.linalg.norm(points[at[x]] - queries[row[x]], axis=1) for x in parts)])
    near = cost <= limit[row]
    return row[near], at[near], cost[near]


def nearest_of(queries: np.ndarray, points: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of points, and costs, of the ``k`` best points of each query; of equal ones the earlier points.

    Costs are scores to nine digits, less where nearer. Points come a tile at a time, and only those within what the k-th so far
    allows are rounded and sorted. Of ``bound`` on costs, those above are left out.
    """
    row, at, cost = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    kth = np.full(len(queries), np.inf) if bound is None else bound.copy()
    full = np.zeros(len(queries), bool)  # has k points
    for begin in range(0, len(points), POINT_TILE):
        more_row, more_at, more = _within(queries, points[begin : begin + POINT_TILE], k, metric, kth, not begin)
        more = np.round(more, 9)
        wins = (more < kth[more_row]) | (~full[more_row] & (more == kth[more_row]))
        row, at, cost = np.concatenate([row, more_row[wins]]), np.concatenate([at, more_at[wins] + begin]), np.concatenate([cost, more[wins]])
        row, at, cost, last = best(row, at, cost, k)
        kth[row[last]], full[row[last]] = cost[last], True
    return row, at, cost


def nearest_in_block(left: pa.Table, right: pa.Table, k: int, metric: str) -> pa.Table:
    """``(query, key, score)``: the ``k`` best rows of ``right`` for each of ``left``; both have ``key`` and ``vector``."""
    right = right.take(pc.sort_indices(right["key"])) if len(left) else right[:0]
    queries, points = (matrix(x["vector"]) if len(right) else np.zeros((0, 0)) for x in (left, right))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for begin in range(0, len(queries), QUERY_TILE):
        row, at, cost = nearest_of(queries[begin : begin + QUERY_TILE], points, k, metric)
        found.append((row + begin, at, cost))
    row, at, cost = (np.concatenate(x) for x in zip(*found, strict=True))
    score = cost if measure(metric)[1] else -cost
    return pa.table({"query": left["key"].take(pa.array(row)), "key": right["key"].take(pa.array(at)), "score": pa.array(score)})


def search_all(
    vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "Cosine", vector: str = "vector", key: str = "id",
    query_block: int = 1024, point_block: int = 32_768,
) -> DataFrame:
    """``(query, key, score, rank)``: the ``k`` nearest points of every row of ``queries``, which has the columns of ``vectors``.

    Both sides are cut into blocks by key. Each block of queries meets each block of points in one task, which
    keeps its own k a query; these are then ranked. So no pairs are made as rows, and a task holds two blocks and the scores
    of a tile whatever the sizes.
    Scores are compared to nine digits, and equal ones by key.
    """
    name, ascending = metric, measure(metric)[1]
    blocks = [max(1, -(-df.count() // most)) for df, most in ((queries, query_block), (vectors, point_block))]

    def dealt(df: DataFrame, mine: int, name: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(key), F.lit(blocks[mine])).alias(name)
        every = F.explode(F.expr(f"sequence(0L, {blocks[1 - mine] - 1}L)")).alias(other)
        return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), own, every)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest_in_block(left, right, k, name)

    q, p = dealt(queries, 0, "q", "p"), dealt(vectors, 1, "p", "q")
    kind = vectors.schema[key].dataType.simpleString()
    some = q.groupBy("q", "p").cogroup(p.groupBy("q", "p")).applyInArrow(run, f"query {kind}, key {kind}, score double")
    order = F.col("score").asc() if ascending else F.col("score").desc()
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "key")))
    return ranked.where(F.col("rank") <= k).withColumnRenamed("key", key)
