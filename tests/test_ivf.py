import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ivf as m
from ledgerloom.operators.vectors import scores, search_all
from ledgerloom.plans import catalogue


def rows(df, key="id"):
    return sorted((r["query"], r["rank"], r[key], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


@pytest.mark.parametrize("metric", ["Cosine", "Euclid"])
def test_recall_and_exact_search_on_real_rows(spark, embeddings, tmp_path, metric):
    """Queries are the rows whose id is divisible by 50; all rows are filed."""
    index = m.build(embeddings, str(tmp_path / metric), "embedding", "vec_id", metric)
    asked = embeddings.where("vec_id % 50 = 0")
    truth = search_all(embeddings, asked, 10, metric, "embedding", "vec_id").cache()
    assert index.sizes.sum() == embeddings.count() and len(index.centroids) == 22
    found = m.search(index, asked, 10, vector="embedding")
    assert m.recall(found, truth, "vec_id") >= 0.9
    exact = m.search(index, asked, 10, probes=2, exact=True, vector="embedding", query_block=3, point_block=5)
    assert rows(exact, "vec_id") == rows(truth, "vec_id")
    again = m.load(spark, str(tmp_path / metric))
    assert (again.metric, again.key) == (metric.lower(), "vec_id") and np.array_equal(again.sizes, index.sizes)


def test_a_list_that_holds_most_rows(spark, tmp_path):
    """Copies, zeros, nulls and a query far from all."""
    made = np.random.default_rng(1)
    vectors = [[1.0, 0.0, 0.0]] * 300 + [[0.0, 0.0, 0.0], None] + made.normal(size=(200, 3)).tolist() + [[50.0, 50.0, 50.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<double>")
    for metric in ("Cosine", "Euclid"):
        index = m.build(df, str(tmp_path / metric), metric=metric, lists=9)
        assert index.sizes.sum() == len(vectors) - (2 if metric == "Cosine" else 1)
        asked = df.where("id % 50 = 0 or id > 499")
        got = m.search(index, asked, 7, probes=1, exact=True, query_block=2, point_block=64)
        assert rows(got) == rows(search_all(df, asked, 7, metric))


def test_only_the_lists_asked_for_are_read(spark, tmp_path):
    df = spark.range(900).select("id", F.array((F.col("id") % 9 * 100).cast("double"), (F.col("id") / 1000).cast("double")).alias("vector"))
    index = m.build(df, str(tmp_path), metric="Euclid", lists=9)
    got = m.search(index, df.where("id = 18"), 3, probes=1)
    assert [(r.id, r.rank) for r in got.orderBy("rank").collect()] == [(18, 1), (9, 2), (27, 3)]
    lists = {f.split("list=")[1].split("/")[0] for f in spark.read.parquet(f"{tmp_path}/lists").where(F.col("list") == int(np.argmin(index.radii))).inputFiles()}
    assert len(lists) >= 1
    scans = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]
    assert scans and all("list" in x for x in scans)


@pytest.mark.parametrize("metric", ["Cosine", "Euclid"])
def test_tasks_hold_few_distances_and_pairs(spark, embeddings, tmp_path, monkeypatch, metric):
    """A batch is cut by the number of lists, and what it asks for by rows."""
    monkeypatch.setattr(m, "CELLS", 100)
    monkeypatch.setattr(m, "PAIRS", 7)
    batch = pa.RecordBatch.from_pydict({"i": list(range(23))})
    assert [b.num_rows for b in m._parts(iter([batch, batch[:0]]), 22)] == [4] * 5 + [3] and m._parts(iter([batch]), 1000).__next__().num_rows == 1
    asked = embeddings.where("vec_id % 50 = 0")
    index = m.build(embeddings, str(tmp_path), "embedding", "vec_id", metric)
    exact = m.search(index, asked, 10, exact=True, vector="embedding")
    assert rows(exact, "vec_id") == rows(search_all(embeddings, asked, 10, metric, "embedding", "vec_id"), "vec_id")


@pytest.mark.parametrize("metric", ["Cosine", "Euclid"])
def test_a_query_gives_k_rows_for_many_lists_together(spark, embeddings, tmp_path, monkeypatch, metric):
    """And after the first lists, only rows within the bound: those that it takes to put others out."""
    ranked, found = m._ranked, []
    monkeypatch.setattr(m, "_ranked", lambda rows, k, name: found.append(rows.count()) or ranked(rows, k, name))
    index = m.build(embeddings, str(tmp_path), "embedding", "vec_id", metric)
    asked = embeddings.where("vec_id % 50 = 0")
    m.search(index, asked, 10, probes=15, exact=True, vector="embedding")
    assert found[0] == 10 * asked.count() and found[0] <= found[1] < 1.6 * found[0]


@pytest.mark.parametrize("metric", ["Cosine", "Euclid"])
def test_lists_of_a_shelf_one_by_one(metric):
    """Copies in several lists, queries that name some of the lists, bounds, and lists so small that all are cut to k together."""
    made = np.random.default_rng(2)
    points, of = made.integers(-2, 3, (900, 3)).astype(float) + 0.5, made.integers(0, 300, 900)
    named = [sorted(set(made.integers(0, 300, 1 + 20 * i % 200).tolist())) for i in range(30)]
    sign = 1 if metric == "Euclid" else -1
    cost = sign * np.round(scores(metric, points[:30], points), 9)
    bound = np.where(np.arange(30) % 2, np.inf, np.median(cost, axis=1))
    keys = made.permutation(900)
    left = pa.table({"query": np.arange(30), "vector": list(points[:30]), "bound": bound, "lists": pa.array(named, pa.list_(pa.int32()))})
    right = pa.table({"key": keys, "vector": list(points), "list": pa.array(of, pa.int32())})
    got = m._nearest_in_lists(left, right, 4, metric)
    want = []
    for q in range(30):
        may = [i for i in np.lexsort((keys, cost[q])) if of[i] in named[q] and cost[q, i] <= bound[q]]
        want += [(q, keys[i], sign * cost[q, i]) for i in may[:4]]
    assert list(zip(*(got[c].to_pylist() for c in ("query", "key", "score")), strict=True)) == want
    assert m._nearest_in_lists(left[:0], right, 4, metric).num_rows == m._nearest_in_lists(left, right[:0], 4, metric).num_rows == 0


def test_shelves():
    assert m._shelves(np.array([3, 0, 2, 1, 9, 0, 5]), 5).tolist() == [0, 0, 0, 1, 2, 2, 3]


def test_centroids_are_fitted_in_little_memory(monkeypatch):
    """All distances of the sample take 40 MB."""
    monkeypatch.setattr(m, "CELLS", 1 << 16)
    x = np.random.default_rng(3).normal(size=(5000, 4))
    tracemalloc.start()
    try:
        assert m.fit_centroids(x, 1000, rounds=1).shape == (1000, 4)
        assert tracemalloc.get_traced_memory()[1] < 10e6
    finally:
        tracemalloc.stop()


def test_edges(spark, tmp_path):
    with pytest.raises(ValueError, match="search_all"):
        m.build(spark.range(1).select("id", F.array(F.lit(1.0)).alias("vector")), str(tmp_path / "d"), metric="Dot")
    none = spark.createDataFrame([], "id long, vector array<double>")
    index = m.build(none, str(tmp_path / "e"))
    one = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    assert m.search(index, one, exact=True).count() == 0
    index = m.build(one, str(tmp_path / "f"))
    assert rows(m.search(index, one, 5, exact=True)) == [(1, 1, 1, 1.0)] and m.search(index, none, exact=True).count() == 0


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    queries = catalogue.QUERIES
    assert m.recall(queries["ivf_probes_topk"](spark, sf), queries["cosine_topk"](spark, sf), "vec_id") >= 0.9
