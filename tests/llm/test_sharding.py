import zlib
from collections import Counter, defaultdict

from ledgerloom.llm import sharding as m


def test_query(spark, documents, saved):
    from ledgerloom.llm.catalogue import QUERIES

    docs = documents.unionByName(documents.limit(3)).unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"), allowMissingColumns=True)
    got = QUERIES["op10_rendezvous"](spark, saved(documents=docs)).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 and r.law == "key"
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_slots_over_many_pieces(spark):
    placed = m.place(spark.range(5000).withColumnRenamed("id", "doc_id"), [1.0] * 3)
    slots = defaultdict(list)
    for r in m.number_slots(placed, piece_rows=100).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_growth(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    rows = m.place(ids, [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 4.0]).collect()
    n = Counter(r.shard for r in rows)
    assert abs(n[1] / len(rows) - 0.5) < 0.02 and abs(n[0] / len(rows) - 0.25) < 0.02
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {3} and abs(len(moved) / len(rows) - 0.5) < 0.02


def test_odd_rows_and_no_rows(spark, odd, none):
    placed = m.place(odd, [1.0] * 24, [1.0] * 25)
    assert placed.columns == [c if c != "shard" else "shard_in" for c in odd.columns] + ["shard", "grown_shard"]
    assert {r.shard_in for r in placed.collect()} == {3} and placed.count() == 11
    assert m.number_slots(m.place(none, [1.0] * 24)).count() == 0


def test_a_hot_id_and_a_hot_row_are_spread(spark):
    rows = spark.range(3000).selectExpr("cast(null as long) as doc_id", "cast(id % 100 + 1 as string) as text")
    rows = rows.unionByName(spark.range(2000).selectExpr("cast(7 as long) as doc_id", "'same' as text"))
    slots = defaultdict(list)
    for r in m.number_slots(m.place(rows, [1.0] * 3), piece_rows=50).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 5000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_row_of_millions_of_copies(spark):
    """Its copies are made by blocks that many tasks share."""
    from pyspark.sql import functions as F

    n = 3_000_000
    rows = spark.range(n).selectExpr("cast(7 as long) as doc_id").unionByName(spark.range(100).selectExpr("id as doc_id"))
    got = m.number_slots(m.place(rows, [1.0] * 2))
    hot = got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.sum("slot").alias("sum"))
    want = {}
    for r in hot.collect():
        want[r.shard] = r.n
        assert (r.low, r.high, r["sum"]) == (0, r.n - 1, r.n * (r.n - 1) // 2)
    assert sum(want.values()) == n + 100 and max(want.values()) > n
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < n
