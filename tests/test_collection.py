import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import collection as m

SCHEMA = "id string, vector array<float>, text string"


def points(spark, ids, text):
    return spark.createDataFrame([(str(i), [float(i)], text) for i in ids], SCHEMA)


def held(df):
    return {int(r.id): r.text for r in df.collect()}


def files(path):
    return {str(p) for p in path.rglob("*.parquet")}


def test_upserts_write_only_their_buckets(spark, tmp_path):
    path, want = str(tmp_path), {}
    for step, ids in enumerate([range(400), range(0, 400, 100), [7], [7], [7, 8], [7], [401]]):
        base, before = m.manifest(spark, path), files(tmp_path)
        m.upsert(points(spark, ids, f"s{step}"), path, size=1, buckets=16)
        want |= dict.fromkeys(ids, f"s{step}")
        after = m.manifest(spark, path)
        touched = {b for b in after["buckets"] if after["buckets"][b] != base["buckets"].get(b)}
        assert held(m.read_collection(spark, path)) == want
        assert before <= files(tmp_path) and {f.split("bucket=")[1].split("/")[0] for f in files(tmp_path) - before} == touched
        assert len(touched) <= len(ids) and max(map(len, after["buckets"].values())) <= m.LAYERS
    assert min(map(len, after["buckets"].values())) == 1  # buckets that were merged or never touched again


def test_a_merge_reads_only_its_bucket(spark, tmp_path):
    path = str(tmp_path)
    m.upsert(points(spark, range(200), "old"), path, size=1, buckets=8)
    for i in range(m.LAYERS):
        m.upsert(points(spark, [3], f"n{i}"), path)
    merged = m.manifest(spark, path)
    deep = [b for b, layers in merged["buckets"].items() if layers != m.manifest(spark, path, 1)["buckets"][b]]
    assert len(deep) == 1 and len(merged["buckets"][deep[0]]) == 1
    whole = spark.read.parquet(f"{path}/segments/{merged['buckets'][deep[0]][0]}")
    assert {r.bucket for r in whole.select("bucket").distinct().collect()} == {int(deep[0])} and whole.count() < 60


def test_readers_keep_to_their_snapshot(spark, tmp_path):
    path = str(tmp_path)
    m.upsert(points(spark, range(9), "a"), path, size=1)
    old = m.read_collection(spark, path)
    for i in range(m.LAYERS + 2):
        m.upsert(points(spark, range(9), f"b{i}"), path)
    assert set(held(old).values()) == {"a"} and set(held(m.read_collection(spark, path, 2)).values()) == {"b0"}
    assert m.vacuum(spark, path) == 0 and m.vacuum(spark, path, 1, 0) > 0
    assert set(held(m.read_collection(spark, path)).values()) == {f"b{m.LAYERS + 1}"}


def test_the_later_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path)
    m.upsert(points(spark, [1], "a"), path, size=1)
    base = m.manifest(spark, path)
    m.upsert(points(spark, [2], "first"), path, base=base)
    before = files(tmp_path)
    with pytest.raises(m.CommitConflict):
        m.upsert(points(spark, [1], "late"), path, base=base)
    assert held(m.read_collection(spark, path)) == {1: "a", 2: "first"} and files(tmp_path) == before
    assert not [p for p in (tmp_path / "manifests").iterdir() if p.suffix != ".json" and not p.name.endswith(".crc")]


def test_batches_count_once(spark, tmp_path):
    path = str(tmp_path)
    for number, ids in [(0, [1]), (0, [9]), (1, [2]), (0, [9]), (2, [])]:
        m.upsert(points(spark, ids, "x"), path, ("s", number), size=1)
    m.upsert(points(spark, [5], "x"), path, ("other", 0))
    assert set(held(m.read_collection(spark, path))) == {1, 2, 5}
    assert m.manifest(spark, path)["batches"] == {"s": 2, "other": 0}


def test_new_columns_and_other_buckets(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert m.read_collection(spark, a).count() == 0
    m.upsert(points(spark, [1, 2], "x"), a, size=1, buckets=1)
    m.upsert(points(spark, [2], "y").withColumn("more", F.lit(1)), a)
    assert {(r.id, r.text, r.more) for r in m.read_collection(spark, a).collect()} == {("1", "x", None), ("2", "y", 1)}
    m.rebucket(spark, a, 5, b)
    assert m.ensure_collection(spark, b)["buckets"] == 5 and held(m.read_collection(spark, b)) == {1: "x", 2: "y"}
