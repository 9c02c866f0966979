import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as m


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """The excess of full sources goes round until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * share for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 1000, None: 7}, {"a": 0, "b": 0}, {"a": 1}, {"a": 10, "b": 10**9, "c": 3, "d": 4, "ä": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in m.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_meets_targets_and_repeats(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("five words are in here").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    mixed = m.mix(docs)
    taken = {r["source"]: r["n"] * 5 for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    sizes = {r["source"]: r["n"] * 5 for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, target in plain_targets(sizes).items():
        assert taken.get(source, 0) == pytest.approx(target, rel=0.1)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixed.exceptAll(m.mix(docs.repartition(7))).count() == 0
    assert mixed.columns == docs.columns


def test_odd_rows_and_no_rows(spark, odd, none):
    planned = m.plan_mix(odd).collect()
    assert len(planned) == 11
    assert {r["size"] for r in planned if r["row"]["doc_id"] in (3, 4, 5)} == {0}
    assert m.mix(odd).columns == odd.columns
    assert m.mix(none).count() == 0 and m.plan_mix(none).count() == 0
