from collections import Counter

import pytest

import corpus_pipeline
from ledgerloom.llm import decontamination, mixing, quality_qda, sharding
from ledgerloom.llm.common import materialize


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def stages(spark):
    d, out = "/root/testdata/sf0.001", {}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, d), "stage")
        out[name] = docs
    return d, out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_run(spark, stages):
    d, out = stages
    names = out["input"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert out[name].columns == names
    assert out["sharding"].columns == [*names, "shard"]
    assert corpus_pipeline.run(spark, d).exceptAll(out["sharding"]).count() == 0


def test_quality_keeps_what_scores_say(spark, stages):
    d, out = stages
    scores = quality_qda.classify(out["input"], spark.read.parquet(f"{d}/labels.parquet"))
    assert ids(out["quality classifier"]) == {r["doc_id"] for r in scores.where("predicted = 1").collect()}


def test_near_dedup_leaves_one_of_each_group(spark, stages):
    _, out = stages
    before = {r["doc_id"]: shingles(r["text"]) for r in out["quality classifier"].collect()}
    after = ids(out["SimHash near-dedup"])
    for i in before.keys() - after:  # each that went is near one with a smaller id
        assert any(j < i and jaccard(before[i], before[j]) > 0.6 for j in before)
    kept = sorted(after)
    assert not [(a, b) for x, a in enumerate(kept) for b in kept[x + 1 :] if jaccard(before[a], before[b]) >= 0.9]


def test_decontamination_against_brute_force(spark, stages):
    d, out = stages
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = set()
    for r in out["SimHash near-dedup"].collect():
        s = shingles(r["text"])
        if not any(q and len(q & s) >= decontamination.THRESHOLD * len(q) - 1e-9 for q in items):
            want.add(r["doc_id"])
    assert ids(out["benchmark decontamination"]) == want


def test_mix_and_shards(stages):
    _, out = stages
    want = {r["row"]["doc_id"]: r["copies"] for r in mixing.plan_mix(out["benchmark decontamination"]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in out["mixing sources"].collect()) == Counter(want)
    placed = {r["doc_id"]: r["shard"] for r in sharding.place(out["benchmark decontamination"], [1.0] * 24).collect()}
    assert all(placed[r["doc_id"]] == r["shard"] for r in out["sharding"].collect())
