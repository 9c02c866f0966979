import numpy as np
import pytest

from ledgerloom.llm import quality_qda as m


def test_held_out_accuracy(spark):
    from ledgerloom.llm.catalogue import QUERIES

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = QUERIES["op7_qda"](spark, d).where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_fit_against_numpy(spark):
    rng = np.random.default_rng(0)
    k = len(m.FEATURES)
    x = rng.normal(size=(400, k)) @ rng.normal(size=(k, k))
    y = rng.integers(0, 2, 400)
    x[y == 1] = x[y == 1] * 2 + 1
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y, strict=True)], ", ".join(f"f{i} double" for i in range(k)) + ", y int")
    model = m.fit(df, "y", shrink=0.2, ridge=0.05)
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * own[c] for c in (0, 1)) / 400
    log = []
    for c in (0, 1):
        cov = 0.75 * own[c] + 0.2 * pooled + 0.05 * np.eye(k)
        d = z - z[y == c].mean(axis=0)
        log.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(log[0] - log[1])), abs=1e-6)


def test_odd_rows_and_no_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = m.classify(odd, labels).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert m.classify(none, labels).count() == 0
    assert {r["score"] for r in m.classify(odd, labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in m.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert m.keep_good(odd, labels).columns == odd.columns
