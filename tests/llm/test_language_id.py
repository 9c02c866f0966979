import numpy as np

from ledgerloom.llm import language_id as m


def test_held_out_accuracy(spark, saved):
    from ledgerloom.llm.catalogue import QUERIES

    d = "/root/testdata/sf0.01"
    got = QUERIES["op4_language_mixture"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_finds_both_languages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de') and length(text) > 1500")
    model = m.train(rows.where("doc_id % 2 = 0"))
    en, de = (rows.where(f"lang = '{x}' and doc_id % 2 = 1").first()["text"][:1400] for x in ("en", "de"))
    lang, score, parts = model.infer(en + " " + de[:600])
    assert lang == "en" and {x for x, _ in parts} == {"en", "de"}
    assert abs(dict(parts)["en"] - 0.7) < 0.1 and 0 < score < 1
    assert len(model.infer(en)[2]) == 1


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, (3, m.BUCKETS)).astype(float)
    model = m.Mixture.of_counts(["a", "b", "c"], counts)
    text = "some words that are long enough to be counted"
    found = np.bincount(m.trigrams(text), minlength=m.BUCKETS)
    p = np.exp(model.log)
    values, share = [], np.full(3, 1 / 3)
    for _ in range(10):
        values.append(found @ np.log(share @ p))
        part = share[:, None] * p
        share = (part / part.sum(axis=0)) @ found / found.sum()
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_odd_rows_and_no_rows(spark, odd, none):
    got = m.predict(odd, m.train(odd)).collect()
    assert len(got) == 11
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (3, 4, 5, 8)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id in (6, 7)} == {"en"}
    assert m.predict(none, m.train(none)).count() == 0
    assert {r.lang_pred for r in m.predict(odd, m.train(none)).collect()} == {"und"}
