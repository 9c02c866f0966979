import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash_dedup as m
from ledgerloom.llm.common import connected_components, maybe_among


def plain_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "a b c d", "A b  c\td\ne a b c d e", "é ü ß x y z " * 40])
def test_fingerprint(text):
    assert m.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_agrees_with_spark_hash(spark):
    df = spark.createDataFrame([("the cat sat on",)], "s string")
    assert df.select(F.xxhash64("s")).first()[0] & (2**64 - 1) == m.fingerprint("The cat SAT on")


@pytest.mark.parametrize("dense", [1, 3, 256])
def test_links_connect_what_all_pairs_connect(spark, dense):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:25]:
        for _ in range(8):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
            fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = components([(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4], signed)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = m.links(df, dense=dense)
    rows = [tuple(r) for r in edges.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in rows)
    assert components(rows, signed) == want
    roots = dict(map(tuple, connected_components(edges).collect()))
    assert {f: roots.get(f, f) for f in signed} == want


def test_query_against_brute_force(spark, documents, saved):
    from ledgerloom.llm.catalogue import QUERIES

    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in documents.select("doc_id", "text").collect()]
    want = components([(a, b) for a, f in rows for b, g in rows if a < b and bin(f ^ g).count("1") <= 4], [a for a, _ in rows])
    got = QUERIES["op5_simhash"](spark, saved(documents=documents)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {a: (f"{f:016x}", want[a]) for a, f in rows}


def test_odd_rows_and_no_rows(spark, odd, none):
    got = m.near_duplicates(odd).collect()
    assert len(got) == 11
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[6] == by[7] == 6 and by[3] == by[4] == by[5] == 3
    assert {r.component_id for r in got if r.doc_id is None and r.fp == 0} == {3}
    assert m.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in m.keep_one(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 6, 8]
    assert m.keep_one(odd).columns == odd.columns
    assert m.keep_one(none).count() == 0


def test_slices_catch_near_copies_and_leave_others(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(60):
        text = rng.choices(words, k=rng.randint(60, 400))
        group = [text]
        for _ in range(4):
            copy = list(text)
            for i in rng.sample(range(len(copy)), max(1, len(copy) // 100)):
                copy[i] = rng.choice(words)
            group.append(copy)
        for g in group:
            rows.append((n, " ".join(g)))
            n += 1
    for _ in range(200):
        rows.append((n, " ".join(rng.choices(words, k=rng.randint(20, 300)))))
        n += 1
    kept = {r["doc_id"] for r in m.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone = set(range(300, 500))
    assert alone <= kept
    assert len(kept - alone) <= 62  # 60 groups


def test_slice_keys_of_sets():
    a = m.slice_keys("a b c d e f g h i j k l m n o p q r s t u v w x y z")
    assert a == m.slice_keys("A b c d e f g h i j k l m n o p q r s t u v w x y z")
    assert m.slice_keys(None) == (0, 0, [0])
    assert len(np.unique(a[2])) == len(a[2])


def five(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) / len(a | b)


def family(rng, share, size=21, words=200):
    """Texts with one core of ``share`` of their words, the rest their own."""
    new = lambda n: ["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)]
    core = new(round(words * share))
    return [" ".join(core + new(words - len(core))) for _ in range(size)]


@pytest.mark.parametrize("share", [0.76, 0.81, 0.84, 0.865])
def test_a_family_under_the_limit_stays_whole(spark, share):
    texts = family(random.Random(5), share)
    got = [alike(five(a), five(b)) for i, a in enumerate(texts) for b in texts[i + 1 :]]
    assert 0.59 < min(got) <= max(got) < 0.78
    assert m.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == len(texts)


def test_rows_of_one_id_or_none_go_only_as_near_copies(spark):
    near, other, third = ("".join(random.Random(i).choices("abcd ", k=900)) for i in (1, 2, 3))
    rows = [(1, near), (2, near + " end"), (2, other), (None, near + " end"), (None, third), (None, third + " end"), (None, third)]
    kept = [(r.doc_id, r.text) for r in m.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 3 and (1, near) in kept and (2, other) in kept
    assert {k for k in kept if k[0] is None} <= {(None, third), (None, third + " end")}


def test_close_sets_against_pairs():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 1 << 62, 120)
    sets = [np.unique(np.concatenate([rng.permutation(core)[: rng.integers(60, 121)], rng.integers(0, 1 << 62, rng.integers(0, 30))])) for _ in range(90)]
    sets += [rng.integers(0, 1 << 62, 5), sets[0], sets[3][:-2]]
    sets = [np.unique(s).astype(np.uint64) for s in sets]
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    assert len(want) > 150
    for columns in (0, 40, 1024):
        assert {(i, int(j)) for i, near in m.close_sets(sets, columns, 16) for j in near} == want


@pytest.mark.parametrize(("copies", "dense"), [(0, 16), (60, 2)])
def test_all_pairs_at_the_limit_are_joined(spark, copies, dense):
    rng = random.Random(11)
    new = lambda n: ["".join(rng.choices("abcdefghij", k=8)) for _ in range(n)]
    texts = []
    for n in [6, 9, 13, 13, 14, 14, 15, 15, *[rng.randint(20, 760) for _ in range(25)]]:
        text = new(n)
        texts.append(text)
        for at_end in (1, 2, max(1, (n - 4) // 9)):  # about 0.8
            texts.append(text[:-at_end] + new(at_end))
        for edits in range(1, max(2, n // 45)):
            copy = list(text)
            for i in rng.sample(range(n), edits):
                copy[i] = new(1)[0]
            texts.append(copy)
    original = new(200)
    for _ in range(copies):  # each at about 0.83 to the original, two of them at about 0.7
        at = rng.randrange(2, 180)
        texts.append(original[:at] + new(14) + original[at + 14 :])
    texts += [original] * bool(copies)
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    sets = [five(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    assert any(5 * len(sets[i] & sets[j]) == 4 * len(sets[i] | sets[j]) for i, j in near)
    want = components(near, range(len(texts)))
    got = m.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dense=dense).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_sketches_rule_out_no_alike_pair_and_most_others():
    rng = np.random.default_rng(3)
    apart = kept = 0
    for n in list(range(1, 60)) + [100, 300, 1000, 5000] * 20:
        one = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for lost in {0, n // 10, n // 9, n // 5, n}:
            for new in {0, lost // 2, lost}:
                two = np.unique(np.concatenate([one[lost:], rng.integers(0, 2**63, new).astype(np.uint64)]))
                shared = len(np.intersect1d(one, two))
                alike = shared >= 0.8 * (len(one) + len(two) - shared)
                could = m.could_be_alike(m.sketch(one), m.sketch(two))
                assert could or not alike
                if n >= 100 and new == lost == n:
                    apart, kept = apart + 1, kept + could
    assert kept < 0.02 * apart
    assert m.sketch(np.zeros(300, np.uint64)) == b"" and m.could_be_alike(b"", m.sketch(one))
    assert m.could_be_alike(m.sketch(one[:0]), m.sketch(one[:0]))


def shuffled(spark):
    """Bytes of shuffle files that the session's stages have written so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, jvm = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util
    stages = sc._jsc.sc().statusStore().stageList(jvm.ArrayList(), False, False, none, jvm.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_without_near_copies_are_not_sent(spark, tmp_path):
    rng = random.Random(4)
    new = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100)) for _ in range(n)]
    texts = [new(120) for _ in range(300)]
    texts += [texts[0][:-1], texts[1][:-2], texts[2]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs, limit = spark.read.parquet(f"{tmp_path}/docs"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where tables are large
    try:
        before = shuffled(spark)
        m.keep_one(docs).write.parquet(f"{tmp_path}/kept")
        sent = sum(n for k, n in shuffled(spark).items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/kept").select("doc_id").collect()) == list(range(300))
    assert sent < sum(len(t) for _, t in rows) / 2


def test_turns_give_what_one_turn_gives(spark, monkeypatch):
    rng = random.Random(9)
    fps = {rng.getrandbits(63) for _ in range(60)}
    fps |= {f ^ (1 << a) ^ (1 << b) for f in list(fps)[:30] for a, b in [rng.sample(range(63), 2)]}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = {tuple(r) for r in m.links(df).collect()}
    turns = [[tuple(r) for r in m.links(df, turn=i, turns=3).collect()] for i in range(3)]
    assert len(whole) >= 30 and sorted(whole) == sorted(e for t in turns for e in t)

    nodes = spark.createDataFrame([(i, 25, [rng.randrange(60) for _ in range(6)]) for i in range(80)], "node long, n int, keys array<long>")
    once = sorted(map(tuple, m._met(nodes)[0].collect()))
    monkeypatch.setattr(m, "turns_for", lambda keys: 3)
    tables = m._met(nodes)
    assert len(tables) == 3 and once == sorted(tuple(r) for t in tables for r in t.collect())


def test_sets_are_sent_in_turns(spark, monkeypatch):
    """Each turn has the sets of its own places only, and all turns together check all of them."""
    sizes, kept = [], m.materialize

    def spy(df, name):
        out = kept(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(m, "materialize", spy)
    met = spark.createDataFrame([(at, at, at + 1) for at in range(40)], "at long, a long, b long")
    needed = spark.createDataFrame([(at, node) for at in range(40) for node in (at, at + 1)], "at long, node long")
    nodes = spark.range(41).select(F.col("id").alias("node"), F.lit(10).alias("n"))
    sets = nodes.select("node", F.array(F.col("node")).alias("codes"))

    def check(key, met, sets):
        names = set(sets.column("node").to_pylist())
        assert names == {x for n in ("a", "b") for x in met.column(n).to_pylist()}
        return met.select(["a", "b"])

    whole = m._check_in_turns(met, needed, sets, nodes, 80 * 80, check)
    assert sizes == [("alike", 40)]
    turns = m._check_in_turns(met, needed, sets, nodes, 80 * 80, check, least=800)  # a quarter of all sets is 820 bytes
    assert [s for s in sizes if s[0] == "alike"] == [("alike", 40)] + [("alike", 5)] * 8
    assert sorted(map(tuple, turns.collect())) == sorted(map(tuple, whole.collect())) == [(i, i + 1) for i in range(40)]


def test_turns_are_few():
    assert [m.turns_for(n) for n in (0, 1, 4 << 20, (4 << 20) + 1, 1 << 40)] == [1, 1, 1, 2, 8]


@pytest.mark.parametrize("bits", [10, 25])
def test_maybe_among_denies_none_that_is_there(spark, bits):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    test = maybe_among(keys, bits)
    assert keys.where(test(F.col("k"))).count() == 3000
    others = spark.range(3000, 6000).select(F.xxhash64("id").alias("k"))
    assert bits == 10 or others.where(test(F.col("k"))).count() < 200
    assert keys.where(maybe_among(keys.limit(0), bits)(F.col("k"))).count() == 0


def test_codes_are_of_the_shingles_and_of_nothing_else():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abÀ", k=rng.randint(1, 3))) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    texts += [None, "", " \t", "A b", "a\vB\fc\x1cd\re  f", "x" * 64 + " " + "x" * 65, "x" * 200 + " y", "a b a b a", "b a b a b"]
    seen = {}
    for text in texts:
        w = (text or "").encode().lower().split()
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        got = m.shingle_codes(text)
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        seen.setdefault(frozenset(want), set()).add(got.tobytes())
    assert all(len(x) == 1 for x in seen.values()) and len({next(iter(x)) for x in seen.values()}) == len(seen)


@pytest.mark.parametrize(("parts", "most"), [(1, 2), (7, 2), (7, None)])
def test_counted_against_counts(spark, parts, most):
    rng = random.Random(3)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for i, v in enumerate(values) for _ in range(i % 4)], "v long").repartition(3)
    got = {r["key"]: r["count"] for r in m.counted(rows, lambda b: b.column(0).to_numpy().view(np.uint64), parts, 3 if most is None else 2, most, together=50).collect()}
    want = {v: i % 4 for i, v in enumerate(values) if i % 4 >= (3 if most is None else 2)}
    assert got == want if most is None else got.keys() == want.keys()


def test_keys_that_stand_once_are_no_rows(spark):
    def records():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none, jvm = sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util
        stages = sc._jsc.sc().statusStore().stageList(jvm.ArrayList(), False, False, none, jvm.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, 250, [i // 2] + [rng.getrandbits(62) for _ in range(49)]) for i in range(400)], "node long, n int, keys array<long>")
    fps = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(600)], "fp long")
    before = records()
    met = m._met(nodes)[0].collect()
    near = m.links(fps, sift=True).collect()
    sent = sum(n for k, n in records().items() if k not in before)
    assert len(met) == 800 and sorted({r["node"] for r in met}) == list(range(400)) and {r["place"] for r in met} == {0}
    assert near == m.links(fps).collect() == []
    assert sent < (400 * 50 + 600 * 35) / 4


@pytest.mark.parametrize("dense", [2, 256])
def test_links_are_the_same_sifted(spark, dense):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) - (1 << 63) for _ in range(60)}
    fps |= {f ^ (1 << a) ^ (1 << b) for f in list(fps)[:30] for a, b in [rng.sample(range(63), 2)]}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = sorted(map(tuple, m.links(df, dense=dense).collect()))
    assert len(whole) >= 30
    assert whole == sorted(map(tuple, m.links(df, dense=dense, sift=True).collect()))
