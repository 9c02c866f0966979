import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import suffix_dedup as m


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if counts[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in m.remove_repeats(docs, length, with_kept=False).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_brute_force_on_edits_periods_and_shared_passages(spark):
    random.seed(5)
    word = lambda: random.choice(["ab", "cde", "fghi", "é", "zz"])
    base = [" ".join(word() for _ in range(200)) for _ in range(5)]
    texts = []
    for b in base:
        for _ in range(4):
            w = b.split()
            for _ in range(random.randint(0, 3)):
                w[random.randrange(len(w))] = word() * 3
            texts.append(" ".join(w))
        texts.append("x" + b[40:400] + base[0][100:300])
    texts += ["orre " * 150, "orre " * 90 + "end", "a" * 500, None, "", "short", base[1]]
    check(spark, texts, 100)
    check(spark, texts, 400)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=40, max_size=300), st.integers(33, 60))
def test_every_string_has_one_anchor_that_its_content_decides(data, length):
    data = bytes(b % 3 for b in data)
    bucket, at, first, last = m.anchors(data, length, 32)
    owned = {p: int(a) for a, f, e in zip(at, first, last, strict=True) for p in range(f, e + 1)}
    assert sorted(owned) == list(range(max(0, len(data) - length + 1)))
    seen = {}
    for p, a in owned.items():
        assert p <= a <= p + length - 32
        assert seen.setdefault(data[p : p + length], a - p) == a - p


def test_identifiers_stand_for_their_bytes():
    data = bytes(random.Random(1).choices(range(3), k=3000))
    for length in (8, 32, 37, 400):
        ids = m.identifiers(data, length)
        strings = [data[i : i + length] for i in range(len(data) - length + 1)]
        assert len(ids) == len(strings)
        assert len(set(ids.tolist())) == len(set(strings))


def test_odd_rows_and_no_rows(spark, odd, none):
    got = [tuple(r) for r in m.remove_repeats(odd, with_kept=False).collect()]
    assert sorted(r[1:4] for r in got if r[0] in (6, 7)) == [(153000, 153000, 1)] * 2
    assert [r[1:4] for r in got if r[0] == 3] == [(0, 0, 0)]
    assert len(got) == 11
    assert m.remove_repeats(none).count() == 0


def test_kept_bytes_are_returned(spark):
    docs = spark.createDataFrame([(1, "abc" + "x" * 50), (2, "x" * 50 + "é")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in m.remove_repeats(docs, 48).collect()}
    assert got == {1: b"abc", 2: "é".encode()}


def test_query_against_brute_force(spark, documents, saved):
    from ledgerloom.llm.catalogue import QUERIES

    rows = documents.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:5] for r in QUERIES["op1_suffix_dedup"](spark, saved(documents=documents)).collect()}
    want = brute([r["text"] for r in rows], 400)
    assert [got[r["doc_id"]] for r in rows] == want
