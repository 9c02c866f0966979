import random

import pytest

from ledgerloom.llm import decontamination as m


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        for i, item in items:
            q = shingles(item)
            if q and len(q & shingles(text)) >= threshold * len(q) - 1e-9:
                out.add((d, i))
    return out


@pytest.mark.parametrize("bits", [8, 24])
def test_against_brute_force(spark, bits):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc", k=2))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 14, 40, 90])))) for i in range(40)] + [(90, None), (91, ""), (0, "a b c d e f")]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rng.randint(0, 300))]
        w = items[rng.randrange(40)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = "x"
        at = rng.randint(0, len(text))
        docs.append((d, " ".join(text[:at] + w + text[at:]).upper()))
    docs += [(200, items[0][1]), (201, None)]
    items = [x for x in items if x[1] != "a b c d e f"]
    got = m.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), bits=bits)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == plain(docs, items)


def test_odd_rows_and_no_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "the cat sat on the mat and the dog"), (2, None), (3, "9 8 7 -- !!"), (4, "word and another word and another word")], "item_id long, text string")
    kept = m.drop_leaks(odd, items)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 3, 4, 5]
    assert m.drop_leaks(none, items).count() == 0
    assert m.drop_leaks(odd, items.limit(0)).count() == 11
