import random
from fractions import Fraction
from itertools import permutations

from ledgerloom.llm import filter_audit as m

NAMES = ["part", "filter_order", "step", *m.COUNTS]


def plain(rows, labels):
    """Brute force: rows are (doc_id, part, text); apply every order filter by filter."""
    words = lambda t: t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")

    def fails(i):
        doc_id, _, text = rows[i]
        w = [x for x in words(text) if x]
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        earlier = doc_id is not None and any(d is not None and d < doc_id and t == text for d, _, t in rows)
        return {f for f, x in own.items() if x} | ({"E"} if earlier else set())

    failing = [fails(i) for i in range(len(rows))]
    out = []
    for part in {p for _, p, _ in rows}:
        mine = [i for i in range(len(rows)) if rows[i][1] == part]
        every, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failing[i]]
                left = [i for i in left if f not in failing[i]]
                shapley[f] += len(gone)
                label = lambda what: sum((rows[i][0], what) in labels for i in gone)  # noqa: E731, B023
                unique = sum(failing[i] == {f} for i in mine)
                every.append((part, "".join(order), step, len(left), len(gone), sum(f in failing[i] for i in mine) - len(gone), unique, label("good"), label("toxic"), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in every]
    return sorted(out)


def test_audit_against_brute_force(spark, saved, odd):
    made = random.Random(3)
    texts = ["", "A b " * 150, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i % 50}" for i in range(400)), "Short # text", "é " * 300]
    rows = [(made.choice([None, *range(60)]), made.choice(["en", None, "", "de"]), made.choice([None, *texts])) for _ in range(150)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, lang string, text string, mask string, n int")
    said = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (4, 0, 0), (99, 1, 1), *((i, i % 2, i % 3 % 2) for i in range(10, 40))]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    known = {(d, "good") for d, q, _ in said if q == 1 and d is not None} | {(d, "toxic") for d, _, t in said if t == 1 and d is not None}
    got = m.op13_filter_audit(spark, saved(documents=docs, labels=labels)).select(*NAMES).collect()
    assert sorted(map(tuple, got)) == plain([(d, p or "", t or "") for d, p, t in rows], known)
    every = m.op13_filter_audit(spark, saved(documents=odd, labels=labels)).collect()
    assert len(every) == 3 * 600 and {r.part for r in every} == {"en", "de", ""}


def test_empty(spark, saved, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert m.op13_filter_audit(spark, saved(documents=none, labels=labels)).count() == 0
    some = m.op13_filter_audit(spark, saved(documents=spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"), labels=labels))
    assert some.count() == 600 and some.agg({"good_lost": "sum"}).first()[0] == 0


def test_polynomial():
    counts = [7, 3, 0, 5, 2, 0, 1, 4]  # of three filters
    at = m.corner_values(m.removal_polynomial(counts))
    assert at == [sum(n for k, n in enumerate(counts) if k & s) for s in range(8)]
    want = [sum((Fraction(n, k.bit_count()) for k, n in enumerate(counts) if k >> i & 1), Fraction(0)) for i in range(3)]
    assert m.shapley_values(m.removal_polynomial(counts)) == want
    rows = list(m.audit_rows(counts, counts, [0] * 8, "XYZ"))
    assert len(rows) == 18 and {r[0] for r in rows} == {"XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX"}
