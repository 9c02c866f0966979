import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import source_divergence as m

NAMES = ["lang", "source", "part", "item", "value", "rank"]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=10, top=10):
    """Brute force over (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, TERM.findall(text.translate(LOW))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        held = Counter(t for la, _, words in found if la == lang for t in set(words))
        kept = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        counts = defaultdict(Counter)
        for la, source, words in found:
            if la == lang:
                counts[source].update(w for w in words if held[w] >= least)

        def share(c):
            total = sum(c.values()) + 2 * len(kept)
            return [1 + 10**9 * (c[t] + 2) // total for t in kept]

        everywhere = share(sum(counts.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source in counts:
            p = share(counts[source])
            pairs = [(o, sum(map(f, p, share(counts[o])))) for o in counts if o != source]
            terms = [(t, f(x, y)) for t, x, y in zip(kept, p, everywhere, strict=True) if counts[source][t] and x > y]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def read(df):
    return sorted(map(tuple, df.select(*NAMES).collect()))


def test_real_rows_in_small_pieces(spark, documents):
    want = plain([(r.lang, r.source, r.text) for r in documents.collect()])
    assert len(want) > 300
    assert read(m.audit(documents.repartition(5))) == want
    assert read(m.audit(documents.repartition(3), most=50, block=3)) == want  # tries sent off often, sources in blocks


def test_odd_rows(spark, odd, none, saved):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert read(m.op11_source_divergence(spark, saved(documents=odd))) == plain(rows)  # no term is in ten rows: pairs of value 0
    for least in (1, 2):
        assert read(m.audit(odd, least)) == plain(rows, least)
    assert read(m.audit(none)) == []
    ties = [("x", s, w) for s in "ab" for w in ("Zeta éa ea Éa", "b b ZETA", "\U0001f642 ﬁ", "")] * 6
    df = spark.createDataFrame(ties, "lang string, source string, text string")
    assert read(m.audit(df)) == plain(ties)


@given(st.dictionaries(st.tuples(st.binary(min_size=1, max_size=6), st.integers(0, 3)), st.integers(1, 9), max_size=80), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_trie_walks_by_prefix(counters, burst):
    runs = []
    for slot in range(4):
        terms = sorted(t for t, s in counters if s == slot)
        runs.append(m.Run(slot, terms, [counters[t, slot] for t in terms], [1] * len(terms)))
    trie = m.RadixTrie(runs, burst)
    walked = list(trie.walk())
    assert {(t, r.slot): n for r in walked for t, n in zip(r.terms, r.counts, strict=True)} == counters
    assert sum(len(r.terms) for r in walked) == len(counters) and all(r.terms == sorted(r.terms) for r in walked)

    def leaves(node):
        for byte, child in node.children.items():
            assert child.prefix.startswith(node.prefix + byte) and (byte or len(child.children) == 0)
            yield from leaves(child)
        if not node.children:
            terms = [t for r in node.runs for t in r.terms]
            assert len(terms) <= burst or len(set(terms)) == 1
            assert all(t.startswith(node.prefix) for t in terms)
            yield terms

    ends = [(min(x), max(x)) for x in leaves(trie) if x]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))  # in the order of bytes


def test_nested_terms_do_not_recurse():
    terms = [b"a" * n for n in range(1, 6000)]
    assert len([*m.RadixTrie([m.Run(0, terms, [1] * len(terms), [1] * len(terms))], 2).walk()]) >= 3000


def test_a_term_over_many_batches(spark):
    """Counters of one term fill several batches, and their order within a slot does not matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(t, i % 5, 1 + i % 3, 1) for t in ("aa", "ab", "b") for i in range(40)]
        got = m.merge_runs(spark.createDataFrame(rows, m.LEAF).repartition(6), [0, 0, 0, 1, 1], least=17).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(t, lang): [sum(n for x, s, n, _ in rows if x == t and s == k) for k in slots] for t in ("aa", "ab", "b") for lang, slots in ((0, (0, 1, 2)),)}
    assert {(r.term, r.lang): r.counts for r in got} == want and all(r.slots == [0, 1, 2] for r in got)


@given(st.text(max_size=50))
def test_terms(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [t.decode() for t in m.terms_of(text.encode())] == TERM.findall(text.translate(LOW))


@given(st.lists(st.integers(0, 10**17), min_size=1, max_size=9))
def test_shares_are_exact(counts):
    total = sum(counts) + 2 * len(counts)
    if total < 9 * 10**17:
        assert m.shares(np.array(counts), np.int64(total)).tolist() == [1 + 10**9 * (c + 2) // total for c in counts]
