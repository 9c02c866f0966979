import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing as m

PATH = m.default_tokenizer()
TOKENIZER = Tokenizer.from_file(PATH)


@given(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85  'sS<|>endoftext.,;:!?-9éÉßΣσςIİǅ́̈ﬁ漢🙂Ժñ"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_have_the_ids_of_the_whole_text(text):
    got = np.frombuffer(m.Words(TOKENIZER, "<u2").ids(text.encode()), "<u2").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


@given(st.lists(st.tuples(st.text(st.sampled_from("aeékÉßñЖłœIİΣ̈'"), max_size=8), st.text(st.sampled_from(".,;:!?-'"), max_size=3)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_letters_and_marks(words):
    text = " ".join(a + b for a, b in words)
    got = np.frombuffer(m.Words(TOKENIZER, "<u2").ids(text.encode()), "<u2").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_all_words_of_real_rows(documents):
    words, texts = m.Words(TOKENIZER, "<u2"), [r.text for r in documents.collect() if r.text]
    for text in texts:
        assert np.frombuffer(words.ids(text.encode()), "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert words.parts and not [w for w in words if words.plain(w.decode()) not in (None, words[w])]


def test_other_tokenizers_take_the_long_way():
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "A": 3}, [("a", "b")]))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    words = m.Words(other, "<u2")
    assert not words.is_known and np.frombuffer(words.ids(b"ab A b"), "<u2").tolist() == [2, 3, 1]


def held(rows, window=m.WINDOW):
    """Pieces by document, after checking that sequences are gapless and are full or of a power of two."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window and (at == window or at & (at - 1) == 0)
    return sequences, docs


def test_query_round_trip(spark, saved, documents):
    """Every id of every whole text lies in exactly one piece, and no place of a sequence is padding."""
    path = saved(documents=documents)
    sequences, docs = held(m.op12_packing(spark, path).collect())
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert sorted(d for d, _ in docs) == sorted(texts)
    total = 0
    for (doc_id, n), pieces in docs.items():
        ids = np.array(TOKENIZER.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert len(ids) == n
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == n
        total += n
    short = [s for s in sequences.values() if sum(p.length for p in s) < m.WINDOW]
    assert sum(p.length for s in sequences.values() for p in s) == total and len(short) <= 12 * 4


def test_odd_rows(spark, saved, odd, none):
    rows = m.pack(odd, PATH, window=64, shard_tokens=500).collect()
    held(rows, 64)
    per = {}
    for r in rows:
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    assert per[3] == 1 and per[4] == 1 and per[5] == 1 and per[2] == 2 * per[1] and per[6] == per[7] > 27_000
    assert sum(r.length for r in rows if r.doc_id is None) > 2
    assert m.op12_packing(spark, saved(documents=none)).count() == 0
    again = [sorted(map(str, m.pack(odd, PATH, window=64).collect())) for _ in range(2)]
    assert again[0] == again[1]


def bm25(docs, query, probes, k1=1.2, b=0.75):
    """Plain scores of all documents for the most telling tokens of one."""
    n, mean = len(docs), sum(map(len, docs)) / len(docs)

    def weight(t, d):
        df = sum(t in x for x in docs)
        tf = docs[d].count(t)
        return math.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(docs[d]) / mean))

    shared = [t for t in sorted(set(docs[query])) if sum(t in x for x in docs) > 1]
    told = sorted(shared, key=lambda t: -weight(t, query))[:probes]
    return [sum(weight(t, d) for t in told) for d in range(n)]


@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25), min_size=2, max_size=12), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_scores_against_plain_bm25(docs, probes):
    index = m.Index([np.array(d, "<u2") for d in docs], probes=probes)
    for q in range(len(docs)):
        assert index.scores(q) == pytest.approx(bm25(docs, q, probes), abs=1e-9)


def test_windows_take_the_best_unused_neighbours():
    a, b, c = ([i, i, i] + [90] for i in (1, 2, 3))
    docs = [np.array(x, "<u2") for x in (a, b, c, b, a, c, a)]
    packer = m.Packer(12, 0)
    pieces = [*packer.pack(list(range(7)), docs), *packer.close()]
    assert [p[0] for p in pieces if p[4] == 0] == [0, 4, 6]
    assert [p[0] for p in pieces if p[4] == 1] == [1, 3, 2]
    assert [(p[0], len(p[2])) for p in pieces if p[4] == 2] == [(5, 4)]


@given(st.lists(st.integers(1, 70), min_size=1, max_size=30), st.integers(1, 120))
@settings(max_examples=100, deadline=None)
def test_every_id_is_packed_once(lengths, shard):
    docs, packer, got, at = [np.arange(n).astype("<u2") for n in lengths], m.Packer(16, 5), [], 0
    for i in range(0, len(docs), shard):
        got += packer.pack(list(range(i, min(len(docs), i + shard))), docs[i : i + shard])
    got += packer.close()
    for i, d in enumerate(docs):
        parts = sorted((p for p in got if p[0] == i), key=lambda p: p[1])
        assert np.concatenate([p[2] for p in parts]).tolist() == d.tolist()
    sizes = {}
    for p in got:
        sizes.setdefault(p[4], []).append((p[5], len(p[2])))
    for s in sizes.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 16 or at & (at - 1) == 0
