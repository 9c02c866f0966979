import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import chunking, summarize


def docs_of(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_fixed_chunks(spark):
    texts = ["", None, "a" * 10, "b" * 11, "abcdefghij" * 5]
    got = chunking.fixed_chunks(docs_of(spark, *texts), 10, 3).collect()
    for i, text in enumerate(texts):
        mine = sorted((r.chunk_pos, r.start_index, r.text) for r in got if r.doc_id == str(i))
        starts = range(0, max(len(text or "") - 4, 0) + 1, 7)
        assert mine == [(k, s, text[s : s + 10]) for k, s in enumerate(starts) if text]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_recursive_pieces(text, size, overlap):
    got = chunking.recursive_pieces(text, size, overlap)
    covered = set()
    for start, chunk in got:
        assert 0 < len(chunk) <= size and chunk == chunk.strip()
        assert text[start : start + len(chunk)] == chunk
        covered.update(range(start, start + len(chunk)))
    assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def plain_recursive(text, size, overlap):
    """The same splitter on lists of strings: parts that keep their separator, then joined while they fit."""

    def parts(text, separators):
        if len(text) <= size:
            return [text] if text else []
        if not separators:
            return list(text)
        out = []
        split = text.split(separators[0])
        for i, part in enumerate(split):
            whole = part + (separators[0] if i < len(split) - 1 else "")
            out += parts(whole, separators[1:]) if len(whole) > size else [whole] * bool(whole)
        return out

    chunks, held, at = [], [], 0
    for part in [*parts(text, ("\n\n", "\n", " ")), None]:
        if held and (part is None or len("".join(held)) + len(part) > size):
            joined = "".join(held)
            if joined.strip():
                chunks.append((at - len(joined) + len(joined) - len(joined.lstrip()), joined.strip()))
            while part is not None and held and (len("".join(held)) > overlap or len("".join(held)) + len(part) > size):
                held = held[1:]
        if part is not None:
            held, at = [*held, part], at + len(part)
    return chunks


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_recursive_pieces_against_plain_splitter(text, size, overlap):
    assert chunking.recursive_pieces(text, size, overlap) == plain_recursive(text, size, overlap)


def test_recursive_query_against_plain_splitter(spark, sf):
    from ledgerloom.plans import catalogue

    want = {(r.doc_id, k, s, c) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for k, (s, c) in enumerate(plain_recursive(r.text or "", 2000, 200))}
    assert {tuple(r) for r in catalogue.QUERIES["recursive_chunks"](spark, sf).collect()} == want


def test_recursive_chunks_prefer_paragraphs(spark):
    text = "First part.\n\nSecond part is here.\n\nThird."
    got = chunking.recursive_chunks(docs_of(spark, text, None, ""), 22, 0).orderBy("chunk_pos").collect()
    assert [(r.start_index, r.text) for r in got] == [(0, "First part."), (13, "Second part is here."), (35, "Third.")]


def test_prefilter_changes_nothing(spark):
    docs = docs_of(spark, "x" * 30 + "Needle" + "y" * 30, "nothing here", None)
    every = chunking.fixed_chunks(docs, 20, 5).where(F.contains(F.lower("text"), F.lit("needle")))
    assert sorted(map(tuple, chunking.matching_chunks(docs, "NEEDLE", size=20, overlap=5).collect())) == sorted(map(tuple, every.collect()))


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([("d", "ACME", i, f"Revenue {i} rose. More.") for i in range(5)] + [("e", "ACME", 0, "Revenue fell.")], "doc_id string, symbol string, chunk_pos int, text string")


def test_summaries_and_envelopes(chunks):
    got = summarize.summarize(chunks, ["doc_id"], "revenue", batch_size=2)
    rows = {(r.doc_id, r.chunk_pos): r.result for r in got.collect()}
    assert rows["d", 3].summary == "Revenue 3 rose." and rows["d", 3].error is None
    made = {r.doc_id: [s.summary for s in r.summaries] for r in summarize.envelopes(got, ["doc_id"]).collect()}
    assert made == {"d": [f"Revenue {i} rose." for i in range(5)], "e": ["Revenue fell."]}


def test_a_failing_batch_marks_its_rows_only(chunks):
    def ask(prompts):
        if any("Revenue 2 " in p for p in prompts):
            raise RuntimeError("down")
        return [json.dumps({"summary": "ok", "points": ["x"], "confidence": 0.7}) if "Revenue 4" not in p else "no json" for p in prompts]

    rows = {(r.doc_id, r.chunk_pos): r.result for r in summarize.summarize(chunks, ["doc_id"], "revenue", ask, batch_size=2).collect()}
    assert [rows["d", i].error for i in range(5)] == [None, None, "RuntimeError: down", "RuntimeError: down", "not JSON"]
    assert rows["e", 0].summary == "ok" and rows["d", 4].raw_output == "no json"
    free = {(r.doc_id, r.chunk_pos): r.result for r in summarize.summarize(chunks, ["doc_id"], "revenue", ask, batch_size=2, require_json=False).collect()}
    assert free["d", 4].summary == "no json" and free["d", 4].error is None


def test_retries_and_length(chunks):
    def ask(prompts, seen=[]):  # noqa: B006  state across calls in one worker
        seen.append(1)
        if len(seen) % 2:
            raise OSError("busy")
        return ['{"summary":"ok"}  tail' for _ in prompts]

    one = chunks.where("doc_id = 'e'")
    assert summarize.summarize(one, ["doc_id"], "x", ask, retries=2, max_chars=16).first().result.summary == "ok"


def test_models_by_name():
    assert summarize.model("extractive:any") is summarize.extractive_model
    with pytest.raises(ValueError, match="no model"):
        summarize.model("remote:x")


def test_micro_batches(chunks):
    got = summarize.micro_batches(chunks, ["doc_id"], ["chunk_pos"], 2).where("doc_id = 'd'").orderBy("chunk_pos")
    assert [r.batch_no for r in got.collect()] == [0, 0, 1, 1, 2]
