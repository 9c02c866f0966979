"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Every byte covered by a ``length``-byte string that also starts elsewhere, in
another document or the same one, is removed. Strings never cross documents.

Method: suffixes are sorted into buckets by their first q bytes, then buckets
are split by the bucket identifiers of later offsets, and identifiers made in
one step are used in the next: an identifier for 2h bytes joins those for h
bytes at offsets 0 and h, from 8 bytes up to ``length``. Identifiers are 64-bit
mixes of the bytes that they stand for (128 bits where a match is decided), so
they agree on all executors without a global sort.

Suffixes are sampled by content: of each string of ``length`` bytes, the
suffix with the least q-gram identifier (the leftmost of equals) is its anchor.
Copies of a string have the same anchor, so comparing strings with one anchor
bucket is enough, and about one suffix in ``length / 2`` is sorted.

Refinement goes by ranges of strings. An anchor owns the run of strings that
chose it. (1) Anchors whose whole runs are equal repeat in full. (2) One of
each other kind in the same bucket is cut into cells of ``CELL`` strings. A
cell whose core (the bytes that all its strings share) is unique holds no
repeat; one whose whole span is not unique repeats in full. (3) What is left is
decided string by string.

Scale: documents are read for the anchors, once more for the spans of the
anchors still in doubt, and once more to cut the bytes out. The shuffles carry
identifiers, shrinking with each step, and groups are only ever counted, with
map-side partial counts: no group is gathered, and no pairs are made.

Nulls and edge cases: a null text is empty; a text shorter than ``length``
keeps all its bytes; rows that repeat (equal id and text) are strings that also
start elsewhere, so they go entirely; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, id_and_text, materialize, row_key, ship, table

ship(__name__)

LENGTH, Q, CELL = 400, 32, 64


def _join(first: np.ndarray, later: np.ndarray, seed: int = 0) -> np.ndarray:
    """The identifier of a string from those of its first part and of a later offset."""
    x = (first + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x += later
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def identifiers(data: bytes, length: int, seed: int = 0) -> np.ndarray:
    """An identifier of the ``length`` bytes at every offset that has so many; length is 8 at least."""
    n = len(data) - 7
    if n <= 0 or len(data) < length:
        return np.zeros(0, np.uint64)
    ids = np.empty(n, np.uint64)
    for k in range(8):
        ids[k::8] = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)[: len(range(k, n, 8))]
    h = 8
    while h < length:
        step = min(h, length - h)  # the last step overlaps
        ids = _join(ids[:-step], ids[step:], seed + h)
        h += step
    return ids


def anchors(data: bytes, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket identifier, offset, and the first and last string owned, of each anchor of a text."""
    strings, width = len(data) - length + 1, length - q + 1
    if strings <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    ids = identifiers(data, q)
    # The upper half orders, the offset below it makes the leftmost of equals the least.
    order = (ids & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(ids), dtype=np.uint64)
    blocks = -(-len(order) // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[: len(order)] = order
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:strings], ahead[width - 1 : width - 1 + strings])
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
    last = np.concatenate((first[1:], [strings])) - 1
    at = chosen[first]
    return ids[at], at, first, last


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))


def anchor_rows(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """``(key1, key2, at, first, last, bucket, run1, run2)``: the anchors of all texts; run is what all owned strings span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[list] = [[], [], [], [], [], []]
            runs: list[bytes] = []
            keys = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for i, text in enumerate(batch.column(0)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                bucket, at, first, last = anchors(data, length, q)
                for c, v in zip(kept, (np.full(len(at), keys[0][i]), np.full(len(at), keys[1][i]), at, first, last, bucket.view(np.int64)), strict=True):
                    c.append(v)
                runs += [_digest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            if runs:
                columns = [pa.array(np.concatenate(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *_longs(runs)], names=["key1", "key2", "at", "first", "last", "bucket", "run1", "run2"])

    schema = "key1 long, key2 long, at long, first long, last long, bucket long, run1 long, run2 long"
    return id_and_text(docs).select("text", *row_key()).mapInArrow(run, schema)


def spans_in_doubt(docs: DataFrame, doubtful: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doubtful`` anchors with ``span``, the bytes of their strings."""
    wanted = doubtful.groupBy("key1", "key2").agg(F.collect_set(F.struct("at", "first", "last")).alias("anchors"))
    texts = id_and_text(docs).select("text", *row_key()).dropna(subset=["text"])
    joined = texts.join(wanted, ["key1", "key2"]).select("key1", "key2", "text", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                key1, key2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for a in batch.column(3)[i].as_py():
                    for c, v in zip(out, (key1, key2, a["at"], a["first"], a["last"], data[a["first"] : a["last"] + length]), strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key1", "key2", "at", "first", "last", "span"])

    return joined.mapInArrow(run, "key1 long, key2 long, at long, first long, last long, span binary")


def cell_rows(spans: DataFrame, length: int = LENGTH, cell: int = CELL) -> DataFrame:
    """Cells of ``cell`` strings, on a grid that starts at the anchor, with identifiers of core and whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cores, wholes = [], [], []
            for key1, key2, at, first, last, span in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for c in range((at - last) // cell, (at - first) // cell + 1):
                    low, high = max(first, at - cell * (c + 1) + 1), min(last, at - cell * c)
                    # Each string of the cell holds the core, so it lies within the span.
                    start, stop = at - cell * c - first, at - cell * (c + 1) + 1 + length - first
                    rows.append((key1, key2, at, low, high))
                    cores.append(_digest(b"%d:" % c + span[start:stop]))
                    wholes.append(_digest(b"%d:%d:" % (c, at - high) + span[low - first : high - first + length]))
            if rows:
                fixed = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*fixed, *_longs(cores), *_longs(wholes)], names=["key1", "key2", "at", "first", "last", "core1", "core2", "whole1", "whole2"])

    schema = "key1 long, key2 long, at long, first long, last long, core1 long, core2 long, whole1 long, whole2 long"
    return spans.mapInArrow(run, schema)


def string_rows(cells: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(key1, key2, first, id1, id2)`` of each single string of the cells, whose bytes are in ``span``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys1, keys2, offsets, ids1, ids2 = [], [], [], [], []
            for key1, key2, low, high, first, span in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = span[low - first : high - first + length]
                ids1.append(identifiers(data, length))
                ids2.append(identifiers(data, length, 0x5851F42D4C957F2D))
                offsets.append(np.arange(low, high + 1))
                keys1.append(np.full(high - low + 1, key1))
                keys2.append(np.full(high - low + 1, key2))
            if offsets:
                columns = [np.concatenate(c) for c in (keys1, keys2, offsets)] + [np.concatenate(c).view(np.int64) for c in (ids1, ids2)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key1", "key2", "first", "id1", "id2"])

    chosen = cells.select("key1", "key2", "low", "high", "first", "span")
    return chosen.mapInArrow(run, "key1 long, key2 long, first long, id1 long, id2 long")


def repeated_strings(docs: DataFrame, length: int = LENGTH, q: int = Q, cell: int = CELL) -> DataFrame:
    """``(key1, key2, ranges)``: for each text, ranges ``(first, last)`` of offsets where strings start that also start elsewhere."""
    cell = min(cell, length)  # strings of a cell must have bytes in common
    place = ["key1", "key2", "at", "first", "last"]
    one = F.min(F.struct(*place)).alias("one")

    rows = materialize(anchor_rows(docs, length, q), "anchors")
    runs = materialize(rows.groupBy("bucket", "run1", "run2").agg(F.count("*").alias("n"), one), "runs")
    twice = runs.where("n > 1").select("run1", "run2")
    in_full = materialize(rows.join(twice, ["run1", "run2"]).select("key1", "key2", "first", "last"), "in_full")
    split = runs.groupBy("bucket").agg(F.count("*").alias("kinds")).where("kinds > 1")
    doubtful = materialize(runs.join(split, "bucket").select("one.*"), "doubtful")
    discard(rows, runs)

    spans = materialize(spans_in_doubt(docs, doubtful, length), "spans")
    discard(doubtful)
    cells = materialize(cell_rows(spans, length, cell), "cells")
    wholes = materialize(cells.groupBy("core1", "core2", "whole1", "whole2").agg(F.count("*").alias("n"), one), "wholes")
    twice = wholes.where("n > 1").select("whole1", "whole2")
    in_cells = materialize(cells.join(twice, ["whole1", "whole2"]).select("key1", "key2", "first", "last"), "in_cells")
    split = wholes.groupBy("core1", "core2").agg(F.count("*").alias("kinds")).where("kinds > 1")
    unsure = wholes.join(split, ["core1", "core2"]).select(
        "one.key1", "one.key2", "one.at", F.col("one.first").alias("low"), F.col("one.last").alias("high")
    )
    strings = materialize(string_rows(unsure.join(spans, ["key1", "key2", "at"]), length), "strings")
    discard(spans, cells, wholes)

    twice = strings.groupBy("id1", "id2").agg(F.count("*").alias("n")).where("n > 1").select("id1", "id2")
    singly = strings.join(twice, ["id1", "id2"]).select("key1", "key2", "first", F.col("first").alias("last"))
    ranges = in_full.unionByName(in_cells).unionByName(singly).groupBy("key1", "key2")
    out = materialize(ranges.agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges")
    discard(in_full, in_cells, strings)
    return out


def cut(docs: DataFrame, repeated: DataFrame, length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row of ``docs``, and ``kept``, the bytes left, if wanted."""
    texts = id_and_text(docs).select("doc_id", "text", *row_key())
    joined = texts.join(repeated, ["key1", "key2"], "left").select("doc_id", "text", "ranges")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data, gone = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass"), []
                found = batch.column(2)[i].values
                if found is not None and len(found):
                    first, last = (found.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(first)
                    starts, ends = first[order], np.maximum.accumulate(last[order] + length)
                    fresh = np.concatenate(([True], starts[1:] > ends[:-1]))
                    gone = list(zip(starts[fresh].tolist(), ends[np.concatenate((fresh[1:], [True]))].tolist(), strict=True))
                edges = [0, *(x for pair in gone for x in pair), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (batch.column(0)[i].as_py(), len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                rows.append(row + (kept,) * with_kept)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_kept
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = True) -> DataFrame:
    """Every row of ``docs`` without the bytes of repeated strings (see :func:`cut`)."""
    return cut(docs, repeated_strings(docs, length), length, with_kept)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, removed runs and digest of what is left of every document."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
