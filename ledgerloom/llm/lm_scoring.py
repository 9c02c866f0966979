"""LM scoring by prediction by partial matching.

Method: the trie of byte contexts up to ``order`` bytes is kept as counted
grams, one table for each depth. A byte seen in its longest context is coded
there; otherwise an escape is coded and the next shorter context is tried, with
the bytes that the longer one would have coded excluded. Of a context's
remaining count, each remaining byte gives half a unit to the escape (method D,
after exclusion); under the empty context all remaining symbols are equally
likely. The model is pretrained on the training rows and frozen; each text ends
in a symbol of its own, so scores are log10 probabilities of whole texts. A
word unigram model with add-one smoothing gives the base score; its words are
told apart by 64-bit hashes.

Scale: texts are cut into chunks of about ``CHUNK`` bytes by their place in
their file, and each chunk is reduced to its distinct grams and words before
anything is shuffled. Where a stretch of long texts would make a chunk of more
than twice that, all texts are cut by their own length as well, so no chunk is larger unless
it is one text. Grams and words go, as sorted arrays, to ranges: grams by
the two bytes before their last, so that all longer contexts of a gram are in
its range, and words by hash. There are ``RANGES`` ranges or more, as the number of chunks
grows (:func:`ranges_for`), and as many chunks as ranges meet in a task, which is about
``CHUNK`` bytes of grams at any size. Ranges are merged in as many rounds as that takes. Each range works out its log
probabilities, and sends each chunk those of its own grams, in the order of the grams and without them, as the chunk finds
its grams again in its texts; a range is copied once for as many chunks as there are ranges. Beside the ranges
only the counts of byte pairs are needed everywhere: 65,536 numbers at most.
Texts are shuffled once, to meet the values of their chunk.
One range is worked out in one task, so the grams after one pair of bytes must fit there.

Nulls and edge cases: a null or empty text has one token, the end, and codes
one symbol; a null doc_id hashes as the empty text; repeated rows are scored
alike; with no training rows all symbols are equally likely and all counts
zero; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import crc_of_id, discard, materialize, ship, table

ship(__name__)

ORDER = 5
CHUNK = 24 << 20
#: Bytes of text that are worked on at once, and the least and the largest number of ranges of grams and of words.
BLOCK, RANGES, MOST_RANGES = 1 << 21, 128, 1 << 14
#: Bytes that UTF-8 never has mark what precedes a text and its end.
BEFORE, END = b"\xfe", b"\xff"
#: Symbols that can follow: bytes 0 to 253 and the end.
ALPHABET = 255


def _gram_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of order + 1 bytes that end in each byte and in the end of each text, and how many each text has."""
    data = np.frombuffer(b"".join([BEFORE * order + t + END for t in texts]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes + order)
    fits = np.ones(len(data), bool)
    for k in range(order):
        fits[ends - 1 - k] = False
    fits = fits[: len(data) - order]
    codes = np.zeros(len(fits), np.int64)
    for k in range(order + 1):
        codes <<= 8
        codes |= data[k : k + len(fits)]
    return codes[fits], sizes


def _blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, which compress well."""
    return np.diff(keys, prepend=np.int64(0)).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.int64))


def _coded(values: np.ndarray) -> bytes:
    """Values as their distinct ones and the place of each among these: few counts occur, so few values do."""
    distinct, which = np.unique(values, return_inverse=True)
    return np.int64(len(distinct)).tobytes() + distinct.tobytes() + which.astype(_place_type(len(distinct))).tobytes()


def _decoded(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, float, n, 8)[np.frombuffer(data, _place_type(n), offset=8 + 8 * n)]


def _place_type(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    every = np.concatenate([np.zeros(0, np.int64), *keys])
    distinct, which = np.unique(every, return_inverse=True)
    return distinct, np.bincount(which, np.concatenate([np.zeros(0, np.int64), *counts]), len(distinct)).astype(np.int64)


def ranges_for(chunks: int) -> int:
    """How many ranges to cut the model into: a power of two, more for more chunks."""
    ranges = RANGES
    while ranges < MOST_RANGES and chunks > 8 * ranges:
        ranges *= 2
    return ranges


def _range_of_grams(codes: np.ndarray, ranges: int) -> np.ndarray:
    """A range for each gram, by the two bytes before its last."""
    pair = ((codes >> 8) & 0xFFFF).astype(np.uint32)
    return ((pair * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % ranges


def _word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


GRAMS, WORDS, PAIRS = 0, 1, 2


class _ChunkCounts:
    """Distinct grams and words of one chunk, with their counts in training rows."""

    def __init__(self, order: int, ranges: int):
        self.order, self.ranges, self.words, self.seen = order, ranges, Counter(), set()
        self.codes, self.counts = [], []
        self.waiting: list[tuple[bytes, bool]] = []
        self.held = 0

    def add(self, text: bytes, taught: bool) -> None:
        tokens = text.split()
        tokens.append(b"")
        if taught:
            self.words.update(tokens)
        else:
            self.seen.update(tokens)
        self.waiting.append((text, taught))
        self.held += len(text)
        if self.held >= BLOCK:
            self.flush()

    def flush(self) -> None:
        for wanted in (True, False):
            texts = [t for t, taught in self.waiting if taught is wanted]
            for a, b in _blocks(texts):
                which, distinct = pd.factorize(_gram_codes(texts[a:b], self.order)[0])
                self.codes.append(distinct)
                self.counts.append(np.bincount(which, minlength=len(distinct)) if wanted else np.zeros(len(distinct), np.int64))
        if len(self.codes) > 8:
            codes, counts = _merged(self.codes, self.counts)
            self.codes, self.counts = [codes], [counts]
        self.waiting, self.held = [], 0

    def rows(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """``(kind, range, keys, counts)``."""
        self.flush()
        codes, counts = _merged(self.codes, self.counts)
        pairs = np.bincount(codes & 0xFFFF, counts, 1 << 16).astype(np.int64)
        used = np.flatnonzero(pairs)
        yield PAIRS, 0, _packed(used), pairs[used].tobytes()
        yield from self._by_range(GRAMS, codes, counts, _range_of_grams(codes, self.ranges))
        words = list(self.words) + list(self.seen - self.words.keys())
        n = np.zeros(len(words), np.int64)
        n[: len(self.words)] = np.fromiter(self.words.values(), np.int64, len(self.words))
        codes, counts = _merged([_word_codes(words)], [n])
        yield from self._by_range(WORDS, codes, counts, codes % self.ranges)

    def _by_range(self, kind: int, codes: np.ndarray, counts: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        order = np.argsort(ranges, kind="stable")  # keys stay sorted within a range
        cuts = np.searchsorted(ranges[order], np.arange(self.ranges + 1))
        for r in range(self.ranges):
            some = order[cuts[r] : cuts[r + 1]]
            if len(some):
                yield kind, r, _packed(codes[some]), counts[some].tobytes()


def log_values(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others.

    ``grams`` are sorted and, for each context of two bytes that occurs, all there are; ``pairs`` counts all byte pairs.
    """
    trained = counts > 0
    out, done = np.zeros(len(grams)), np.zeros(len(grams), bool)
    above = None  # the grams of the next longer contexts
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(order, -1, -1):
            mask = (1 << 8 * (k + 1)) - 1
            if k >= 2:
                table, which = np.unique(grams[trained] & mask, return_inverse=True)
                n = np.bincount(which, counts[trained], len(table))
            elif k == 1:
                table = np.flatnonzero(pairs)
                n = pairs[table].astype(float)
            else:
                ends = pairs.reshape(256, 256).sum(axis=0)
                table = np.flatnonzero(ends)
                n = ends[table].astype(float)
            contexts, of = np.unique(table >> 8, return_inverse=True)
            total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float)
            mine = grams & mask
            count, found = _look_up(table, n, mine)
            left, known = _look_up(contexts, total, mine >> 8)
            kinds, _ = _look_up(contexts, distinct, mine >> 8)
            if above is not None:  # take out what the longer context has coded
                lower, _ = _look_up(table, n, above & mask)
                longer, of = np.unique(above >> 8, return_inverse=True)
                mass, number = np.bincount(of, lower, len(longer)), np.bincount(of, minlength=len(longer)).astype(float)
                context = (grams & ((1 << 8 * (k + 2)) - 1)) >> 8
                left, kinds = left - _look_up(longer, mass, context)[0], kinds - _look_up(longer, number, context)[0]
            hit = ~done & known & found
            out[hit] += np.log10((2 * count[hit] - 1) / (2 * left[hit]))
            escaped = ~done & known & ~found & (kinds > 0)
            out[escaped] += np.log10(kinds[escaped] / (2 * left[escaped]))
            done |= hit
            above = table
    out[~done] -= np.log10(ALPHABET - len(above))
    return out


def _look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of sorted keys, zero where there is none; whether there is one."""
    if not len(keys):
        return np.zeros(len(asked)), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    found = keys[at] == asked
    return np.where(found, values[at], 0), found


def _place(docs: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """``(file, part, doc_id, text, taught)``: rows with their chunk, from a scan of Parquet files; about how many chunks.

    Row numbers within files do not depend on how a scan is split, so the chunks are the same in each pass. A chunk is a
    number of rows by the mean size of a text. If one came out at over twice ``chunk`` bytes, texts of over twice the mean go to chunks
    of their own, by powers of four of their length, with fewer rows the longer they are.
    """
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    size = docs.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    mean = max(1.0, size[1] / max(1, size[0]))
    rows = max(1, int(chunk / mean))
    file, row = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    part = F.floor(row / rows).cast("long")
    made = docs.groupBy(file.alias("file"), part.alias("part")).agg(F.sum(length).alias("size")).agg(F.count("*"), F.max("size")).first()
    chunks = made[0]
    if (made[1] or 0) > 2 * chunk:
        step = F.greatest(F.lit(0), F.ceil(F.log(length / F.lit(2 * mean)) / F.lit(math.log(4))))
        own = F.greatest(F.lit(1), F.floor(F.lit(rows) / F.pow(F.lit(4.0), step) / 2)).cast("long")
        part = F.xxhash64(F.coalesce(step, F.lit(0)).cast("int"), F.floor(row / F.coalesce(own, F.lit(rows))).cast("long"))
        chunks = docs.select(file, part).distinct().count()
    placed = docs.select(
        file.alias("file"),
        part.alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (~held_out()).alias("taught"),
    )
    return placed, chunks


def count_chunks(placed: DataFrame, order: int, ranges: int) -> DataFrame:
    """``(file, part, kind, range, keys, counts)``: each chunk's distinct grams, words and byte pairs, by range."""
    names = ["file", "part", "kind", "range", "keys", "counts"]

    def packed(key: tuple[int, int], held: _ChunkCounts) -> pa.RecordBatch:
        kinds, ranges, keys, counts = zip(*held.rows(), strict=True)
        n = len(kinds)
        columns = [pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(ranges, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks: dict[tuple[int, int], _ChunkCounts] = {}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for key, text, taught in zip(keys, batch.column(2), batch.column(3).to_pylist(), strict=True):
                if key not in open_chunks:
                    open_chunks[key] = _ChunkCounts(order, ranges)
                open_chunks[key].add((text.as_py() or "").encode("utf-8", "surrogatepass").lower(), taught)
            for key in [k for k in open_chunks if k not in set(keys)]:  # a chunk may come in several pieces, which are summed
                yield packed(key, open_chunks.pop(key))
        for key, held in open_chunks.items():
            yield packed(key, held)

    return placed.select("file", "part", "text", "taught").mapInArrow(run, "file long, part long, kind int, range int, keys binary, counts binary")


def _columns(table: pa.Table, *names: str) -> list[list]:
    return [table.column(n).to_pylist() for n in names]


def merge_ranges(counted: DataFrame, chunks: int, ranges: int) -> DataFrame:
    """``(kind, range, keys, counts)``, one row for each range: its chunks summed, as many as there are ranges at a time."""

    def run(key, table):
        keys, counts = _columns(table, "keys", "counts")
        k, n = _merged([_unpacked(x) for x in keys], [np.frombuffer(x, np.int64) for x in counts])
        at = table.column("at")[0].as_py()
        return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "range": pa.array([key[1].as_py()], pa.int32()), "at": pa.array([at], pa.int64()), "keys": pa.array([_packed(k)], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})

    blocks = -(-chunks // ranges)
    out = counted.select("kind", "range", F.pmod(F.xxhash64("file", "part"), F.lit(blocks)).alias("at"), "keys", "counts")
    schema = "kind int, range int, at long, keys binary, counts binary"
    earlier = None
    while True:
        out = materialize(out.groupBy("kind", "range", "at").applyInArrow(run, schema), "ranges")
        if earlier is not None:
            discard(earlier)
        if blocks == 1:
            return out
        earlier = out
        blocks = -(-blocks // ranges)
        out = out.withColumn("at", F.pmod(F.col("at"), F.lit(blocks)))


def range_values(merged: DataFrame, order: int) -> DataFrame:
    """``(kind, range, keys, values, tokens, distinct)``: log probabilities of grams, counts of words."""
    rows = merged.where(F.col("kind") == PAIRS).select("keys", "counts").collect()  # one row, 65,536 numbers at most
    pairs = np.zeros(1 << 16, np.int64)
    for r in rows:
        pairs[_unpacked(r["keys"])] = np.frombuffer(r["counts"], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for kind, keys, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = np.frombuffer(counts, np.int64)
                values = log_values(_unpacked(keys), n, pairs, order) if kind == GRAMS else n.astype(float)
                for c, v in zip(out, (_coded(values), int(n.sum()), int((n > 0).sum())), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["kind", "range", "keys", "values", "tokens", "distinct"])

    wanted = merged.where(F.col("kind") != PAIRS).select("kind", "range", "keys", "counts").repartition("kind", "range")
    return wanted.mapInArrow(run, "kind int, range int, keys binary, values binary, tokens long, distinct long")


def chunk_values(counted: DataFrame, valued: DataFrame, chunks: int, ranges: int) -> DataFrame:
    """``(file, part, kind, range, values)``: for each chunk and range the values of the chunk's own keys, in the order of these."""
    blocks = -(-chunks // ranges)

    def run(key, left, right):
        if not left.num_rows:
            return _no_values()
        pieces: dict[tuple[int, int], list[np.ndarray]] = {}
        for file, part, mine in zip(*_columns(left, "file", "part", "keys"), strict=True):
            pieces.setdefault((file, part), []).append(_unpacked(mine))
        keys, values = (right.column(n)[0].as_py() for n in ("keys", "values"))
        keys, values = _unpacked(keys), _decoded(values)
        found = [_coded(values[np.searchsorted(keys, p[0] if len(p) == 1 else np.unique(np.concatenate(p)))]) for p in pieces.values()]
        n = len(found)
        columns = [pa.array([f for f, _ in pieces], pa.int64()), pa.array([p for _, p in pieces], pa.int64()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(found, pa.binary())]
        return pa.table(columns, names=["file", "part", "kind", "range", "values"])

    at = F.pmod(F.xxhash64("file", "part"), F.lit(blocks)).alias("at")
    asked = counted.where(F.col("kind") != PAIRS).select("file", "part", "kind", "range", "keys", at)
    given = valued.select("kind", "range", "keys", "values", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("at")).withColumn("at", F.col("at").cast("long"))
    both = asked.groupBy("kind", "range", "at").cogroup(given.groupBy("kind", "range", "at"))
    return both.applyInArrow(run, "file long, part long, kind int, range int, values binary")


def _no_values() -> pa.Table:
    kinds = {"file": pa.int64(), "part": pa.int64(), "kind": pa.int32(), "range": pa.int32(), "values": pa.binary()}
    return pa.table({n: pa.array([], k) for n, k in kinds.items()})


def _in_order(given: pa.Table, kind: int, codes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """The values of a chunk's sorted ``codes``, which came by range."""
    kinds, which, values = _columns(given, "kind", "range", "values")
    mine = sorted((r, i) for i, (k, r) in enumerate(zip(kinds, which, strict=True)) if k == kind)
    found = np.concatenate([np.zeros(0), *[_decoded(values[i]) for _, i in mine]])
    if len(found) != len(codes):
        raise ValueError(f"{len(found)} values for {len(codes)} keys: the table has changed since it was counted")
    out = np.empty(len(codes))
    out[np.argsort(ranges, kind="stable")] = found
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % 7 == 2


def score(docs: DataFrame, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """Scores of every row of ``docs``, which must be a scan of Parquet files (see :func:`ledgerloom.llm.common.materialize`)."""
    placed, chunks = _place(docs, chunk)
    chunks = max(1, chunks)
    ranges = ranges_for(chunks)
    counted = materialize(count_chunks(placed, order, ranges), "counted")
    merged = merge_ranges(counted, chunks, ranges)
    valued = materialize(range_values(merged, order), "valued")
    discard(merged)
    total_words, distinct_words = valued.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    wanted = materialize(chunk_values(counted, valued, chunks, ranges), "wanted")
    discard(counted, valued)
    spread = math.log10(total_words + distinct_words + 1)

    def run(key, left, right):
        taught = left.column("taught").to_pylist()
        data = [(t.as_py() or "").encode("utf-8", "surrogatepass").lower() for t in left.column("text")]
        vocabulary: set[bytes] = {b""}
        for text in data:
            vocabulary.update(text.split())
        words = list(vocabulary)
        codes, which = np.unique(_word_codes(words), return_inverse=True)
        values = _in_order(right, WORDS, codes, codes % ranges)
        logs = dict(zip(words, np.log10(values[which] + 1).tolist(), strict=True))
        n_tokens, n_known, base = [], [], []
        for text in data:
            found = [logs[w] for w in text.split()]
            found.append(logs[b""])
            n_tokens.append(len(found))
            n_known.append(len(found) - found.count(0.0))
            base.append(math.fsum(found) - len(found) * spread)
        del logs, words, vocabulary
        mine = [np.zeros(0, np.int64)]
        for a, b in _blocks(data):
            mine.append(pd.unique(_gram_codes(data[a:b], order)[0]))
            if len(mine) > 8:
                mine = [np.unique(np.concatenate(mine))]
        codes = np.unique(np.concatenate(mine))
        del mine
        values = _in_order(right, GRAMS, codes, _range_of_grams(codes, ranges))
        scores = []
        for a, b in _blocks(data):
            found, sizes = _gram_codes(data[a:b], order)
            which, distinct = pd.factorize(found)
            value = values[np.searchsorted(codes, distinct)][which]
            scores.append(np.add.reduceat(value, np.concatenate(([0], np.cumsum(sizes)[:-1]))))
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": pa.array([not t for t in taught], pa.bool_()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64()),
            }
        )

    grouped = placed.groupBy("file", "part").cogroup(wanted.groupBy("file", "part"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return grouped.applyInArrow(run, schema).withColumn("train_tokens", F.lit(int(total_words)).cast("long"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and base score of every document, over whole texts."""
    got = score(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
