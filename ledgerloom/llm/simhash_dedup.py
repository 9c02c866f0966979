"""SimHash near-duplicates by pigeonhole blocks.

Method: a 64-bit majority fingerprint per text; fingerprints are split into
``blocks`` blocks, and two of them at most ``distance`` bits apart must agree
in at least ``blocks - distance`` blocks. Every choice of that many blocks is a
join key; pairs that share a key are kept if their true Hamming distance fits.

Scale: texts never leave the first pass. The join runs over *distinct*
fingerprints, so exact copies, however many, are one row in it. A key that
more than ``dense`` distinct fingerprints share is not joined pairwise: each
of those fingerprints emits every value within ``distance // 2`` bits, and all
that emit one value are linked to the smallest of them. The number of blocks grows with that of
distinct fingerprints, so that keys stay longer than these need. Two fingerprints
within the distance always share such a value, and two that share one are
within the distance, so this loses and adds nothing and is linear in the group.

The stage for documents (:func:`keep_one`) links by the same blocks first, checks
each link on the shingle sets, and finds what 64 bits cannot show by blocks of
the sets themselves (:func:`similar`). Copies count once, keys are counted with
map-side partial counts before they are joined, and sets are sent by parts of a group, not by pairs.
Keys are dealt with in turns, each of a part of them, so few of them lie on the disks at once. Nearly all keys stand
once: they are found in sorted arrays (:func:`counted`) and left out before any row is made of them. Texts are sent to a
join only where bits of their hash say that the join may want them: those of near-duplicates, as a rule.

Nulls and edge cases: a null or blank text has fingerprint zero, which links
like any other; a null ``doc_id`` takes part in linking but is never the
smallest id unless its whole component has none; repeated rows share their
component; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bit_map, connected_components, discard, id_and_text, in_bit_map, materialize, maybe_among, release, row_key, ship, table

ship(__name__)


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit number whose bits are set where they are set in over half the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounds the memory of very long texts
        bits = np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included; a text of fewer words is one shingle, a blank one none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    norm, size = b" ".join(tokens), len(tokens)
    if size <= words:
        return np.array([xxhash.xxh64_intdigest(norm, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, size) + 1)
    starts = np.concatenate(([0], ends[: size - words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(norm[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash over XXH64 (seed 42) of word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _choices(blocks: int, distance: int, turn: int = 0, turns: int = 1) -> tuple[list[tuple[int, int]], list[int]]:
    """Each choice of blocks that must agree, every ``turns``-th of them, as bits of the blocks and a bit mask; the blocks' bit masks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    chosen = list(combinations(range(blocks), blocks - distance))[turn::turns]
    return [(sum(1 << i for i in c), sum(signed[i] for i in c)) for c in chosen], signed


def counted(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], parts: int, least: int = 2, most: int | None = 2, together: int = 1 << 20) -> DataFrame:
    """``(key, count)``: what stands ``least`` times or more among all that ``hashes`` (well mixed, 64 bits) takes from the batches of ``rows``.

    Hashes are sent in sorted arrays, one for each of ``parts`` ranges of values, so none is a row before it is found to repeat.
    From ``together`` of them one task sends the same hash at most ``most`` times, and counts are no more exact than that.
    """
    edges = np.array([i * (1 << 64) // parts for i in range(1, parts)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            codes = np.sort(np.concatenate(held))
            if most:
                codes = codes[np.concatenate((np.ones(most, bool), codes[most:] != codes[:-most]))[: len(codes)]]
            pieces = [(i, c.tobytes()) for i, c in enumerate(np.split(codes, np.searchsorted(codes, edges))) if len(c)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pieces], pa.int32()), pa.array([x[1] for x in pieces], pa.binary())], names=["part", "codes"])

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(hashes(batch))
            if sum(map(len, held)) >= together:
                yield packed()
                held = []
        if held:
            yield packed()

    def count(key: tuple, sent: pa.Table) -> pa.Table:
        codes = np.sort(np.concatenate([np.frombuffer(c.as_buffer(), np.uint64) for c in sent.column("codes")]))
        at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        n = np.diff(np.append(at, len(codes)))
        return pa.table({"key": pa.array(codes[at][n >= least].view(np.int64)), "count": pa.array(n[n >= least].astype(np.int64))})

    return rows.mapInArrow(send, "part int, codes binary").groupBy("part").applyInArrow(count, "key long, count long")


def _repeated(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], keys: int) -> np.ndarray:
    """The :func:`bit_map` of all hashes that repeat, of about ``keys`` in all."""
    return bit_map(counted(rows, hashes, min(4096, max(1, keys >> 18))).select("key"))


def _sifted(fps: DataFrame, choices: list[tuple[int, int]]) -> DataFrame:
    """``(fp, chosen, part)``: the keys of fingerprints without nearly all that only one fingerprint has."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        fp = batch.column(0).to_numpy()
        return np.concatenate([_mixed((fp & mask).view(np.uint64), which << 8) for which, mask in choices])

    packed = _repeated(fps, hashes, fps.count() * len(choices))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            good = in_bit_map(packed, hashes(batch).view(np.int64)).reshape(len(choices), -1)
            for (which, mask), some in zip(choices, good, strict=True):
                some = fp[some]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), which, np.int32)), pa.array(some & mask)], names=["fp", "chosen", "part"])

    return materialize(fps.mapInArrow(keep, "fp long, chosen int, part long"), "sifted")


def blocks_for(fingerprints: int, distance: int = 4) -> int:
    """How many blocks to split into: more for more distinct fingerprints, so that a key's bits tell most of them apart."""
    blocks = distance + 3
    while blocks < distance + 8 and 64 * (blocks - distance) / blocks < math.log2(max(2, fingerprints)) + 3:
        blocks += 1
    return blocks


def links(fps: DataFrame, distance: int = 4, blocks: int = 7, dense: int = 256, turn: int = 0, turns: int = 1, sift: bool = False) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints at most ``distance`` bits apart.

    Outside dense keys every such pair is an edge; inside them the edges connect
    the same components (see the module's text). With ``turns``, only what every
    ``turns``-th choice of blocks finds: the edges of all turns are the whole. With
    ``sift``, keys of one fingerprint are left out before they are rows.
    """
    choices, masks = _choices(blocks, distance, turn, turns)
    if sift:
        keyed = _sifted(fps.select("fp"), choices)
    else:
        keys = F.array(*[F.struct(F.lit(which).alias("chosen"), F.col("fp").bitwiseAND(F.lit(mask)).alias("part")) for which, mask in choices])
        keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.chosen", "k.part")
    shared = keyed.groupBy("chosen", "part").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(shared, ["chosen", "part"])
    sparse = keyed.where(F.col("n") <= dense).select("chosen", "part", "fp")
    left, right = sparse.withColumnRenamed("fp", "a"), sparse.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    agree = sum((F.when(differ.bitwiseAND(F.lit(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    first, rest = F.lit(0), agree  # the lowest agreeing blocks: each pair is met under one key only
    for _ in range(blocks - distance):
        low = rest.bitwiseAND(-rest)
        first, rest = first.bitwiseOR(low), rest.bitwiseXOR(low)
    near = left.join(
        right,
        (left["chosen"] == right["chosen"])
        & (left["part"] == right["part"])
        & (F.col("a") < F.col("b"))
        & (F.bit_count(differ) <= distance)
        & (first == left["chosen"]),
    ).select("a", "b")
    flips = [0] + [sum(1 << i for i in c) for r in range(1, distance // 2 + 1) for c in combinations(range(64), r)]
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    crowded = keyed.where(F.col("n") > dense).select("fp").distinct()
    if distance % 2:
        raise ValueError("distance must be even: dense keys meet halfway")
    masks_col = F.expr(f"array({','.join(f'{f}L' if f != -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for f in flips)})")
    around = crowded.select("fp", F.explode(masks_col).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("midpoint")
    )
    centre = around.groupBy("midpoint").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    stars = around.join(centre, "midpoint").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return near.unionByName(stars)


def near_duplicates(
    docs: DataFrame, words: int = 4, distance: int = 4, blocks: int | None = None, dense: int = 256
) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row; component_id is the smallest doc_id reachable by links. ``blocks`` none: by :func:`blocks_for`."""
    fps = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    blocks = blocks or blocks_for(classes.count(), distance)
    roots = materialize(connected_components(links(classes.select("fp"), distance, blocks, dense)), "roots")
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    component = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = labelled.join(component, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _mixed(codes: np.ndarray, seed: int) -> np.ndarray:
    x = (codes + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.int64)
_LETTER = _mixed(np.arange(64 * 256, dtype=np.uint64), 8)  # of a byte at a place in its word: the first 64 places


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in ASCII lower case: sums of what each byte at its place in the word is mixed to."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero(~_BLANK[raw])
    if not len(at):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    sizes = np.diff(np.append(starts, len(at)))
    letters = _LOWER[raw[at]] + 256 * (np.arange(len(at)) - np.repeat(starts, sizes))
    if sizes.max() <= 64:
        mixed = _LETTER[letters]
    else:
        mixed = _mixed(letters.astype(np.uint64), 8)
    return np.add.reduceat(mixed, starts)


def shingle_codes(text: str | None, words: int = 5) -> np.ndarray:
    """64-bit hashes of a text's distinct word shingles, sorted; a text of fewer words is one shingle, a blank one none."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    codes = np.full(n, width, np.uint64)
    for i in range(width):
        codes = codes * np.uint64(0xD1342543DE82EF95) + hashes[i : i + n]
    codes = _mixed(codes, 6)
    codes.sort()
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))]


def slice_keys(text: str | None, words: int = 5, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[int, int, list[int]]:
    """128 bits that name a text's set of shingles, as two signed longs, and the set's first shingles in the order of keys.

    The order is rare before ``common`` (sorted hashes and their counts), then by
    mixed hash, the same for all texts. Two sets of a similarity of 0.8 or more share at
    least 0.8 of either, so the first shingle they share is among the first
    ``n - ceil(0.8 n) + 1`` of both: no such pair is without a common key.
    """
    return _keys_of(shingle_codes(text, words), common)


def _keys_of(codes: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None) -> tuple[int, int, list[int]]:
    n = len(codes)
    if not n:
        return 0, 0, [0]
    place = _mixed(codes, 1) >> np.uint64(16)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], codes), len(common[0]) - 1)
        found = np.flatnonzero(common[0][at] == codes)
        place[found] |= np.minimum(common[1][at[found]], (1 << 16) - 1).astype(np.uint64) << np.uint64(48)
    order = np.argsort(place, kind="stable")[: n - (4 * n + 4) // 5 + 1]  # codes are sorted, so ties have one order in all texts too
    one, two = (int(np.add.reduce(_mixed(codes, seed)).view(np.int64)) for seed in (2, 4))
    return one, two, codes[order].view(np.int64).tolist()


def sketch(codes: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of ``n / 8`` to ``n / 4`` buckets; nothing where a bucket has over 255.

    Buckets are the leading bits of a mixed hash, so two neighbours of a finer sketch make one bucket of a coarser.
    """
    bits = max(0, (len(codes) // 4).bit_length() - 1)
    counts = np.bincount((_mixed(codes, 5) >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def could_be_alike(one: bytes, two: bytes) -> bool:
    """False only if two sets of these sketches share too few shingles for a Jaccard similarity of 0.8: no bucket shares more than its smaller count."""
    if not one or not two:
        return True
    fine, coarse = sorted((np.frombuffer(b, np.uint8).astype(np.int64) for b in (one, two)), key=len, reverse=True)
    fine = fine.reshape(len(coarse), -1).sum(axis=1)
    return bool(9 * np.minimum(fine, coarse).sum() >= 4 * (fine.sum() + coarse.sum()))


def _could_be_alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` without those that their sketches rule out; a sketch is a thirty-second of its set or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [could_be_alike(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (nodes.select(F.col("node").alias(n), F.col("sketch").alias(f"{n}_sketch")) for n in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_sketch", "b_sketch")
    return materialize(both.mapInArrow(run, "a long, b long"), "could")


def _common_codes(docs: DataFrame, words: int, one_of: int = 16, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the commonest shingles in every ``one_of``-th text by content, and their counts. They only order keys: any order finds all pairs."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(shingle_codes(text.as_py(), words) for text in batch.column(0))])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(one_of)) == 0)
    got = counted(some, hashes, parts=128, least=3, most=None).orderBy(F.desc("count"), "key").limit(most).toArrow()
    codes, counts = got.column("key").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(codes)
    return codes[order], counts[order]


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, codes)``: the shingle sets of nodes, read from the text of a row that has the set. Other texts are not sent."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [shingle_codes(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int64()))], names=["node", "codes"])

    wanted = maybe_among(nodes.select("key1"))
    texts = docs.select(*row_key(), "text").where(wanted(F.col("key1")))
    texts = texts.join(nodes.select("node", "key1", "key2"), ["key1", "key2"]).dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(read, "node long, codes array<long>")


def _check_in_turns(met: DataFrame, needed: DataFrame, sets: DataFrame, nodes: DataFrame, held: int, check, least: int = 64 << 20) -> DataFrame:
    """Edges ``(a, b)`` that ``check`` finds at each place (``at``) of ``met``, given the sets of the nodes ``needed`` there.

    A set is sent to many places, ``held`` bytes in all. So places are dealt with in turns, each of which sends a
    quarter of what the sets of all ``nodes`` have or ``least`` bytes, whichever is more.
    """
    turns = 1
    if held > least:
        every = 8 * (nodes.agg(F.sum("n")).first()[0] or 0)
        turns = -(-held // max(least, every // 4))
    kept = materialize(sets, "sets") if turns > 1 else sets
    out = []
    for turn in range(turns):
        now = F.pmod("at", F.lit(turns)) == turn
        sent = needed.where(now).join(kept, "node")
        found = met.where(now).groupBy("at").cogroup(sent.groupBy("at")).applyInArrow(check, "a long, b long")
        out.append(materialize(found, "alike"))
        if turns > 1:
            release(met.sparkSession)
    if turns > 1:
        discard(kept)
    return reduce(DataFrame.unionByName, out)


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, together: int = 128, most: int = 8 << 20) -> DataFrame:
    """Those of ``pairs`` (nodes a, b) whose shingle sets have a Jaccard similarity of 0.8 or more, by the sets themselves.

    ``nodes`` has ``node``, ``n`` (shingles), ``sketch`` and ``key1, key2`` (a row that has the set). Pairs
    that sketches rule out are left out first. Nodes that meet in many pairs get a home, the least node they meet, and a part of it of about
    ``together`` nodes. All pairs between two parts are checked in one place, so a set is sent once
    for each part that its own meets and not once for each pair. Places are bounded by ``most`` bytes of sets.
    """
    pairs = _could_be_alike(pairs, nodes)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
    homes = ends.select("e.*").groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("home"))
    sizes = homes.groupBy("home").agg(F.count("*").alias("size"))
    part = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / together)))
    homes = materialize(homes.join(sizes, "home").select("node", part.alias("part")).join(nodes.drop("sketch"), "node"), "homes")

    left, right = (homes.select(F.col("node").alias(n), F.col("part").alias(f"{n}_part")) for n in ("a", "b"))
    cell = F.xxhash64(F.least("a_part", "b_part"), F.greatest("a_part", "b_part"))
    cells = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", cell.alias("cell")), "cells")
    needed = cells.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    held = needed.join(homes, "node").agg(F.sum("n")).first()[0] or 0
    places = max(1, -(-8 * held // most), -(-cells.count() // 200_000))
    at = F.pmod(F.col("cell"), F.lit(places)).alias("at")

    sent = needed.select(at, "node").distinct()

    def check(key: tuple, met: pa.Table, sets: pa.Table) -> pa.Table:
        codes = {node: c.values.to_numpy().view(np.uint64) for node, c in zip(sets.column("node").to_pylist(), sets.column("codes"), strict=True)}
        good = []
        for x, y in zip(met.column("a").to_pylist(), met.column("b").to_pylist(), strict=True):
            one, two = codes[x], codes[y]
            if len(one) > len(two):
                one, two = two, one
            shared = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum()) if len(two) else 0
            good.append(9 * shared >= 4 * (len(one) + len(two)))
        return met.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = _check_in_turns(cells.select(at, "a", "b"), sent, _sets(docs, homes, words), nodes, 8 * held, check)
    discard(pairs, homes, cells)
    return out


def close_sets(sets: list[np.ndarray], columns: int = 1024, block: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the places of the others that have a Jaccard similarity of 0.8 or more to it.

    Shared elements are counted by a product of matrices for the commonest ones, and through lists of holders for the rest.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    held = np.diff(np.append(start, len(flat)))
    common = np.argsort(-held, kind="stable")[:columns]
    common = common[held[common] > 32]
    column = np.full(len(start), -1)
    column[common] = np.arange(len(common))
    code = np.repeat(np.arange(len(start)), held)
    table = np.zeros((len(sets), len(common)), np.float32)
    often = column[code] >= 0
    table[owner[often], column[code[often]]] = 1
    rest = ~often & (held[code] > 1)
    mine = np.argsort(owner[rest], kind="stable")
    codes, cuts = code[rest][mine], np.searchsorted(owner[rest][mine], np.arange(len(sets) + 1))
    for at in range(0, len(sets), block):
        shared = np.rint(table[at : at + block] @ table.T).astype(np.int64)
        for i in range(at, min(at + block, len(sets))):
            row = shared[i - at]
            some = codes[cuts[i] : cuts[i + 1]]
            if len(some):
                row = row + np.bincount(np.concatenate([owner[start[c] : start[c] + held[c]] for c in some]), minlength=len(sets))
            near = np.flatnonzero(9 * row >= 4 * (sizes[i] + sizes))
            yield i, near[near != i]


def _alike_within(groups: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, most: int = 4 << 20, together: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` that join all alike nodes within each of ``groups`` (``group, node, n, root``).

    No pairs are made as rows. A node's home is the least node of its groups; the nodes of a home are cut
    into parts of about ``most`` bytes of sets or ``together`` nodes, whichever is less. Two parts that meet in a group are sent to one place and compared
    there, which gives at most one edge a node. So a large group's sets are sent once for each of its parts, in turns.
    """
    hubs = groups.groupBy("group").agg(F.min("node").alias("hub"))
    homes = groups.join(hubs, "group").groupBy("node").agg(F.min("hub").alias("home"), F.any_value("n").alias("n"), F.any_value("root").alias("root"))
    sizes = homes.groupBy("home").agg(F.greatest(F.ceil(F.sum(8 * F.col("n")) / most), F.ceil(F.count("*") / together)).alias("parts"))
    part = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1)))).alias("part")
    homes = materialize(homes.join(sizes, "home").select("node", "n", "root", part).join(nodes.drop("n", "sketch"), "node"), "homes")
    parts = groups.join(homes.select("node", "part"), "node").select("group", "part").distinct()
    met = parts.withColumnRenamed("part", "one").join(parts.withColumnRenamed("part", "two"), "group").where("one <= two")
    cells = materialize(met.select("one", "two").distinct(), "cells")
    needed = cells.select(F.xxhash64("one", "two").alias("cell"), F.explode(F.array_distinct(F.array("one", "two"))).alias("part"))
    needed = needed.join(homes.select("part", "node", "n"), "part")
    held = 8 * (needed.agg(F.sum("n")).first()[0] or 0)
    places = max(1, -(-held // (2 * most)))
    sent = needed.select(F.pmod("cell", F.lit(places)).alias("at"), "node", "part").distinct()
    sent = sent.join(homes.select("node", "root"), "node")

    def check(key: tuple, met: pa.Table, sets: pa.Table) -> pa.Table:
        members: dict[int, list[int]] = {}
        for i, part in enumerate(sets.column("part").to_pylist()):
            members.setdefault(part, []).append(i)
        names, roots = (sets.column(n).to_numpy() for n in ("node", "root"))
        codes = [c.values.to_numpy().view(np.uint64) for c in sets.column("codes")]
        edges: list[tuple[int, int]] = []
        for one, two in zip(met.column("one").to_pylist(), met.column("two").to_pylist(), strict=True):
            here = members[one] + (members[two] if two != one else [])
            label = np.unique(roots[here], return_inverse=True)[1]
            for i, near in close_sets([codes[j] for j in here]):
                for other in np.unique(label[near]).tolist():
                    if other != label[i]:
                        edges.append((int(names[here[i]]), int(names[here[int(near[label[near] == other][0])]])))
                        label[label == other] = label[i]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    at = F.pmod(F.xxhash64("one", "two"), F.lit(places)).alias("at")
    out = _check_in_turns(cells.select(at, "one", "two"), sent, _sets(docs, homes, words), nodes, held, check)
    discard(homes, cells)
    return out


def _joined(roots: DataFrame | None, more: DataFrame) -> DataFrame:
    """Components of earlier roots and further edges."""
    if roots is not None:
        more = more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return materialize(connected_components(more), "roots")


def turns_for(keys: int, together: int = 4 << 20, most: int = 8) -> int:
    """In how many turns so many keys are dealt with: about ``together`` at once, or an eighth where they are very many."""
    return min(most, max(1, -(-keys // together)))


def _shared_keys(nodes: DataFrame, total: int, turn: int, turns: int) -> DataFrame:
    """``(node, n, place, key)``: the keys of a turn that two nodes hold, and a few more; ``total`` is the number of all."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        got = _mixed(batch.column(2).flatten().to_numpy().view(np.uint64), 7)
        return got[got % np.uint64(turns) == turn] if turns > 1 else got

    packed = _repeated(nodes, hashes, total // turns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            mixed = _mixed(keys.view(np.uint64), 7)
            good = in_bit_map(packed, mixed.view(np.int64))
            if turns > 1:
                good &= mixed % np.uint64(turns) == turn
            row = np.repeat(np.arange(len(sizes)), sizes)[good]
            place = np.flatnonzero(good) - (np.cumsum(sizes) - sizes)[row]
            columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(keys[good])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "place", "key"])

    return nodes.mapInArrow(keep, "node long, n int, place int, key long")


def _met(nodes: DataFrame) -> list[DataFrame]:
    """Tables ``(group, node, n, place)``, none of which shares a group: nodes that hold one key and are of sizes near each other, where two sets may reach 0.8.

    Two sets at 0.8 are in one class of sizes or in neighbouring ones, so each key is held in a node's own class and
    in the next; and the smaller of two sets has their first shared key within its first ninth.
    """
    total = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    turns = turns_for(total // 4)  # a hash alone is a quarter of a row
    size_class = F.floor(F.log(F.col("n")) / F.lit(math.log(1.25))).cast("int")
    out = []
    for turn in range(turns):
        keyed = materialize(_shared_keys(nodes.where("n > 0").select("node", "n", "keys"), total, turn, turns), "keyed")
        both = keyed.withColumn("class", F.explode(F.array(size_class, size_class + 1))).select(F.xxhash64("key", "class").alias("group"), "node", "n", "place")
        shared = both.groupBy("group").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.expr("9 * place - n")).alias("first"))
        out.append(materialize(both.join(shared.where("low <> high and first <= 0").select("group"), "group"), "met"))
        discard(keyed)
    return out


def _reach(x: str, y: str) -> Column:
    """Whether a first shared key at these places leaves enough shingles for 0.8."""
    return 9 * F.least(F.col(f"{x}n") - F.col(f"{x}place"), F.col(f"{y}n") - F.col(f"{y}place")) >= 4 * (F.col(f"{x}n") + F.col(f"{y}n"))


def _apart(met: list[DataFrame], roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``met`` with ``root``, the ``hub`` and the ``size`` of the group, but only groups whose nodes are not all in one component; the table that it reads."""
    rooted = materialize(reduce(DataFrame.unionByName, met).join(roots, "node", "left").select("group", "node", "n", "place", F.coalesce("root", "node").alias("root")), "rooted")
    hub = F.min(F.struct("node", "n", "place", "root")).alias("hub")
    mixed = rooted.groupBy("group").agg(hub, F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    return rooted.join(mixed.where("low <> high").select("group", "hub", "size"), "group"), rooted


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar(docs: DataFrame, words: int = 5, dense: int = 16) -> DataFrame:
    """``(doc_id, key1, key2, node, root, component_id)``: components of texts whose shingle sets have a Jaccard similarity of 0.8 or more.

    Exact and whole: each edge is checked on the sets of both texts, and every
    pair at 0.8 or more is in one component. Texts with one set are one node.

    Candidates come in three steps, each only between nodes that the steps before have not joined.
    (1) Nodes whose SimHash fingerprints are at most four bits apart, by :func:`links`. (2) 64 bits
    cannot tell 0.8, so the shingle set itself is then cut by the pigeonhole principle: two
    sets at 0.8 share one of their first keys (:func:`slice_keys`). The nodes of a key that could reach 0.8 by size and
    place meet one of them, its hub. (3) Those of one key and about one size that are still in different
    components meet in pairs, or, where they are more than ``dense``, in place, without pairs as rows (:func:`_alike_within`).
    """
    docs = id_and_text(docs)
    common = _common_codes(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_codes(t.as_py(), words) for t in batch.column(3)]
            got = [_keys_of(c, common) for c in sets]
            marks = np.fromiter((majority(c) for c in sets), np.uint64, len(sets)).view(np.int64)
            columns = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array(marks), pa.array([len(c) for c in sets], pa.int32()), pa.array(map(sketch, sets), pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "key1", "key2", "set1", "set2", "fp", "n", "sketch", "keys"])

    schema = "doc_id long, key1 long, key2 long, set1 long, set2 long, fp long, n int, sketch binary, keys array<long>"
    read = docs.select("doc_id", *row_key(), "text").mapInArrow(run, schema)
    slices = materialize(read.select("doc_id", "key1", "key2", F.xxhash64("set1", "set2").alias("node"), "fp", "n", "sketch", "keys"), "slices")
    marked = materialize(slices.select("doc_id", "key1", "key2", "node"), "marked")
    repeated = maybe_among(marked.groupBy("node").count().where("count > 1").select("node"))(F.col("node"))
    rows = slices.drop("doc_id")
    nodes = materialize(rows.where(~repeated).unionByName(rows.where(repeated).dropDuplicates(["node"])), "nodes")  # any row that has the set: the rest depends on the set alone
    discard(slices)
    met = _met(nodes)
    earlier, nodes = nodes, materialize(nodes.drop("keys"), "nodes")
    discard(earlier)
    names = nodes.drop("fp")

    by_fp = nodes.groupBy("fp").agg(F.min("node").alias("y"))
    classes = materialize(by_fp, "classes")
    count = classes.count()
    blocks = blocks_for(count)
    turns = turns_for(count * math.comb(blocks, 4) // 4)
    found = [materialize(links(classes.select("fp"), blocks=blocks, turn=turn, turns=turns, sift=True), "links") for turn in range(turns)]
    far = reduce(DataFrame.unionByName, found)
    far = far.join(classes.select(F.col("fp").alias("a"), F.col("y").alias("x")), "a").join(classes.withColumnRenamed("fp", "b"), "b").select("x", "y")
    same = nodes.join(classes, "fp").where("node <> y").select(F.col("node").alias("x"), "y")
    pairs = materialize(_ordered(far.unionByName(same)), "pairs")
    discard(classes, *found)
    roots = _joined(None, _alike(pairs, docs, names, words))

    can = (F.col("root") != F.col("hub.root")) & _reach("", "hub.")
    apart, rooted = _apart(met, roots)
    discard(pairs, free=False)
    pairs = materialize(_ordered(apart.where(can).select(F.col("node").alias("x"), F.col("hub.node").alias("y"))), "pairs")
    discard(rooted)
    roots = _joined(roots, _alike(pairs, docs, names, words))

    apart, rooted = _apart(met, roots)
    groups = apart.where("size > 2").select("group", "node", "n", "place", "root", "size")  # of two, both have met
    groups = materialize(groups, "groups")
    discard(rooted, *met)
    x, y = (groups.where(F.col("size") <= dense).alias(n) for n in ("x", "y"))
    more = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _reach("x.", "y."))
    more = _ordered(more.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")))
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "more")
    within = _alike_within(groups.where(F.col("size") > dense), docs, names, words)
    roots = _joined(roots, _alike(more, docs, names, words).unionByName(within))
    discard(groups, pairs)
    low = marked.groupBy("node").agg(F.min("doc_id").alias("low"))
    labelled = low.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    component = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = labelled.join(component, "root").select("node", "root", "component_id")
    return marked.join(by_node, "node").select("doc_id", "key1", "key2", "node", "root", "component_id")


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component of :func:`similar` one row.

    It is the row with the smallest doc_id, nulls last, and then the smallest hash of
    id and text, so two texts of one doc_id that are not alike both stay. Rows that repeat id and text count once.
    """
    marked = materialize(similar(docs, words), "components")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key1", "key2")).alias("one")
    keepers = materialize(marked.groupBy("root").agg(one, F.count("*").alias("size")), "keepers")
    # A row that is alone in its component stays where it is: only the others are sent to the rows that stay.
    several = maybe_among(marked.join(keepers.where("size > 1").select("root"), "root", "left_semi").select("key1"))(F.col("key1"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("row", *row_key())
    kept = rows.where(several).join(keepers.select("one.key1", "one.key2"), ["key1", "key2"], "left_semi").dropDuplicates(["key1", "key2"])
    return rows.where(~several).unionByName(kept).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, over the whole table."""
    marked = near_duplicates(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
