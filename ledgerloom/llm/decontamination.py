"""Benchmark decontamination by size-partitioned MinHash containment search.

Method: test items are partitioned by their number of distinct word shingles,
in classes of doubling size. An item's MinHash sketch is its smallest shingle
hashes, as many as its class needs: an item of q shingles whose share
``threshold`` or more lies in a document has at most floor((1 - threshold) q)
of them missing, so one more than that of its minima cannot all be missing. A
document that holds any sketch value of an item is a candidate; the class also
tells how many shingles a document must have at least. Every candidate is
verified by exact containment, counted on the shingles' text.

This is the containment form of the search: documents are not sketched, since
a sketch of a long document says nothing about a short passage in it. It has
full recall, not a probability of it.

Scale: documents are read once. Executors get one bit map of sketch hashes and
one of all item shingles, whose sizes follow the number of shingles up to 16 MB
(:func:`bits_for`); a false positive only costs a row. Documents emit only shingles
that pass, and only if a sketch value passes, so the shuffles carry the leaked
passages rather than the corpus, and grow in proportion to them.

Nulls and edge cases: a null or blank text or item matches nothing; a text or
item of fewer than ``width`` words is one shingle, its whole sequence; equal
items are reported each; repeated documents are reported once for each doc_id;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, materialize, row_key, ship, table

ship(__name__)

WIDTH, THRESHOLD = 5, 0.8
#: The least and the largest size of a map, as a power of two of bits: 2 MB to 16 MB.
BITS, MOST_BITS = 24, 27


def _spread(codes: np.ndarray) -> np.ndarray:
    x = codes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def shingle_hashes(text: str | None, width: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and the 64-bit hashes of its shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return words, np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _spread(out ^ codes[i : i + n])
    return words, out


def item_shingles(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``(item_id, shingle, hash, q, place, needed)``: each distinct shingle, its MinHash place, and the sketch length.

    ``needed`` is computed for the largest item of the class, so all of a class share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shingles, hashes, sizes, places, needed = [], [], [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, codes = shingle_hashes(text, width)
                if not words:
                    continue
                size = min(width, len(words))
                _, first = np.unique(codes, return_index=True)  # in order of the hash
                q = len(first)
                largest = (1 << q.bit_length()) - 1
                for place, at in enumerate(first.tolist()):
                    ids.append(item)
                    shingles.append(b" ".join(words[at : at + size]).decode("utf-8", "replace"))
                    hashes.append(codes[at])
                    places.append(place)
                    sizes.append(q)
                    needed.append(min(q, int((1 - threshold) * largest + 1e-9) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(shingles, pa.string()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(places, pa.int64()), pa.array(needed, pa.int64())],
                names=["item_id", "shingle", "hash", "q", "place", "needed"],
            )

    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "item_id long, shingle string, hash long, q long, place long, needed long")


def _bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of 2 ** bits bits with the low bits of every hash set; 2 ** (bits - 3) bytes at most reach the driver."""
    word = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    packed = hashes.select(F.shiftright(word, 5).alias("word"), F.expr(f"shiftleft(1L, cast({'hash'} & 31 as int))").alias("bit"))
    rows = packed.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def leaked_shingles(docs: DataFrame, sketch: np.ndarray, every: np.ndarray, width: int = WIDTH) -> DataFrame:
    """``(doc_id, key1, key2, size, shingle)`` of documents with a sketch value: their distinct shingles that items may hold."""
    spark = docs.sparkSession
    # One byte a map entry would be eight times as large; packed maps travel, and unpack once per worker.
    maps = spark.sparkContext.broadcast((np.packbits(sketch), np.packbits(every)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_sketch, in_any = maps.value
        mask = np.uint64(len(in_sketch) * 8 - 1)

        def passing(packed: np.ndarray, codes: np.ndarray) -> np.ndarray:
            low = codes & mask
            return (packed[low >> np.uint64(3)] >> (np.uint8(7) - (low & np.uint64(7)).astype(np.uint8))) & 1 == 1

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for at in range(batch.num_rows):
                words, codes = shingle_hashes(batch.column(1)[at].as_py(), width)
                if not len(codes) or not passing(in_sketch, codes).any():
                    continue
                size = min(width, len(words))
                hits = np.flatnonzero(passing(in_any, codes))
                found = {b" ".join(words[i : i + size]) for i in hits.tolist()}
                for c, v in zip(out, (batch.column(0)[at].as_py(), batch.column(2)[at].as_py(), batch.column(3)[at].as_py(), len(codes)), strict=False):
                    c.extend([v] * len(found))
                out[4].extend(f.decode("utf-8", "replace") for f in found)
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "key1", "key2", "size", "shingle"])

    return id_and_text(docs).select("doc_id", "text", *row_key()).mapInArrow(run, "doc_id long, key1 long, key2 long, size long, shingle string")


def bits_for(shingles: int) -> int:
    """The size of the maps: 32 bits a shingle or more, up to the largest map, where documents send more shingles that no item has."""
    return min(MOST_BITS, max(BITS, math.ceil(math.log2(32 * max(1, shingles)))))


def find_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, bits: int | None = None) -> DataFrame:
    """``(doc_id, key1, key2, item_id, n_shingles, n_found)`` where a document holds at least ``threshold`` of an item."""
    shingles = materialize(item_shingles(items, width, threshold), "items")
    bits = bits or bits_for(shingles.count())
    sketch = _bit_map(shingles.where("place < needed").select("hash"), bits)
    every = _bit_map(shingles.select("hash"), bits)
    leaked = materialize(leaked_shingles(docs, sketch, every, width).distinct(), "leaked")
    exact = shingles.select("item_id", "shingle", "q", (F.col("place") < F.col("needed")).alias("in_sketch")).distinct()
    pairs = leaked.where(F.col("size") >= 1).join(exact, "shingle").where(F.col("size") >= F.ceil(F.col("q") * F.lit(threshold) - 1e-9))
    counted = pairs.groupBy("doc_id", "key1", "key2", "item_id", "q").agg(F.count("*").alias("n_found"), F.max("in_sketch").alias("met"))
    enough = F.col("met") & (F.col("n_found") >= F.col("q") * F.lit(threshold) - 1e-9)
    return counted.where(enough).select("doc_id", "key1", "key2", "item_id", F.col("q").alias("n_shingles"), "n_found")


def drop_leaks(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    bad = materialize(find_leaks(docs, items, **settings).select("key1", "key2").distinct(), "bad")
    k1, k2 = row_key()
    return docs.join(bad, (k1 == bad["key1"]) & (k2 == bad["key2"]), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds, over whole texts."""
    got = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "n_shingles", "n_found").distinct()


SQL = r"""
with b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from benchmark
), bs as (
  select distinct item_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from b where len(w) > 0)
), q as (
  select item_id, count(*) as n_shingles from bs group by item_id
), d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), ds as (
  select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
)
select doc_id, item_id, n_shingles, count(*) as n_found
from ds join bs using (s) join q using (item_id)
group by doc_id, item_id, n_shingles
having count(*) >= n_shingles * 0.8 - 1e-9
"""
