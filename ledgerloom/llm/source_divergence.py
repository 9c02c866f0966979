"""Audit of how the sources of a language differ in their words.

Method: each task counts its rows' terms in byte tries, whose leaves hold
counters for each source of each language. A trie is walked by prefix, in UTF-8
order, and leaves as sorted runs; runs are merged by range of the term's prefix,
so all counters of a term meet in one task, in byte order, and a second walk
over the merged terms adds up every pair of sources and keeps each source's best
terms, equal ones in byte order.

Scale: texts are read once, and a task sends each (source, term) once for all
its rows; a hot source or term is one counter a task. A trie is made and
sent off when ``most`` counters are held, so a task's memory does not grow with its input.
Runs are shuffled once. Merging streams over what Spark has sorted and spilled
and holds a batch and one term's sums. Sources are numbered and the
numbers sent to all tasks; they are small: the result has a row for every pair
of them. In the second walk sources meet in blocks of ``block``, so its sums
are bounded as well; each pair costs one step a kept term, which the exact sum
of rounded-down terms asks for.

Nulls and edge cases: null text, lang and source are ''; a row without terms
still makes its group; a language without kept terms has pairs of value 0;
repeated rows count each; an empty table gives no rows; other columns are not
read. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, ship, table

ship(__name__)

#: Bytes of terms as they count (only A-Z in lower case, everything from 0x80 kept), all others a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNIT_DIGITS = 9


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: no term's bytes hold a byte that parts them."""
    return text.translate(_FOLD).split()


class Run(NamedTuple):
    """Counters of a source, by term in the order of bytes."""

    slot: int
    terms: list[bytes]
    counts: list[int]
    rows: list[int]

    def part(self, a: int, b: int) -> Run:
        return Run(self.slot, self.terms[a:b], self.counts[a:b], self.rows[a:b])


class RadixTrie:
    """A byte trie over the terms of several sources.

    A node has the prefix of all terms below it and either children, by the byte after the prefix (none where a term
    ends), or, where ``burst`` counters or fewer are below it, the counters of each source as a run.
    """

    def __init__(self, runs: Iterable[Run], burst: int = 4096) -> None:
        self.prefix, self.children, self.runs = b"", {}, [r for r in runs if r.terms]
        ahead = [self]
        while ahead:
            node = ahead.pop()
            if sum(len(r.terms) for r in node.runs) > burst:
                ahead.extend(node._fork())

    def _fork(self) -> list[RadixTrie]:
        """Deal the runs to children; those that may have to fork as well."""
        ends = min(r.terms[0] for r in self.runs), max(r.terms[-1] for r in self.runs)
        self.prefix = commonprefix(ends)
        if ends[0] == ends[1]:
            return []  # one term of many sources
        at, dealt = len(self.prefix), {}
        for run in self.runs:
            a = 0
            while a < len(run.terms):
                byte = run.terms[a][at : at + 1]
                b = a + 1 if not byte else len(run.terms) if byte == b"\xff" else bisect_left(run.terms, self.prefix + bytes([byte[0] + 1]), a)
                dealt.setdefault(byte, []).append(run.part(a, b))
                a = b
        self.runs = []
        for byte in sorted(dealt):
            child = self.children[byte] = RadixTrie(())
            child.prefix, child.runs = self.prefix + byte, dealt[byte]
        return list(self.children.values())

    def walk(self) -> Iterator[Run]:
        """The runs of each leaf, leaves in the order of their prefixes."""
        ahead = [self]
        while ahead:
            node = ahead.pop()
            yield from node.runs
            ahead.extend(reversed(node.children.values()))


LEAF = "term string, slot int, n bigint, n_rows bigint"
TERM = "lang int, term string, slots array<int>, counts array<bigint>"


def count_terms(docs: DataFrame, slots: dict[tuple[str, str], int], most: int = 600_000, piece: int = 50_000) -> DataFrame:
    """``LEAF`` rows, by prefix, from ``(lang, source, text)``; ``slots`` numbers the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[Counter, Counter]] = {}
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            runs = []
            for slot, (occurrences, rows) in waiting.items():
                terms = sorted(occurrences)
                runs.append(Run(slot, terms, [*map(occurrences.__getitem__, terms)], [*map(rows.__getitem__, terms)]))
            waiting.clear()
            some, size = [], 0
            for leaf in RadixTrie(runs).walk():
                some.append(leaf)
                size += len(leaf.terms)
                if size >= piece:
                    yield leaves(some)
                    some, size = [], 0
            if some:
                yield leaves(some)

        def leaves(runs: list[Run]) -> pa.RecordBatch:
            slot = np.repeat(np.array([r.slot for r in runs], np.int32), [len(r.terms) for r in runs])
            term, n, rows = (list(chain.from_iterable(c)) for c in zip(*[r[1:] for r in runs], strict=True))
            arrays = [pa.array(term, pa.binary()).cast(pa.string()), pa.array(slot), pa.array(n, pa.int64()), pa.array(rows, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["term", "slot", "n", "n_rows"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                occurrences, rows = waiting.setdefault(slots[lang, source], (Counter(), Counter()))
                held -= len(occurrences)
                occurrences.update(words)
                rows.update(set(words))
                held += len(occurrences)
                if held >= most:
                    yield from send()
                    held = 0
        yield from send()

    return docs.select("lang", "source", "text").mapInArrow(run, LEAF)


def merge_runs(leaves: DataFrame, lang_of: list[int], least: int = 10, prefix: int = 5) -> DataFrame:
    """One ``TERM`` row for each term of a language that ``least`` of its rows hold. ``lang_of`` has each slot's language.

    Runs meet by the first ``prefix`` characters of their terms, in the order of bytes, a batch at a time; only what
    is kept is looked at one by one. Of a term that goes on in the next batch, sums by slot are carried over.
    """
    of = np.array([*lang_of, 0], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, slot, n, n_rows = pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))

        def summed(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at, first = np.unique(slot[a:b], return_index=True)  # in order of slots, as rows are
            return at, np.add.reduceat(n[a:b], first), np.add.reduceat(n_rows[a:b], first)

        def kept(groups: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
            parts = [summed(a, b) for a, b in zip(groups, stops, strict=True)]
            arrays = [
                pa.array(of[slot[groups]], pa.int32()), term.take(pa.array(groups)),
                pa.array([p[0] for p in parts], pa.list_(pa.int32())), pa.array([p[1] for p in parts], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "slots", "counts"])

        for batch in _then_end(batches):
            if batch is not None and batch.num_rows:
                term = pa.concat_arrays([term, batch.column(0).cast(pa.string())])
                slot, n, n_rows = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip((slot, n, n_rows), batch.columns[1:], strict=True))
            if not len(term):
                continue
            other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            other |= of[slot[1:]] != of[slot[:-1]]
            starts = np.flatnonzero(np.concatenate([[True], other]))
            stops = np.append(starts[1:], len(term))
            whole = len(starts) if batch is None else len(starts) - 1
            enough = np.flatnonzero(np.add.reduceat(n_rows, starts)[:whole] >= least)
            if len(enough):
                yield kept(starts[enough], stops[enough])
            if batch is not None:
                a, b = starts[-1], stops[-1]
                last = term.slice(a, 1)
                slot, n, n_rows = summed(a, b)
                term = last.take(pa.array(np.zeros(len(slot), np.int64)))

    return leaves.repartition(F.substring("term", 1, prefix)).sortWithinPartitions("term", "slot").mapInArrow(run, TERM)


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), digit by digit, as the product would not fit 64 bits."""
    whole, rest = np.divmod(counts + 2, totals)
    for _ in range(UNIT_DIGITS):
        digit, rest = np.divmod(rest * 10, totals)
        whole = whole * 10 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compare(kept: DataFrame, langs: list[list[int]], sums: dict[int, int], sizes: dict[int, int], top: int = 10, block: int = 256, rows: int = 2048) -> DataFrame:
    """``(a, b, term, value)``: parts of the sums of each pair a < b of slots, and candidates (b null) for each slot's best terms.

    ``langs`` has each language's slots, ``sums`` the terms counted in a slot, ``sizes`` the number of kept terms of a language.
    """
    blocks = [-(-len(s) // block) for s in langs]
    pairs = F.array(*[F.lit(n * (n + 1) // 2) for n in blocks] or [F.lit(0)])
    meets = F.explode(F.sequence(F.lit(1), F.get(pairs, F.col("lang")))).alias("meet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (lang, meet), group in groupby(stream, key=lambda r: r[:2]):
            i, j = [(i, j) for i in range(blocks[lang]) for j in range(i, blocks[lang])][meet - 1]
            mine, theirs = (langs[lang][k * block : (k + 1) * block] for k in (i, j))
            whole = sums_of(mine), sums_of(theirs), sum(sums.get(s, 0) for s in langs[lang])
            total = np.zeros((len(mine), len(theirs)), np.int64)
            best: list[list[tuple[int, str]]] = [[] for _ in mine]
            while chunk := [r for _, r in zip(range(rows), group, strict=False)]:
                both = [dense(chunk, s) for s in (mine, theirs)]
                p, q = (shares(c, n + 2 * sizes[lang]) for c, n in zip(both, whole[:2], strict=True))
                for a in range(len(mine)):
                    start = a + 1 if i == j else 0
                    total[a, start:] += divergence(p[:, a : a + 1], q[:, start:]).sum(axis=0)
                if i == j:
                    everywhere = shares(np.array([sum(r[4]) for r in chunk], np.int64), np.int64(whole[2] + 2 * sizes[lang]))
                    for a in range(len(mine)):
                        at = np.flatnonzero((both[0][:, a] > 0) & (p[:, a] > everywhere))
                        value = divergence(p[at, a], everywhere[at])
                        ahead = np.argsort(-value, kind="stable")[:top]
                        best[a] = sorted(best[a] + [(int(value[x]), chunk[at[x]][2]) for x in ahead], key=lambda x: -x[0])[:top]
            out = [(mine[a], theirs[b], None, int(total[a, b])) for a in range(len(mine)) for b in range(a + 1 if i == j else 0, len(theirs))]
            out += [(mine[a], None, term, value) for a, x in enumerate(best) for value, term in x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["a", "b", "term", "value"])

    def sums_of(slots: list[int]) -> np.ndarray:
        return np.array([sums.get(s, 0) for s in slots], np.int64)

    def dense(chunk: list[tuple], slots: list[int]) -> np.ndarray:
        out = np.zeros((len(chunk), len(slots)), np.int64)
        low = slots[0] if slots else 0
        for k, r in enumerate(chunk):
            for s, c in zip(r[3], r[4], strict=True):
                if low <= s < low + len(slots):  # slots of a language follow each other
                    out[k, s - low] = c
        return out

    sent = kept.select("lang", meets, "term", "slots", "counts").sortWithinPartitions("lang", "meet", "term")
    return sent.mapInArrow(run, "a int, b int, term string, value bigint")


def audit(docs: DataFrame, least: int = 10, top: int = 10, most: int = 600_000, block: int = 256) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every pair of a language's sources, and each source's most typical terms."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    found = sorted((r.lang.encode(), r.source.encode(), r.lang, r.source) for r in docs.select("lang", "source").distinct().collect())
    names = {lang: k for k, lang in enumerate(dict.fromkeys(r[2] for r in found))}
    slots = {(lang, source): (names[lang], slot) for slot, (_, _, lang, source) in enumerate(found)}
    langs = [[slot for lang, slot in slots.values() if lang == k] for k in range(len(names))]
    leaves = count_terms(docs, {group: slot for group, (_, slot) in slots.items()}, most)
    kept = materialize(merge_runs(leaves, [k for k, _ in slots.values()], least), "terms")
    counted = kept.select(F.explode(F.arrays_zip("slots", "counts")).alias("c")).groupBy("c.slots").agg(F.sum("c.counts").alias("n"))
    sums = {r.slots: int(r.n) for r in counted.collect()}
    sizes = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    said = compare(kept, langs, sums, sizes, top, block)
    added = said.where("b is not null").groupBy("a", "b").agg(F.sum("value").alias("value"))
    either = F.explode(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))).alias("r")
    rows = spark.createDataFrame([(lang, k, source, slot) for (lang, source), (k, slot) in slots.items()], "lang string, k int, source string, a int")
    others = rows.select("k", F.col("source").alias("item"), F.col("a").alias("b"))
    pairs = rows.join(others, "k").where("a <> b").join(added.select(either).select("r.*"), ["a", "b"], "left")
    pairs = pairs.select("a", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = said.where("b is null").select("a", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(W.partitionBy("a", "part").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.unionByName(terms).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.join(rows.select("a", "lang", "source"), "a").select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and terms of all sources over the whole of ``documents``."""
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), w as (
  select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), k as (select lang, term from w group by 1, 2 having count(distinct i) >= 10
), v as (select lang, count(*) as v from k group by 1
), g as (select distinct lang, source from d
), c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by 1, 2, 3
), s as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n
  from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), p as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) as p
  from s join v using (lang)
), q as (
  select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v) as q
  from (select lang, term, sum(n) as n from s group by 1, 2) join v using (lang)
), u as (
  select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3
), r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(u.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join u on u.lang = a.lang and u.source = a.source and u.item = b.source
  union all
  select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from p join q using (lang, term) where n > 0 and p > q
), o as (
  select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from r
)
select * from o where part = 'pair' or rank <= 10
"""
