"""Audit of how quality filters interact: what each removes in every order, and its Shapley value.

Method: each document gets a mask of the filters it fails, and each part of the
corpus is counted by mask. From these counts the part's removal polynomial is
formed: multilinear in one variable a filter, its value at a corner is the
number of documents that the filters switched on there remove. A filter's
Shapley value is the integral, over the diagonal, of the polynomial's
derivative in its variable; integrals are exact rationals and are scaled by the
factorial of the number of filters, so they are the removals summed over all
orders. Survivors of every prefix of an order are read off corners.

Scale: one scan of the texts writes a table of marks (id, part, mask and a
SHA-256 of the text, in place of the text). The smallest id of each text is a
map-side combined minimum. Rows are then joined to these by text and id
together, so a text that a third of all rows hold is spread by id instead of
meeting in one task, and to the labels by id; a hot id is split by the
adaptive skew join, and rows without an id take no part in a join. What
reaches Python is one row of at most 32 masks for each part.

Nulls and edge cases: a null text is empty; a null part is the empty string and
is one part with an empty one; a null id is never smaller than another and has
no smaller one, and has no label; rows equal in id and text are not duplicates
of each other, but all are of a smaller id; of several labels of an id any that
says 1 counts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, materialize, ship, table

ship(__name__)

#: The filters in the order of their bits; E, the last, is the one that looks at other rows.
FILTERS = "ABCDE"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column, n_words: Column, n_distinct: Column) -> list[Column]:
    """Whether a text fails A (short), B (repetitive), C (capitals) and D (symbols)."""
    capitals = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return [n_words < 200, 100 * n_distinct < 50 * n_words, 100 * capitals > 3 * F.length(text), F.rlike(text, F.lit("[#$%&*|]"))]


def marks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``(doc_id, part, mask, digest)``: the filters that each row fails by itself, and its text's SHA-256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    sized = words.select("doc_id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("m"))
    fails = own_failures(F.col("text"), F.col("n"), F.col("m"))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return sized.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many rows of a part fail just these filters, and how many of them have each label."""
    marked = materialize(marks(docs, part), "marks")
    known = marked.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = known.join(first, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    later = F.when(F.col("is_first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(0)
    rows = joined.select("part", (F.col("mask") + later).alias("mask"), "good", "toxic")
    unnamed = marked.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return rows.unionByName(unnamed).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients, by set of variables, of the multilinear polynomial of a list of counts by mask.

    A document with mask M is removed at x with 1 - prod(1 - x_i, i in M). Multiplied out, the
    product of the variables in T gets, with a sign, the count of all documents that fail all of T.
    """
    holding = list(counts)
    for bit in (1 << i for i in range((len(counts) - 1).bit_length())):
        for t in range(len(counts)):
            if not t & bit:
                holding[t] += holding[t | bit]
    return [0 if not t else n if t.bit_count() % 2 else -n for t, n in enumerate(holding)]


def corner_values(polynomial: list[int]) -> list[int]:
    """The polynomial at every corner: removals by each set of filters."""
    at = list(polynomial)
    for bit in (1 << i for i in range((len(at) - 1).bit_length())):
        for s in range(len(at)):
            if s & bit:
                at[s] += at[s ^ bit]
    return at


def shapley_values(polynomial: list[int]) -> list[Fraction]:
    """For each variable, the integral from 0 to 1 of the derivative in it along the diagonal."""
    filters = range((len(polynomial) - 1).bit_length())
    return [sum((Fraction(c, t.bit_count()) for t, c in enumerate(polynomial) if t >> i & 1), Fraction(0)) for i in filters]


def audit_rows(n: list[int], good: list[int], toxic: list[int], filters: str = FILTERS) -> Iterator[tuple]:
    """``(filter_order, step, *COUNTS)`` for all orders, from a part's counts by mask."""
    polynomial = removal_polynomial(n)
    removed, goods, toxics = (corner_values(p) for p in (polynomial, removal_polynomial(good), removal_polynomial(toxic)))
    scaled = [s * factorial(len(filters)) for s in shapley_values(polynomial)]
    total, every = sum(n), len(n) - 1
    for order in permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            unique = removed[every] - removed[every ^ 1 << i]
            yield name, step, total - removed[after], here, removed[1 << i] - here, unique, goods[after] - goods[before], toxics[after] - toxics[before], int(scaled[i])
            before = after


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``(part, filter_order, step, *COUNTS)`` from ``(part, mask, n, good, toxic)``; one row a part reaches Python."""
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    names = ["part", "filter_order", "step", *COUNTS]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                by_mask = [[0] * (1 << len(filters)) for _ in range(3)]
                for x in row["held"]:
                    for to, name in zip(by_mask, ("n", "good", "toxic"), strict=True):
                        to[x["mask"]] += x[name]
                rows = [(row["part"], *r) for r in audit_rows(*by_mask, filters)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over the whole of ``documents``, for each language."""
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), m as (
  select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
         coalesce(doc_id > min(doc_id) over (partition by text), false) as e
  from d
), l as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1
), k as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n,
         sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from m left join l using (doc_id) group by all
), f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(f, bit)
), o as (
  select v.f || w.f || x.f || y.f || z.f as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits
  from f v, f w, f x, f y, f z where v.bit + w.bit + x.bit + y.bit + z.bit = 31 and v.bit | w.bit | x.bit | y.bit | z.bit = 31
), s as (
  select filter_order, step::int as step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from o, range(1, 6) r(step)
), r as (
  select part, filter_order, step, bit,
         sum(n) filter (mask & (before | bit) = 0) as kept, sum(n) filter (mask & bit <> 0 and mask & before = 0) as removed,
         sum(n) filter (mask & bit <> 0 and mask & before <> 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
         sum(good) filter (mask & bit <> 0 and mask & before = 0) as good_lost, sum(toxic) filter (mask & bit <> 0 and mask & before = 0) as toxic_lost
  from k, s group by all
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       coalesce(sum(removed) over (partition by part, bit), 0)::bigint as shapley
from r
"""
