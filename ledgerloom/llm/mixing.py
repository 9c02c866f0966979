"""Mixing sources to target weights.

Method: tokens are summed per source; each source gets a target from its
weight; its repetition rate is target over size. A document is emitted
floor(rate) times, plus once more if a hash of its id, seeded and uniform in
[0, 1), falls under the fraction.

Scale: one aggregation by source with map-side partial sums, so a source that
holds most rows is still a handful of partial rows. Rates come back by a join
on source whose table has one row per source. Copies are made by exploding a
sequence, without another shuffle.

Nulls and edge cases: a null text has size 0; a null source is a source of its
own, ordered last; a null doc_id hashes as the empty text; repeated rows share
one hash, so they are taken together; an empty table gives an empty result; a
source of size 0 has rate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, materialize, table

#: Hash values are 13 hexadecimal digits.
DIGITS = 13


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``budget`` times all sizes. No target passes ``most`` times its source's
    size; the excess goes to the others by weight until none is above.
    """
    spark = sizes.sparkSession
    ranked = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = materialize(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("top")),
        "sources",
    )
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, full = 0.0, -1
    while True:  # each round fixes at least one more source at its top
        is_full = F.col("top") < F.col("weight") * F.lit(share)
        got = ranked.agg(
            F.count(F.when(is_full, 1)),
            F.coalesce(F.sum(F.when(is_full, F.col("top"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if got[0] == full or not got[2]:
            break
        full, share = got[0], (budget * total - got[1]) / got[2]
    target = F.least(F.col("top"), F.col("weight") * F.lit(share))
    return ranked.select("source", "source_size", target.alias("target"))


def copies(rate: Column, doc_id: Column, seed: str = "mix") -> Column:
    """floor(rate), plus one where the document's hash falls under the fraction."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, DIGITS), 16, 10).cast("long")
    extra = drawn.cast("double") < (rate - F.floor(rate)) * F.lit(float(16**DIGITS))
    return (F.floor(rate) + F.when(extra, 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """``(row, size, source_size, target, copies)``: each row of ``docs`` as a struct, so none of its names can clash."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    sized = docs.select(row, docs["source"].alias("source"), size_of(docs["text"]).alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes, **settings).withColumnRenamed("source", "from")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("from")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return joined.select("row", "size", "source_size", "target", copies(rate, F.col("row.doc_id"), seed).alias("copies"))


def mix(docs: DataFrame, seed: str = "mix", **settings) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as many times as its source's rate says."""
    planned = plan_mix(docs, seed, **settings).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, over the whole table."""
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), r as (
  select source, source_size, source_size * 2.0::double as cap,
         [5.0::double, 2.0, 1.0][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight
  from s
), c as (
  select *, sum(cap) over (order by cap / weight, source nulls last) as caps,
         sum(weight) over (order by cap / weight, source nulls last) as weights,
         sum(weight) over () as all_weights,
         1.5::double * sum(source_size) over () as budget
  from r
), l as (
  select max((budget - (caps - cap)) / (all_weights - (weights - weight))) filter (
           (budget - (caps - cap)) / (all_weights - (weights - weight)) <= cap / weight) as share
  from c
), t as (
  select source, source_size, case when source_size = 0 then 0.0 else least(cap, weight * share) end as target
  from r, l
), e as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double as drawn
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (size * (floor(rate) + case when drawn < (rate - floor(rate)) * 4503599627370496.0 then 1 else 0 end))::bigint as taken
from e
"""
