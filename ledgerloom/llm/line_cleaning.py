"""Line-first cleaning with native column expressions only.

Method: a text is split at newlines and each line is judged by three rules:

* punctuation: a line of ``min_line_words`` words or more fails if it has no
  sentence mark at all, if more than ``max_loud`` of its words end in two or
  more marks such as ``!!``, or if it has more than ``max_symbols`` symbols of
  ``#*$%&|<>`` a word;
* navigation: at least three separators (``|``, ``»``, ``›``, ``•``), and more
  than one for each four words;
* boilerplate: the line has one of the fixed phrases below.

Failing lines are removed. A document is rejected if the removed lines held
more than ``max_removed`` of its word characters, if it has fewer than
``min_words`` words, or if too many of its words stand in repeated three-word
windows.

Scale: every figure is computed within its row, so there is no shuffle, and
nothing leaves the JVM. Repeated windows are found by sorting 64-bit window
hashes, in n log n for a text of n words.

Nulls and edge cases: a null text counts as empty: no words, rejected, cleaned
text empty. Rows are independent, so ties, repeats and other columns do not
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

# Phrases of boilerplate lines, matched without regard to case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "terms of service",
    "terms of use",
    "use of cookies",
    "lorem ipsum",
)

#: For each line, the marks and counts that the rules need.
_LINE = r"""
transform(_lines, l -> struct(
  l as line,
  regexp_count(l, '[^\\x20\\x09-\\x0D]+') as words,
  length(translate(l, ' \t\n\u000b\u000c\r', '')) as chars,
  length(l) - length(translate(l, '#*$%&|<>', '')) as symbols,
  length(l) - length(translate(l, '|»›•', '')) as bars,
  regexp_count(l, '[!?*#$%&]{2,}(?=[\\x20\\x09-\\x0D]|$)') as loud,
  length(l) - length(translate(l, '.,;:!?…。！？、，', '')) as marks,
  l rlike '(?i){phrases}' as boilerplate))
"""
_FAILS = """
transform(_marked, m -> struct(m.line as line, m.chars as chars,
  m.boilerplate
  or (m.bars >= 3 and m.bars * 4 > m.words)
  or (m.words >= {min_line_words} and (m.marks = 0 or m.loud > {max_loud} * m.words or m.symbols > {max_symbols} * m.words))
  as fails))
"""
_HASHES = """
slice(transform(_words, (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2))), 1, greatest(size(_words) - 2, 0))
"""
_REPEATED = """
if(size(array_distinct(_hashes)) < size(_hashes), sort_array(transform(_hashes, (h, i) -> struct(h as h, i as i))), array())
"""
_TWINS = """
flatten(zip_with(_sorted, slice(_sorted, 2, size(_sorted)), (a, b) -> if(a.h = b.h, array(a.i, b.i), cast(array() as array<int>))))
"""


def with_figures(docs: DataFrame, min_line_words: int = 8, max_loud: float = 0.3, max_symbols: float = 0.5) -> DataFrame:
    """Each row of ``docs`` as a struct ``_row``, with the document's figures and its judged lines."""
    rules = {"min_line_words": min_line_words, "max_loud": max_loud, "max_symbols": max_symbols}
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    out = docs.select(row, F.coalesce(docs["text"], F.lit("")).alias("_text"))
    out = out.withColumn("_words", F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    out = out.withColumn("_lines", F.split("_text", "\n"))
    out = out.withColumn("_hashes", F.expr(_HASHES))
    out = out.withColumn("_sorted", F.expr(_REPEATED))
    out = out.withColumn("_starts", F.array_distinct(F.expr(_TWINS)))
    out = out.withColumn("_covered", F.expr("size(array_distinct(flatten(transform(_starts, i -> array(i, i + 1, i + 2)))))"))
    out = out.withColumn("_marked", F.expr(_LINE.replace("{phrases}", "|".join(BOILERPLATE))))
    out = out.withColumn("_judged", F.expr(_FAILS.format(**rules)))
    out = out.withColumn("_worded", F.expr("transform(filter(_marked, m -> m.words > 0), m -> m.line)"))
    return (
        out.withColumn("_n_words", F.size("_words").cast("long"))
        .withColumn("_word_chars", F.expr(r"cast(length(translate(_text, ' \t\n\u000b\u000c\r', '')) as bigint)"))
        .withColumn("_n_symbols", F.expr("cast(length(_text) - length(translate(_text, '#*$%&|<>', '')) as bigint)"))
        .withColumn("_n_dup_lines", (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"))
        .withColumn("_n_repeat_words", F.col("_covered").cast("long"))
        .withColumn("_removed", F.expr("aggregate(_judged, 0L, (n, j) -> n + if(j.fails, j.chars, 0))"))
    )


def judge(
    docs: DataFrame, min_words: int = 50, max_repeat: float = 0.5, max_removed: float = 0.5, **rules
) -> DataFrame:
    """:func:`with_figures` plus ``_base_failed`` and ``_kept``."""
    base = (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > F.lit(100 * max_repeat) * F.col("_n_words"))
    return (
        with_figures(docs, **rules)
        .withColumn("_base_failed", base)
        .withColumn("_kept", ~base & (F.col("_removed") <= F.lit(max_removed) * F.col("_word_chars")))
    )


def clean(docs: DataFrame, **settings) -> DataFrame:
    """The documents that pass, with failing lines removed from ``text``."""
    kept = judge(docs, **settings).where("_kept")
    text = F.expr("array_join(transform(filter(_judged, j -> not j.fails), j -> j.line), '\n')")
    return kept.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op8_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document, over whole texts."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("_row.doc_id", *[F.col(f"_{n}").alias(n) for n in names])


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         row_number() over () as r
  from documents
), f as (
  select r, doc_id, words, text, len(words)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols
  from d
), l as (
  select r, unnest(string_split(text, chr(10))) as line from d
), m as (
  select r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as symbols,
         length(regexp_replace(line, '[^|»›•]', '', 'g')) as bars,
         len(regexp_extract_all(line, '[!?*#$%&][!?*#$%&]+(?:[\x20\x09-\x0D]|$)')) as loud,
         length(regexp_replace(line, '[^.,;:!?…。！？、，]', '', 'g')) as marks,
         regexp_matches(line, '(?i){phrases}') as boilerplate
  from l
), g as (
  select r, count(*) filter (words > 0) - count(distinct line) filter (words > 0) as n_dup_lines,
         coalesce(sum(chars) filter (boilerplate or (bars >= 3 and bars * 4 > words)
           or (words >= 8 and (marks = 0 or loud > 0.3 * words or symbols > 0.5 * words))), 0) as removed
  from m group by r
), w as (
  select r, unnest(range(1, len(words) - 1)) as i, words from d
), v as (
  select r, i, count(*) over (partition by r, words[i], words[i + 1], words[i + 2]) as n from w
), x as (
  select r, count(distinct i + k) as n_repeat_words from v, range(0, 3) t(k) where n > 1 group by r
), b as (
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, removed
  from f join g using (r) left join x using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed <= 0.5 * word_chars as kept
from b
""".replace("{phrases}", "|".join(BOILERPLATE))
