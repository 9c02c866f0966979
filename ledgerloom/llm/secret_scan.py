"""Secret scans with multipart credential linking.

Method: a scan of each text finds base matches (``assign``, ``access``,
``hex``) and weak parts that mean little alone: short assigned secrets, mixed
tokens, other access identifiers, logins and endpoints. Parts are then interval-joined
within a scope of ``reach`` code points of the same text. A weak secret is
reported only near an access identifier or login, a weak access identifier
only near a secret, an endpoint only near both. Base matches always stay.

Scale: texts are scanned once, in place; only the few parts found are
shuffled. The interval join is by (text, block): each block of ``reach`` code
points keeps the first start and last end of each role, and a candidate meets
the blocks that its scope touches. So it makes a few rows for each candidate,
never pairs within a text, however many parts a text has.

Nulls and edge cases: a null or empty text has no match, and the digest of the
empty string; rows with equal id and text share their parts; a null doc_id is
kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text, materialize, row_key, ship, table

ship(__name__)

# The base patterns, the least length of what they find, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "weak_secret", "weak_access", "endpoint")

# Patterns of weak parts.
WEAK_ACCESS = re.compile(r"\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}")
LOGIN = re.compile(
    r"""\b(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.=-]{3,}""", re.I | re.A
)
WEAK_SECRET = re.compile(r"""\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.I | re.A)
MIXED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,}(?![A-Za-z0-9+/])")
ENDPOINT = re.compile(
    r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b|\b(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:-]{3,}""",
    re.I | re.A,
)

_PART = "array<struct<start:long,rank:int,end:long>>"


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """``(start, rank, end)`` of the base matches, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, rank, end)`` of weak parts: identifiers and secrets that overlap no base match and no earlier one of them,
    and endpoints that overlap no earlier endpoint and are not inside one of the others. What stands in an endpoint stays."""
    named = ":" in text or "=" in text
    raw = [(m.start(), 4, m.end()) for m in WEAK_ACCESS.finditer(text)]
    if named:
        raw += [(m.start(), 4, m.end()) for m in LOGIN.finditer(text)]
    if not raw and not any(b[1] == 1 for b in base):
        return []  # every report needs an access identifier or a login
    if named:
        raw += [(m.start(), 3, m.end()) for m in WEAK_SECRET.finditer(text)]
    for m in MIXED.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token):
            raw.append((m.start(), 3, m.end()))
    starts, ends = _bounds(base)
    out: list[tuple[int, int, int]] = []
    reached = 0
    for s, rank, e in sorted(raw):
        before = bisect_left(starts, e)
        if reached <= s and not (before and ends[before - 1] > s):
            out.append((s, rank, e))
            reached = e
    starts, ends = _bounds(base + out)
    for m in ENDPOINT.finditer(text):
        before = bisect_right(starts, m.start())
        if not (before and ends[before - 1] >= m.end()):
            out.append((m.start(), 5, m.end()))
    return sorted(out)


def _bounds(parts: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts in order, and for each the last end up to it."""
    spans = sorted((s, e) for s, _, e in parts)
    return [s for s, _ in spans], list(accumulate((e for _, e in spans), max))


def written(parts: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in parts)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, key1, key2, n_assign, n_access, n_hex, base_sha256, base, weak)`` for each row."""
    part = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))

    def listed(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
        return pa.array([[{"start": s, "rank": r, "end": e} for s, r, e in row] for row in rows], part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, weak, digests = [], [], []
            for text in batch.column(1):
                found = base_matches(text := text.as_py() or "")
                base.append(found)
                weak.append(weak_parts(text, found))
                digests.append(hashlib.sha256(written(found).encode()).hexdigest())
            counts = [pa.array([sum(p[1] == k for p in found) for found in base], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), *counts, pa.array(digests, pa.string()), listed(base), listed(weak)],
                names=["doc_id", "key1", "key2", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"],
            )

    schema = f"doc_id long, key1 long, key2 long, n_assign long, n_access long, n_hex long, base_sha256 string, base {_PART}, weak {_PART}"
    return id_and_text(docs).select("doc_id", "text", *row_key()).mapInArrow(run, schema)


def link_parts(scanned: DataFrame, reach: int = 400) -> DataFrame:
    """``(key1, key2, linked)``: the weak parts of each text that complementary parts stand near."""
    parts = (
        scanned.where("size(weak) > 0")
        .select("key1", "key2", F.explode(F.concat("base", "weak")).alias("p"))
        .select("key1", "key2", "p.start", "p.rank", "p.end")
        .distinct()
    )
    is_access = F.col("rank").isin(1, 4)
    is_secret = F.col("rank").isin(0, 2, 3)
    block = lambda c: F.floor(c / F.lit(reach)).cast("long")
    scopes = (
        parts.where(is_access | is_secret)
        .withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))))
        .groupBy("key1", "key2", "block")
        .agg(
            *[
                f(F.when(role, F.col(c))).alias(f"{name}_{c}")
                for name, role in (("access", is_access), ("secret", is_secret))
                for f, c in ((F.min, "start"), (F.max, "end"))
            ]
        )
    )
    weak = parts.where("rank >= 3").withColumn(
        "block", F.explode(F.sequence(block(F.col("start") - reach), block(F.col("end") + reach)))
    )
    near = lambda n: (F.col(f"{n}_start") <= F.col("end") + reach) & (F.col(f"{n}_end") >= F.col("start") - reach)
    met = weak.join(scopes, ["key1", "key2", "block"]).groupBy("key1", "key2", "start", "rank", "end").agg(
        F.max(F.coalesce(near("access"), F.lit(False))).alias("access"), F.max(F.coalesce(near("secret"), F.lit(False))).alias("secret")
    )
    wanted = (
        F.when(F.col("rank") == 3, F.col("access")).when(F.col("rank") == 4, F.col("secret")).otherwise(F.col("access") & F.col("secret"))
    )
    return met.where(wanted).groupBy("key1", "key2").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def find_secrets(docs: DataFrame, reach: int = 400) -> DataFrame:
    """The columns of :func:`scan` and ``linked`` (null where none)."""
    scanned = materialize(scan(docs), "scanned")
    return scanned.join(link_parts(scanned, reach), ["key1", "key2"], "left")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches and linked parts of every document, over whole texts."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.expr(f"cast(array() as {_PART})"))))
    spans = F.transform(every, lambda p: F.concat_ws(":", F.element_at(kinds, p["rank"] + 1), p["start"], p["end"]))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"))
