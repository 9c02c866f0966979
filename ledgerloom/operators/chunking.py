"""Cutting texts into overlapping chunks, and keeping those that have a keyword."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import has_keyword
from ledgerloom.shipping import ship

ship(__name__)


def fixed_chunks(docs: DataFrame, size: int = 2000, overlap: int = 200, text: str = "text") -> DataFrame:
    """Windows of ``size`` characters, each ``size - overlap`` after the last, none made of overlap alone. Native."""
    last = F.greatest(F.length(text) - F.lit(overlap + 1), F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    cut = docs.select(*[c for c in docs.columns if c != text], F.col(text).alias("_whole"), F.posexplode(starts).alias("chunk_pos", "start_index"))
    return cut.withColumn("text", F.substring("_whole", F.col("start_index") + 1, F.lit(size))).where("length(text) > 0").drop("_whole")


SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """``(start, chunk)``: split at the coarsest separator that makes pieces fit, merged greedily, overlap in whole pieces.

    Pieces keep their separator; chunks are trimmed, and their start is that of the trimmed chunk in the text.
    """

    def pieces(start: int, stop: int, level: int) -> Iterator[tuple[int, int]]:
        if stop - start <= size:
            yield start, stop
            return
        mark = separators[level]
        at = start
        while at < stop:
            if mark:
                found = text.find(mark, at, stop)
                end = stop if found < 0 else found + len(mark)
            else:
                end = min(stop, at + 1)
            if end - at > size:
                yield from pieces(at, end, level + 1)
            else:
                yield at, end
            at = end

    out: list[tuple[int, str]] = []

    def close(a: int, b: int) -> None:
        whole = text[a:b]
        kept = whole.strip()
        if kept:
            out.append((a + len(whole) - len(whole.lstrip()), kept))

    held: list[tuple[int, int]] = []
    for a, b in pieces(0, len(text), 0):
        if held and b - held[0][0] > size:
            close(held[0][0], held[-1][1])
            while held and (held[-1][1] - held[0][0] > overlap or b - held[0][0] > size):
                held.pop(0)
        held.append((a, b))
    if held:
        close(held[0][0], held[-1][1])
    return out


def recursive_chunks(docs: DataFrame, size: int = 2000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, chunk_pos, start_index, text)`` by :func:`recursive_pieces`, in Arrow batches beside the text's row."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, start, chunk = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                for p, (s, c) in enumerate(recursive_pieces(value.as_py() or "", size, overlap)):
                    at.append(i)
                    pos.append(p)
                    start.append(s)
                    chunk.append(c)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int32()), pa.array(start, pa.int32()), pa.array(chunk, pa.string())], names=[key, "chunk_pos", "start_index", "text"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {kind.simpleString()}, chunk_pos int, start_index int, text string")


#: Chunkers by name: each takes (docs, size, overlap) and gives rows with chunk_pos, start_index and text.
CHUNKERS: dict[str, Callable[..., DataFrame]] = {"fixed": fixed_chunks, "recursive": recursive_chunks}


def matching_chunks(docs: DataFrame, keyword: str, chunker: str = "fixed", size: int = 2000, overlap: int = 200) -> DataFrame:
    """Chunks that have the keyword. Texts that lack it are dropped before they are cut: chunks are parts of them."""
    some = docs.where(has_keyword(F.col("text"), keyword))
    return CHUNKERS[chunker](some, size, overlap).where(has_keyword(F.col("text"), keyword))
