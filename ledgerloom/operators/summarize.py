"""Summaries of chunks in micro-batches through a pluggable model, with errors as data."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.parsing import with_summary
from ledgerloom.functions.text import format_prompt
from ledgerloom.operators.remote import generation_model, ollama_model
from ledgerloom.shipping import ship

ship(__name__)

#: A model takes prompts and gives as many answers; an exception in the place of one marks its row only.
Model = Callable[[list[str]], list[str | Exception]]

PROMPT = """Summarise one part of a company filing.

Company: {symbol}
Topic: {search_term}

Answer with one JSON object with the keys "summary" (text or null), "points" (a list of at
most five short texts, or null), "confidence" (a number from 0 to 1, or null), "error" (text
or null) and "raw_output" (text or null), as in {{"summary": null, "error": "nothing found"}}.
Use only what the part says.

Part:
{chunk}
"""


def extractive_model(prompts: list[str]) -> list[str]:
    """An offline model: the sentences of the part that name the topic, shortest first. Same prompt, same answer."""
    out = []
    for prompt in prompts:
        topic = re.search(r"^Topic: (.*)$", prompt, re.M)
        term, part = (topic[1].lower() if topic else ""), prompt.split("\nPart:\n", 1)[-1]
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", part) if s.strip()]
        points = sorted({s for s in sentences if term and term in s.lower()}, key=lambda s: (len(s), s))[:5]
        answer = {"summary": points[0] if points else None, "points": points or None, "confidence": round(len(points) / 5, 2) if points else None}
        out.append(json.dumps(answer | ({} if points else {"error": "nothing found"})))
    return out


#: Nothing is generated: answers hold sentences of the part only, so no limit of new tokens cuts them.
extractive_model.whole = True


#: Models by name; ``prefix:id`` names are looked up by their prefix and called with the id.
MODELS: dict[str, Callable[[str], Model]] = {"extractive": lambda _: extractive_model, "ollama": ollama_model, "hf": generation_model}


def model(name: str) -> Model:
    kind, _, rest = name.partition(":")
    if kind not in MODELS:
        raise ValueError(f"no model {kind!r}; register it in MODELS")
    return MODELS[kind](rest)


def micro_batches(chunks: DataFrame, by: list[str], order: list[str], size: int = 16) -> DataFrame:
    """Adds ``batch_no``: runs of ``size`` rows of one document, in order."""
    row = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return chunks.withColumn("batch_no", F.floor(row / size).cast("int"))


def answers(inputs: DataFrame, ask: Model, batch: list[str], retries: int = 1, max_chars: int | None = None) -> DataFrame:
    """``inputs`` (with ``prompt``) plus ``answer`` and ``failure``. A batch whose calls all fail marks each of its rows.

    A model that names ``readers`` is called by so many tasks at a time.
    """
    told = lambda error: f"{type(error).__name__}: {error}"

    def run(table: pa.Table) -> pa.Table:
        prompts = table.column("prompt").to_pylist()
        for left in range(max(1, retries) - 1, -1, -1):
            try:
                got = ask(prompts)
                if len(got) != len(prompts):
                    raise ValueError("the model gave another number of answers")
                break
            except Exception as error:  # noqa: BLE001  whatever a model raises becomes data
                if not left:
                    got = [error] * len(prompts)
        failures = [told(a) if isinstance(a, Exception) else None for a in got]
        texts = [None if a is None or isinstance(a, Exception) else a[:max_chars] for a in got]
        return table.append_column("answer", pa.array(texts, pa.string())).append_column("failure", pa.array(failures, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema) + ", answer string, failure string"
    readers = getattr(ask, "readers", None)
    dealt = inputs.repartition(readers, *batch) if readers else inputs
    return dealt.groupBy(*batch).applyInArrow(run, schema)


def summarize(
    chunks: DataFrame, by: list[str], search_term: str, ask: Model = extractive_model, batch_size: int = 16, retries: int = 1,
    require_json: bool = True, max_chars: int | None = None, template: str = PROMPT,
) -> DataFrame:
    """``(*by, symbol, chunk_pos, result)``, result the summary record, for chunks with ``symbol``, ``chunk_pos`` and ``text``."""
    prompt = format_prompt(template, symbol=F.col("symbol"), search_term=F.lit(search_term), chunk=F.col("text"))
    keys = list(dict.fromkeys([*by, "symbol", "chunk_pos"]))
    numbered = micro_batches(chunks, by, ["chunk_pos"], batch_size).select(*keys, "batch_no", prompt.alias("prompt"))
    got = answers(numbered, ask, [*by, "batch_no"], retries, max_chars)
    read = with_summary(got, "answer", "result")
    if not require_json:  # a plain answer is the summary
        plain = F.struct(F.col("answer").alias("summary"), *[F.lit(None).cast(t).alias(n) for n, t in (("points", "array<string>"), ("confidence", "double"), ("error", "string"))], F.col("answer").alias("raw_output"))
        read = read.withColumn("result", F.when(F.col("result.error").isNull(), F.col("result")).otherwise(plain))
    broken = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("summary", "string"), ("points", "array<string>"), ("confidence", "double"))], F.col("failure").alias("error"), F.lit(None).cast("string").alias("raw_output"))
    return read.select(*keys, F.when(F.col("failure").isNotNull(), broken).otherwise(F.col("result")).alias("result"))


def envelopes(summaries: DataFrame, by: list[str]) -> DataFrame:
    """One row for each document with ``summaries``, its records in chunk order."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_pos", "result")))
    return summaries.groupBy(*by).agg(F.transform(rows, lambda r: r["result"]).alias("summaries"))
