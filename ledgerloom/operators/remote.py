"""Models and vector stores that are reached over HTTP from inside the tasks."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.shipping import ship
from ledgerloom.sources.http import JsonClient, Sending, readers_for, shared_bucket, urllib_sending

ship(__name__)


class RemoteModel:
    """A model behind an HTTP endpoint: a list of prompts to as many answers, in order, an exception in the place of one that failed.

    ``readers`` tasks call it at a time and share the budget; each has up to ``in_flight`` prompts under way. The client
    is made where it is used, once for each worker.
    """

    def __init__(self, url: str, value_of: Callable[[str], object], text_of: Callable[[object], str], per_second: float = 10, readers: int = 1, in_flight: int = 8, attempts: int = 3, sending: Sending = urllib_sending, sleep: Callable[[float], None] = time.sleep):
        self.url, self.value_of, self.text_of, self.per_second, self.readers = url, value_of, text_of, per_second, readers
        self.in_flight, self.attempts, self.sending, self.sleep, self.client = in_flight, attempts, sending, sleep, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"client": None}

    def __call__(self, prompts: list[str]) -> list[str | Exception]:
        if self.client is None:
            self.client = JsonClient(shared_bucket(self.per_second, self.readers), self.sending, self.in_flight, self.attempts, self.sleep)
        out: list[str | Exception] = []
        for got in self.client.ask_all([("POST", self.url, self.value_of(p)) for p in prompts]):
            try:
                out.append(got if isinstance(got, Exception) else str(self.text_of(got)))
            except (KeyError, IndexError, TypeError) as error:
                out.append(ValueError(f"the answer lacks its text: {error!r}"))
        return out


def ollama_model(name: str, base_url: str | None = None, temperature: float = 0.1, **http) -> RemoteModel:
    """A model of a local model server, at ``base_url``, else OLLAMA_BASE_URL, else this machine."""
    base = (base_url or os.environ.get("OLLAMA_BASE_URL") or "http://localhost:11434").rstrip("/")
    value = lambda prompt: {"model": name, "prompt": prompt, "stream": False, "options": {"temperature": temperature}}
    return RemoteModel(f"{base}/api/generate", value, lambda got: got["response"], **http)


def generation_model(name: str, base_url: str | None = None, max_new_tokens: int = 1024, **http) -> RemoteModel:
    """A hosted model by its id, behind a text-generation endpoint: ``base_url``, else HF_ENDPOINT_URL."""
    base = base_url or os.environ.get("HF_ENDPOINT_URL")
    if not base:
        raise ValueError("set HF_ENDPOINT_URL to the endpoint that serves the model")
    value = lambda prompt: {"inputs": prompt, "model": name, "parameters": {"max_new_tokens": max_new_tokens, "return_full_text": False}}
    return RemoteModel(base.rstrip("/"), value, lambda got: (got[0] if isinstance(got, list) else got)["generated_text"], **http)


def push_points(points: DataFrame, location: str, batch: int = 256, per_second: float = 50, readers: int | None = None, sending: Sending = urllib_sending, in_flight: int = 4, attempts: int = 3, vector: str = "vector") -> DataFrame:
    """``(collection, points, error)``: points put into the collections of a vector store, a row for each request.

    ``points`` has ``id``, ``collection``, the vector and what is to be its payload. Ids become name-based UUIDs, which
    such stores ask for, so a retried task or a rerun replaces its points instead of adding them. Tasks send straight from
    their rows; a request that fails is a row with ``error``.
    """
    readers = readers or readers_for(per_second, points.sparkSession.sparkContext.defaultParallelism)
    payload = [c for c in points.columns if c not in ("id", "collection", vector)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = JsonClient(shared_bucket(per_second, readers), sending, in_flight, attempts)
        for some in batches:
            rows: dict[str, list] = {}
            for r in some.to_pylist():
                point = {"id": str(uuid.uuid5(uuid.NAMESPACE_URL, r["id"])), "vector": r[vector], "payload": {c: r[c] for c in payload}}
                rows.setdefault(r["collection"], []).append(point)
            asked = [(name, held[i : i + batch]) for name, held in rows.items() for i in range(0, len(held), batch)]
            got = client.ask_all([("PUT", f"{location}/collections/{name}/points?wait=true", {"points": held}) for name, held in asked])
            errors = [f"{getattr(g, 'kind', 'io')}: {g}" if isinstance(g, Exception) else None for g in got]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in asked], pa.string()), pa.array([len(h) for _, h in asked], pa.int64()), pa.array(errors, pa.string())], names=["collection", "points", "error"])

    return points.repartition(readers).mapInArrow(run, "collection string, points long, error string")


def ensure_remote(location: str, collection: str, size: int, metric: str = "Cosine", sending: Sending = urllib_sending) -> None:
    """Make a store's collection if it is not there; one that is stays as it is."""
    from ledgerloom.sources.http import FetchError

    client = JsonClient(shared_bucket(10, 1), sending)
    url = f"{location}/collections/{collection}"
    try:
        client.ask("GET", url, None)
    except FetchError as error:
        if error.kind != "not_found":
            raise
        client.ask("PUT", url, {"vectors": {"size": size, "distance": metric}})
