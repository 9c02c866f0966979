"""Fetching over HTTP inside Spark tasks: a rate limit that heeds the server's, retries, decoding, and errors as rows.

Use :func:`fetch` on a table of URLs that is already filtered, so only what is
wanted is fetched, :func:`download` where bodies are too large for a column, or
``spark.read.format("ledgerloom_http")`` for a list.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import math
import time
import urllib.error
import urllib.request
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import BinaryIO, NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.config import check_user_agent
from ledgerloom.shipping import ship
from ledgerloom.sources.shared import STAGING, opened, put_in_place

ship(__name__)

#: A transport takes a URL and headers and gives (status, headers in lower case, body).
Transport = Callable[[str, dict], tuple[int, dict, bytes]]
#: The same with a body to be read in pieces.
Streaming = Callable[[str, dict], tuple[int, dict, BinaryIO]]
RETRIED = frozenset({429, *range(500, 600)})
#: Requests that one task makes in a second if each takes a tenth of one.
TASK_RATE = 10


class TokenBucket:
    """``size`` tokens, refilled evenly over ``interval`` seconds, and a hold that the server's own quota sets.

    ``sharers`` tasks use up the same quota without hearing of each other, each with one request under way: so a
    task waits for the reset once less is left than all of them could take at once and one more.
    """

    def __init__(self, size: float = 10, interval: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, sharers: int = 1):
        self.size, self.rate, self.clock, self.sleep, self.sharers = size, size / interval, clock, sleep, sharers
        self.tokens, self.at, self.until = float(size), clock(), clock()

    def _refill(self) -> None:
        now = self.clock()
        self.tokens = min(self.size, self.tokens + (now - self.at) * self.rate)
        self.at = now

    def try_acquire(self) -> bool:
        self._refill()
        if self.tokens < 1 or self.clock() < self.until:
            return False
        self.tokens -= 1
        return True

    def reserve(self) -> float:
        """Take a token, of those to come if there is none; the seconds until it may be used."""
        self._refill()
        self.tokens -= 1
        return max(0.0, self.until - self.clock(), -self.tokens / self.rate)

    def wait(self) -> None:
        while (held := self.until - self.clock()) > 0:  # what an answer said meanwhile counts too
            self.sleep(held)
        if (pause := self.reserve()) > 0:
            self.sleep(pause)

    def heed(self, quota: Quota, wall: Callable[[], float] = time.time) -> None:
        """Hold or slow down as the server's quota asks: none until its reset where it runs low, else no faster than it lasts."""
        now = self.clock()
        if quota.wait is not None:
            self.until = max(self.until, now + quota.wait)
        if quota.remaining is None or quota.reset is None:
            return
        left = max(0.0, quota.reset - wall() if quota.reset > EPOCH else quota.reset)
        spare = quota.remaining - self.sharers
        self.until = max(self.until, now + (left if spare < 1 else min(left, left * self.sharers / quota.remaining) if spare < self.size else 0.0))


#: Reset headers above this are a time, those below a number of seconds from now.
EPOCH = 1_000_000_000


class Quota(NamedTuple):
    """What response headers say of the server's budget; unreadable numbers are None."""

    remaining: int | None = None
    reset: float | None = None
    wait: float | None = None


def quota_of(headers: dict) -> Quota:
    def number(name: str) -> float | None:
        try:
            found = float(headers[name])
        except (KeyError, ValueError):
            return None
        return found if math.isfinite(found) and found >= 0 else None

    remaining = number("x-ratelimit-remaining")
    return Quota(None if remaining is None else int(remaining), number("x-ratelimit-reset"), number("retry-after"))


def with_retries(work: Callable[[], object], attempts: int = 3, first: float = 0.1, factor: float = 2.0, cap: float = 30.0, worth: Callable[[Exception], bool] = lambda _: True, sleep: Callable[[float], None] = time.sleep):
    """``work()``, again after growing pauses if it raises something worth it; the last error is raised."""
    pause = first
    for left in range(attempts - 1, -1, -1):
        try:
            return work()
        except Exception as error:
            if not left or not worth(error):
                raise
            sleep(min(pause, cap))
            pause *= factor


class FetchError(Exception):
    def __init__(self, kind: str, message: str, status: int | None = None):
        super().__init__(message)
        self.kind, self.status = kind, status


def as_exception(error: Exception) -> Exception:
    """What a caller of single requests gets: ValueError for what is asked wrongly or is not there, else RuntimeError."""
    kind = getattr(error, "kind", "io")
    return (ValueError if kind in ("invalid_url", "not_found") else RuntimeError)(f"{kind}: {error}")


def urllib_streaming(url: str, headers: dict) -> tuple[int, dict, BinaryIO]:
    try:
        got = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30)  # noqa: S310
    except urllib.error.HTTPError as error:
        got = error
    return got.status, {k.lower(): v for k, v in got.headers.items()}, got


def urllib_transport(url: str, headers: dict) -> tuple[int, dict, bytes]:
    status, found, body = urllib_streaming(url, headers)
    with body:
        return status, found, body.read()


def decoded(body: bytes, encoding: str | None) -> bytes:
    """gzip, deflate and identity; any other encoding is an error."""
    kind = (encoding or "identity").strip().lower()
    if kind in ("gzip", "x-gzip"):
        return gzip.decompress(body)
    if kind == "deflate":
        return zlib.decompress(body)
    if kind in ("identity", "none", ""):
        return body
    raise FetchError("encoding", f"unsupported encoding {kind}")


def decoded_pieces(body: BinaryIO, encoding: str | None, piece: int = 1 << 20) -> Iterator[bytes]:
    """The decoded body in pieces of at most ``piece`` bytes, whatever it unpacks to. Unknown encodings pass as they are."""
    kind = (encoding or "").strip().lower()
    bits = {"gzip": 31, "x-gzip": 31, "deflate": 15}.get(kind)
    unpack = zlib.decompressobj(bits) if bits else None
    while raw := body.read(piece):
        more = True
        while more:
            if unpack is None:
                yield raw
                break
            if unpack.eof:  # a further gzip member
                unpack = zlib.decompressobj(bits)
            made = unpack.decompress(raw, piece)
            if made:
                yield made
            raw = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            more = bool(raw) or (not unpack.eof and len(made) == piece)
    if unpack is not None and not unpack.eof:
        raise FetchError("encoding", "the body ends too early")


def check_url(url: str, domain: str) -> None:
    parts = urlsplit(url)
    host = (parts.hostname or "").lower()
    if parts.scheme != "https" or not (host == domain or host.endswith(f".{domain}")):
        raise FetchError("invalid_url", f"only https URLs of {domain} may be fetched")


class Request:
    """One URL's attempts. The URL is checked before any of them; each takes a token and heeds the quota in the answer; 429, 5xx and I/O errors are retried."""

    def __init__(self, url: str, agent: str, bucket: TokenBucket, domain: str = "sec.gov", attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.url, self.agent, self.bucket, self.domain, self.most, self.sleep = url, agent, bucket, domain, attempts, sleep
        self.attempts, self.status = 0, None

    def run(self, transport: Callable, use: Callable):
        """``use(headers, body)`` of an answer that is 200."""
        check_url(self.url, self.domain)

        def once():
            self.bucket.wait()
            self.attempts += 1
            self.status = None
            self.status, headers, body = transport(self.url, {"User-Agent": self.agent, "Accept": "*/*", "Accept-Encoding": "gzip, deflate", "Host": urlsplit(self.url).netloc})
            self.bucket.heed(quota_of(headers))
            if self.status != 200:
                raise FetchError({429: "rate_limited", 404: "not_found"}.get(self.status, "invalid_response"), f"status {self.status}", self.status)
            return use(headers, body)

        def worth(error: Exception) -> bool:
            return isinstance(error, OSError) or (isinstance(error, FetchError) and error.status in RETRIED)

        return with_retries(once, self.most, worth=worth, sleep=self.sleep)


def get(url: str, agent: str, transport: Transport, bucket: TokenBucket, domain: str = "sec.gov", attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The decoded body of one URL."""
    return Request(url, agent, bucket, domain, attempts, sleep).run(transport, lambda headers, body: decoded(body, headers.get("content-encoding")))


#: A transport for requests with a body: method, URL, headers and body to (status, headers in lower case, body).
Sending = Callable[[str, str, dict, bytes], tuple[int, dict, bytes]]


def urllib_sending(method: str, url: str, headers: dict, body: bytes, timeout: float = 300) -> tuple[int, dict, bytes]:
    try:
        got = urllib.request.urlopen(urllib.request.Request(url, body, headers, method=method), timeout=timeout)  # noqa: S310
    except urllib.error.HTTPError as error:
        got = error
    with got:
        return got.status, {k.lower(): v for k, v in got.headers.items()}, got.read()


class JsonClient:
    """JSON requests of one task, several at a time under one budget, with the retries of :class:`Request`."""

    def __init__(self, bucket: TokenBucket, sending: Sending = urllib_sending, in_flight: int = 8, attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.bucket, self.sending, self.in_flight, self.attempts, self.sleep = bucket, sending, in_flight, attempts, sleep
        self.lock = Lock()

    def ask(self, method: str, url: str, value: object) -> object:
        body = json.dumps(value).encode()

        def once() -> object:
            with self.lock:
                pause = self.bucket.reserve()
            if pause > 0:
                self.sleep(pause)
            status, headers, got = self.sending(method, url, {"Content-Type": "application/json"}, body)
            with self.lock:
                self.bucket.heed(quota_of(headers))
            if not 200 <= status < 300:
                raise FetchError({429: "rate_limited", 404: "not_found"}.get(status, "invalid_response"), f"status {status}", status)
            return json.loads(got or b"null")

        return with_retries(once, self.attempts, worth=lambda e: isinstance(e, OSError) or getattr(e, "status", None) in RETRIED, sleep=self.sleep)

    def ask_all(self, requests: list[tuple[str, str, object]]) -> list[object]:
        """An answer for each request, in their order; an exception in the place of one that failed."""

        def one(request: tuple[str, str, object]) -> object:
            try:
                return self.ask(*request)
            except Exception as error:  # noqa: BLE001  one failure must not stop the others
                return error

        with ThreadPoolExecutor(max(1, min(self.in_flight, len(requests) or 1))) as pool:
            return list(pool.map(one, requests))


class Client:
    """Single requests from the driver, for scripts. What is asked wrongly or is not there is a ValueError, all else a RuntimeError."""

    def __init__(self, agent: str, transport: Transport = urllib_transport, per_second: float = 10, domain: str = "sec.gov", attempts: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.agent, self.transport, self.domain, self.attempts, self.sleep = check_user_agent(agent), transport, domain, attempts, sleep
        self.bucket = TokenBucket(per_second, 1.0, sleep=sleep)

    def fetch_bytes(self, url: str) -> bytes:
        try:
            return get(url, self.agent, self.transport, self.bucket, self.domain, self.attempts, self.sleep)
        except Exception as error:
            raise as_exception(error) from error

    def fetch_text(self, url: str) -> str:
        try:
            return self.fetch_bytes(url).decode("utf-8")
        except UnicodeDecodeError as error:
            raise RuntimeError(f"utf8: {error}") from error

    def fetch_json(self, url: str) -> object:
        try:
            return json.loads(self.fetch_text(url))
        except json.JSONDecodeError as error:
            raise RuntimeError(f"json: {error}") from error


def shared_bucket(per_second: float, readers: int) -> TokenBucket:
    """A task's part of a budget that ``readers`` tasks share."""
    rate = per_second / readers
    return TokenBucket(max(1.0, rate), max(1.0, rate) / rate, sharers=readers)


def readers_for(per_second: float, most: int) -> int:
    """As many tasks as it takes to use a budget, so that small ones stay in one task."""
    return max(1, min(most, math.ceil(per_second / TASK_RATE)))


def _with(urls: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema), more])


def fetch(urls: DataFrame, agent: str, url: str = "url", transport: Transport = urllib_transport, per_second: float = 10, readers: int | None = None, domain: str = "sec.gov", held: int = 16 << 20, attempts: int = 3) -> DataFrame:
    """``urls`` plus ``body`` (binary), ``text`` (strict UTF-8), ``status`` (of the last attempt), ``attempts`` and ``error``.

    The budget of ``per_second`` requests is split over ``readers`` tasks: no more than that fetch at a time.
    Rows leave a task by about ``held`` bytes of bodies, however many rows came in together.
    """
    check_user_agent(agent)
    at = urls.columns.index(url)
    readers = readers or readers_for(per_second, urls.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = shared_bucket(per_second, readers)

        def piece(batch: pa.RecordBatch, start: int, got: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.string())
            made = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.slice(start, len(got)).columns, *made], names=[*batch.schema.names, "body", "text", "status", "attempts", "error"])

        for batch in batches:
            start, size, got = 0, 0, []
            for link in batch.column(at).to_pylist():
                request, body, text, error = Request(link or "", agent, bucket, domain, attempts), None, None, None
                try:
                    body = request.run(transport, lambda headers, body: decoded(body, headers.get("content-encoding")))
                    text = body.decode("utf-8")
                except UnicodeDecodeError as e:
                    error = f"utf8: {e}"
                except Exception as e:  # noqa: BLE001  one bad URL must not stop the others
                    error = f"{getattr(e, 'kind', 'io')}: {e}"
                got.append((body, text, request.status, request.attempts, error))
                size += len(body or b"")
                if size >= held:
                    yield piece(batch, start, got)
                    start, size, got = start + len(got), 0, []
            if got:
                yield piece(batch, start, got)

    return urls.repartition(readers).mapInArrow(run, _with(urls, "body binary, text string, status int, attempts int, error string"))


def download(urls: DataFrame, root: str, agent: str, url: str = "url", name: str | None = None, transport: Streaming = urllib_streaming, per_second: float = 10, readers: int | None = None, domain: str = "sec.gov", piece: int = 1 << 20, attempts: int = 3) -> DataFrame:
    """``urls`` plus ``path``, ``bytes``, ``sha256``, ``status``, ``attempts`` and ``error``: bodies go to files under ``root``.

    A body is decoded and written in pieces, so a task holds one piece of it, whatever its size. It is written under a
    name of its own in a staging folder and moved to its place, the column ``name`` or else a hash of the URL, once it is whole:
    a file is there in full or not at all, and a retried task replaces it by the same. ``root`` must be a folder that all tasks share.
    """
    check_user_agent(agent)
    readers = readers or readers_for(per_second, urls.sparkSession.sparkContext.defaultParallelism)
    columns = urls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, (fs, top) = shared_bucket(per_second, readers), opened(root)

        def keep(request: Request, to: str) -> tuple:
            def use(headers: dict, body: BinaryIO) -> tuple:
                part, size, digest = f"{top}/{STAGING}/{uuid.uuid4().hex}", 0, hashlib.sha256()
                fs.create_dir(f"{top}/{STAGING}", recursive=True)
                try:
                    with body, fs.open_output_stream(part) as out:
                        for some in decoded_pieces(body, headers.get("content-encoding"), piece):
                            out.write(some)
                            digest.update(some)
                            size += len(some)
                except BaseException:
                    fs.delete_file(part)
                    raise
                put_in_place(fs, [(part, f"{top}/{to}")])
                return f"{root}/{to}", size, digest.hexdigest()

            return request.run(transport, use)

        for batch in batches:
            got = []
            links = batch.column(columns.index(url)).to_pylist()
            names = batch.column(columns.index(name)).to_pylist() if name else [None] * len(links)
            for link, to in zip(links, names, strict=True):
                request, made, error = Request(link or "", agent, bucket, domain, attempts), (None, None, None), None
                try:
                    made = keep(request, to or hashlib.sha256((link or "").encode()).hexdigest())
                except Exception as e:  # noqa: BLE001
                    error = f"{getattr(e, 'kind', 'io')}: {e}"
                got.append((*made, request.status, request.attempts, error))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            made = [pa.array(c, k) for c, k in zip(zip(*got, strict=True) if got else [()] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*columns, "path", "bytes", "sha256", "status", "attempts", "error"])

    return urls.repartition(readers).mapInArrow(run, _with(urls, "path string, bytes long, sha256 string, status int, attempts int, error string"))


class HttpSource(DataSource):
    """``spark.read.format("ledgerloom_http").option("urls", "a b").option("agent", ...)``: (url, body, error) rows."""

    transport: Transport = staticmethod(urllib_transport)

    @classmethod
    def name(cls) -> str:
        return "ledgerloom_http"

    def schema(self) -> str:
        return "url string, body binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options, type(self).transport)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport):
        self.urls = options.get("urls", "").split()
        self.agent = check_user_agent(options.get("agent", ""))
        self.readers = max(1, min(int(options.get("readers", 1)), len(self.urls) or 1))
        self.rate, self.domain, self.transport = float(options.get("persecond", 10)) / self.readers, options.get("domain", "sec.gov"), transport

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.readers)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        bucket = shared_bucket(self.rate * self.readers, self.readers)
        for url in self.urls[partition.value :: self.readers]:
            try:
                yield url, get(url, self.agent, self.transport, bucket, self.domain), None
            except Exception as error:  # noqa: BLE001
                yield url, None, f"{getattr(error, 'kind', 'io')}: {error}"
