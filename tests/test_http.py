import gzip
import zlib

import pytest

from ledgerloom.shipping import ship
from ledgerloom.sources import http as m

ship(__name__)


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def test_bucket():
    c = Clock()
    b = m.TokenBucket(2, 1, c, c.sleep)
    for _ in range(3):
        b.wait()
    assert sum(c.slept) == pytest.approx(0.5)
    b = m.TokenBucket(1, 1, c, c.sleep)
    assert b.try_acquire() and not b.try_acquire()
    c.now += 1
    assert b.try_acquire()


def test_retries():
    c, calls = Clock(), []

    def work():
        calls.append(1)
        raise OSError("x")

    with pytest.raises(OSError):  # noqa: PT011
        m.with_retries(work, sleep=c.sleep)
    assert len(calls) == 3 and c.slept == [0.1, 0.2]
    with pytest.raises(OSError):  # noqa: PT011
        m.with_retries(work, worth=lambda _: False, sleep=c.sleep)
    assert len(calls) == 4


@pytest.mark.parametrize(("encoding", "body"), [("gzip", gzip.compress(b"hi")), ("deflate", zlib.compress(b"hi")), (None, b"hi"), ("identity", b"hi")])
def test_decoding(encoding, body):
    assert m.decoded(body, encoding) == b"hi"


def test_unknown_encoding():
    with pytest.raises(m.FetchError, match="unsupported"):
        m.decoded(b"", "br")


def fake(url, headers):
    assert headers["User-Agent"] == "tests tests@example.com"
    name = url.rsplit("/", 1)[1]
    if name.isdigit():
        return int(name), {}, b""
    return 200, {"content-encoding": "gzip"}, gzip.compress(b"\xff" if name == "raw" else name.encode())


def test_fetch(spark):
    links = ["https://www.sec.gov/a", "https://www.sec.gov/404", "https://www.sec.gov/429", "https://x.example/sec.gov", "http://www.sec.gov/a", "https://www.sec.gov/raw", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(links)], "i int, url string")
    got = {r.i: r for r in m.fetch(df, "tests tests@example.com", transport=fake, per_second=1000).collect()}
    assert (got[0].text, bytes(got[0].body), got[0].error) == ("a", b"a", None)
    kinds = [got[i].error.split(":")[0] for i in range(1, 7)]
    assert kinds == ["not_found", "rate_limited", "invalid_url", "invalid_url", "utf8", "invalid_url"]


def test_source(spark):
    class Source(m.HttpSource):
        transport = staticmethod(fake)

    spark.dataSource.register(Source)
    read = spark.read.format("ledgerloom_http").option("agent", "tests tests@example.com").option("persecond", "1000")
    rows = read.option("urls", "https://sec.gov/a https://sec.gov/404").option("readers", "2").load().collect()
    assert {(r.url[-1], r.error and r.error.split(":")[0]) for r in rows} == {("a", None), ("4", "not_found")}


class Server:
    """A quota of requests for each window of a shared clock. A request over it is an error of the client."""

    def __init__(self, clock, quota=10, window=60.0, epoch=False):
        self.clock, self.quota, self.window, self.epoch, self.used, self.over, self.at = clock, quota, window, epoch, {}, 0, []

    def __call__(self, url, headers):
        now = self.clock()
        n = self.used[now // self.window] = self.used.get(now // self.window, 0) + 1
        self.at.append(now)
        if n > self.quota:
            self.over += 1
            return 429, {}, b""
        left = self.window - now % self.window
        return 200, {"x-ratelimit-remaining": str(self.quota - n), "x-ratelimit-reset": str(left + (m.EPOCH * 2 + now if self.epoch else 0))}, b"ok"


@pytest.mark.parametrize("epoch", [False, True])
def test_quota_is_never_passed(epoch, monkeypatch):
    c = Clock()
    monkeypatch.setattr(m.TokenBucket.heed, "__defaults__", (lambda: m.EPOCH * 2 + c.now,))
    server, bucket = Server(c, epoch=epoch), m.TokenBucket(100, 1, c, c.sleep)
    for _ in range(40):
        assert m.get("https://sec.gov/a", "agent", server, bucket, sleep=c.sleep) == b"ok"
    assert server.over == 0 and max(server.used.values()) == 9  # none is taken when fewer than two are left
    gaps = [b - a for a, b in zip(server.at, server.at[1:], strict=False)]
    assert sum(g > 0 for g in gaps) > 20  # slowed down before it runs out, not only stopped


def test_tasks_that_share_a_quota_do_not_pass_it():
    """Tasks take turns in any order, each hearing only of its own answers."""
    import random

    made = random.Random(5)
    for sharers in (2, 3, 5):
        c = Clock()
        server = Server(c, quota=12)
        buckets = [m.TokenBucket(100, 1, c, lambda s: None, sharers) for _ in range(sharers)]
        for _ in range(600):
            bucket = made.choice(buckets)
            if bucket.try_acquire():
                bucket.heed(m.quota_of(server("", {})[1]))
            c.now += made.choice([0, 0, 0.5, 2])
        assert server.over == 0 and len(server.at) > 50


def test_quota_headers():
    assert m.quota_of({}) == (None, None, None)
    assert m.quota_of({"x-ratelimit-remaining": "3", "x-ratelimit-reset": "nan", "retry-after": "soon"}) == (3, None, None)
    c = Clock()
    b = m.TokenBucket(5, 1, c, c.sleep)
    b.heed(m.quota_of({"retry-after": "7"}))
    b.wait()
    assert c.now == 7 and not m.TokenBucket(0, 1, c).try_acquire()
    assert isinstance(m.as_exception(m.FetchError("not_found", "x")), ValueError) and isinstance(m.as_exception(OSError("x")), RuntimeError)


def test_readers_follow_the_budget():
    assert [m.readers_for(x, 8) for x in (0.5, 10, 11, 1000)] == [1, 1, 2, 8]


def members(*parts):
    return b"".join(gzip.compress(p) for p in parts)


@pytest.mark.parametrize(("encoding", "raw", "want"), [("gzip", members(b"a" * 9999, b"", b"bc"), b"a" * 9999 + b"bc"), ("deflate", zlib.compress(bytes(5000)), bytes(5000)), ("odd", b"raw", b"raw"), (None, b"", b"")])
@pytest.mark.parametrize("piece", [1, 7, 100, 1 << 20])
def test_pieces(encoding, raw, want, piece):
    import io

    got = list(m.decoded_pieces(io.BytesIO(raw), encoding, piece))
    assert b"".join(got) == want and all(0 < len(g) <= piece for g in got)
    if encoding in ("gzip", "deflate"):
        with pytest.raises(m.FetchError, match="too early"):
            list(m.decoded_pieces(io.BytesIO(raw[:-9]), encoding, piece))


class Zeros:
    """A gzip body of so many megabytes, made as it is read."""

    def __init__(self, megabytes):
        self.left, self.held, self.pack = megabytes, b"", zlib.compressobj(1, zlib.DEFLATED, 31)

    def read(self, n):
        while self.left is not None and len(self.held) < n:
            self.held += self.pack.compress(bytes(1 << 20)) if self.left else self.pack.flush()
            self.left = self.left - 1 if self.left else None
        out, self.held = self.held[:n], self.held[n:]
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (resource.RLIM_INFINITY, resource.RLIM_INFINITY))  # the worker goes on with other tests


def test_download(spark, tmp_path):
    import hashlib
    import io
    import os

    def streaming(url, headers):
        import resource

        name = url.rsplit("/", 1)[1]
        if name == "large":
            used = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
            resource.setrlimit(resource.RLIMIT_AS, (used + (96 << 20), resource.RLIM_INFINITY))  # far less than the body
            return 200, {"content-encoding": "gzip"}, Zeros(256)
        if name == "cut":
            return 200, {"content-encoding": "gzip"}, io.BytesIO(gzip.compress(b"x" * 5000)[:-4])
        return (200, {"content-encoding": "br"}, io.BytesIO(b"raw")) if name == "odd" else (404, {}, io.BytesIO(b""))

    rows = [("large", "a/large.txt"), ("cut", "cut.txt"), ("odd", None), ("gone", "gone.txt")]
    df = spark.createDataFrame([(f"https://sec.gov/{u}", n) for u, n in rows], "url string, file string")
    root = str(tmp_path / "out")
    got = {r.url.rsplit("/", 1)[1]: r for r in m.download(df, root, "tests tests@example.com", name="file", transport=streaming, piece=1 << 16).collect()}
    assert (got["large"].path, got["large"].bytes, got["large"].error) == (f"{root}/a/large.txt", 256 << 20, None)
    assert os.path.getsize(f"{root}/a/large.txt") == 256 << 20
    digest = hashlib.sha256()
    for _ in range(256):
        digest.update(bytes(1 << 20))
    assert got["large"].sha256 == digest.hexdigest()
    assert got["cut"].error.startswith("encoding") and got["cut"].path is None and got["gone"].error == "not_found: status 404"
    assert open(got["odd"].path, "rb").read() == b"raw" and got["odd"].status == 200
    os.truncate(f"{root}/a/large.txt", 0)
    there = [os.path.join(top, f) for top, _, files in os.walk(root) for f in files if not f.endswith(".crc")]
    assert sorted(there) == sorted([got["large"].path, got["odd"].path])  # nothing that is not whole


def test_client():
    slept = []
    client = m.Client("tests tests@example.com", fake, sleep=slept.append)
    assert (client.fetch_text("https://www.sec.gov/a"), client.fetch_json("https://www.sec.gov/true")) == ("a", True)
    assert client.fetch_bytes("https://www.sec.gov/raw") == b"\xff"
    for url, kind, said in [("https://x.example/a", ValueError, "invalid_url"), ("https://sec.gov/404", ValueError, "not_found"), ("https://sec.gov/429", RuntimeError, "rate_limited"), ("https://sec.gov/500", RuntimeError, "invalid_response")]:
        with pytest.raises(kind, match=said):
            client.fetch_text(url)
    for call, said in ((client.fetch_text, "utf8"), (client.fetch_json, "utf8")):
        with pytest.raises(RuntimeError, match=said):
            call("https://sec.gov/raw")
    with pytest.raises(RuntimeError, match="json"):
        client.fetch_json("https://sec.gov/a")
    with pytest.raises(ValueError, match="user agent"):
        m.Client("nobody")
