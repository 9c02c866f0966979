import json
import threading
import time

import pytest

from ledgerloom.operators import remote as m
from ledgerloom.operators import summarize
from ledgerloom.shipping import ship
from ledgerloom.sources.http import FetchError, JsonClient, TokenBucket, shared_bucket

ship(__name__)


class Server:
    """Answers prompts by their number, slower ones first, and counts how many it has under way."""

    def __init__(self, fail=()):
        self.fail, self.now, self.most, self.asked, self.lock = set(fail), 0, 0, [], threading.Lock()

    def __call__(self, method, url, headers, body):
        value = json.loads(body)
        number = int(value["prompt"])
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.asked.append((method, url, number))
            tries = sum(n == number for _, _, n in self.asked)
        time.sleep(0.05 / (1 + number))
        with self.lock:
            self.now -= 1
        if number in self.fail:
            return 404, {}, b""
        if number % 3 == 1 and tries == 1:
            return 503, {}, b""
        return 200, {}, json.dumps({"response": f"answer {number}"} if number != 8 else {"other": 1}).encode()


def test_answers_in_order_with_several_in_flight():
    server = Server(fail=[5])
    ask = m.ollama_model("tiny", "http://host:1/", sending=server, per_second=1e6, in_flight=4, sleep=lambda s: None)
    got = ask([str(i) for i in range(12)])
    assert [g for i, g in enumerate(got) if i not in (5, 8)] == [f"answer {i}" for i in range(12) if i not in (5, 8)]
    assert isinstance(got[5], FetchError) and got[5].kind == "not_found" and isinstance(got[8], ValueError)
    assert 1 < server.most <= 4 and {(a, u) for a, u, _ in server.asked} == {("POST", "http://host:1/api/generate")}
    counts = [sum(n == i for _, _, n in server.asked) for i in range(12)]
    assert counts == [2 if i % 3 == 1 else 1 for i in range(12)]  # 503 is tried again, 404 is not


def test_threads_share_the_budget():
    """Reservations of all threads together keep to the rate."""
    now, slept = [0.0], []
    client = JsonClient(TokenBucket(2, 1, lambda: now[0], lambda s: None), lambda *a: (200, {}, b"1"), 6, sleep=slept.append)
    assert client.ask_all([("POST", "u", None)] * 10) == [1] * 10
    assert sorted(round(s, 3) for s in slept) == [round(i / 2, 3) for i in range(1, 9)]


def test_names():
    assert summarize.model("ollama:m").url == "http://localhost:11434/api/generate"
    with pytest.raises(ValueError, match="HF_ENDPOINT_URL"):
        summarize.model("hf:m")
    ask = m.generation_model("id", "https://e.example/", sending=lambda *a: (200, {}, b'[{"generated_text": "t"}]'))
    assert ask(["x"]) == ["t"] and ask.value_of("p")["inputs"] == "p"
    assert m.ollama_model("a", sending=None).readers == 1


def sending(method, url, headers, body):
    value = json.loads(body)
    if "three" in value["prompt"]:
        return 404, {}, b""
    return 200, {}, json.dumps({"response": json.dumps({"summary": value["prompt"].rsplit("Part:\n", 1)[1].strip()})}).encode()


def test_failures_are_rows_of_their_own(spark):
    rows = [("A", i, t) for i, t in enumerate(["one", "two", "three", "four"])]
    df = spark.createDataFrame(rows, "symbol string, chunk_pos int, text string").repartition(3)
    got = summarize.summarize(df, ["symbol"], "x", m.ollama_model("t", sending=sending, per_second=1e6, readers=2, attempts=1), batch_size=2)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # for the batches, then for the readers
    said = {r.chunk_pos: (r.result.summary, r.result.error) for r in got.collect()}
    assert said == {0: ("one", None), 1: ("two", None), 2: (None, "FetchError: status 404"), 3: ("four", None)}


def test_points_go_to_a_store(spark, tmp_path):
    log = str(tmp_path / "log")

    def store(method, url, headers, body):
        if url.endswith("bad/points?wait=true"):
            return 400, {}, b"{}"
        with open(f"{log}-{threading.get_ident()}-{time.monotonic_ns()}", "w") as f:
            json.dump([method, url, json.loads(body)], f)
        return 200, {}, b"{}"

    rows = [(f"i{i}", "good" if i % 4 else "bad", [float(i), 1.0], f"t{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, collection string, vector array<double>, text string")
    for _ in range(2):
        said = m.push_points(df, "http://store:6333", batch=4, per_second=1e6, sending=store).collect()
        assert sum(r.points for r in said if r.error is None) == 15 and {r.error for r in said if r.collection == "bad"} == {"invalid_response: status 400"}
    sent = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    points = [p for method, url, body in sent for p in body["points"]]
    assert {(a, u) for a, u, _ in sent} == {("PUT", "http://store:6333/collections/good/points?wait=true")} and max(len(b["points"]) for _, _, b in sent) <= 4
    assert len(points) == 30 and len({p["id"] for p in points}) == 15  # the same ids again
    assert {p["payload"]["text"]: p["vector"] for p in points}["t7"] == [7.0, 1.0]


def test_remote_collections_are_made_once():
    there, asked = {}, []

    def store(method, url, headers, body):
        asked.append((method, json.loads(body)))
        if method == "GET":
            return (200, {}, b"{}") if url in there else (404, {}, b"")
        there[url] = json.loads(body)
        return 200, {}, b"{}"

    for _ in range(2):
        m.ensure_remote("http://s", "c", 64, "Dot", store)
    assert asked == [("GET", None), ("PUT", {"vectors": {"size": 64, "distance": "Dot"}}), ("GET", None)]
    assert shared_bucket(10, 2).sharers == 2
