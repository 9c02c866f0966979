"""Packing documents into training sequences beside documents that share their words.

Method: lexical retrieval packing. Each shard of documents has a BM25 inverted
index over their token ids. A seed document opens a window; the unused
documents that score best for the seed's most telling tokens fill it, in order
of score, then by place. The document that does not fit is cut, and its rest is
the seed of the next window, so every window but a task's last is full. What
is left at a task's end is cut into powers of two, which need no padding.

Scale: texts are tokenized once and land as a table with 16-bit ids where the
vocabulary allows. It is dealt by range of a min-hash of token pairs, so texts
with common wording share a shard, and equal min-hashes by a second hash, so
that copies spread over as many tasks as their size asks. A task reads its rows
in sorted order and makes a shard of each ``shard_tokens`` ids, whatever its
partition holds; a longer document is a shard of its own. The open window is
carried from shard to shard. The index, the windows and a batch of results are
all that a task holds.

Tokenizing: a token never spans white space, so the ids of a text are those of
its words, one after another; each worker remembers the ids of words it has met,
``REMEMBERED`` at most.

Nulls and edge cases: a null text is empty and has the end id only; repeated
rows are packed each; rows with a null id are packed under it; an empty table
gives no rows; other columns are not read. Reruns of a task give the same rows,
as its input is sorted by all that it reads.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from types import ModuleType
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, ship, table

ship(__name__)

END = 2
WINDOW = 4096
#: Marks that may follow a word's letters, and the code point below which letters have been settled for long.
MARKS, SETTLED = ".,;:!?#*$%&-()", "\u0500"
#: Byte-level models name each byte by a character: printable ones by themselves, the others by those from 256 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_NAMES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Words longer than this are tokenized anew each time; words remembered before all are forgotten.
LONG_WORD, REMEMBERED = 64, 500_000
MEMORY = "ledgerloom_words_of_worker"


class Words(dict):
    """Ids of words, as little-endian bytes, worked out when first asked for.

    Most words are letters and marks after them. The tokenizer takes such a word apart at that place and gives each
    part, in lower case, to its model; so does :meth:`plain`, without the tokenizer's work on whole texts. It is for
    letters whose class and case are beyond doubt; the tokenizer itself takes all other words.
    """

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.tokenizer, self.model, self.kind = tokenizer, tokenizer.model, kind
        self.parts: dict[str, bytes] = {}
        self.named = [np.array([i], kind).tobytes() for i in range(tokenizer.get_vocab_size())]
        self.is_known = [pre_tokenizer_text(tokenizer, x) for x in ("Ab", "é.")] == [["ab"], ["Ã©", "."]]

    def part(self, text: str) -> bytes:
        shown = text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(BYTE_NAMES)
        found = b"".join([self.named[t.id] for t in self.model.tokenize(shown)])
        if len(self.parts) >= REMEMBERED:
            self.parts.clear()
        self.parts[text] = found
        return found

    def plain(self, text: str) -> bytes | None:
        letters = text.lower()
        if "Σ" in text:  # the one letter whose lower case depends on its place
            return None
        core = letters.rstrip(MARKS)
        ids = self.parts.get(core)
        if ids is None:
            if not core.isalpha() or not (text.isascii() or (max(core) < SETTLED and is_normalized("NFC", text))):
                return None
            ids = self.part(core)
        if core == letters:
            return ids
        marks = letters[len(core) :]
        return ids + (self.parts.get(marks) or self.part(marks))

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        ids = self.plain(text) if self.is_known and len(word) <= LONG_WORD else None
        if ids is None:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def words_of(said: str, kind: str) -> Words:
    """The words of a tokenizer's file, one such memory a worker process: it outlives a task, and another tokenizer takes its place.

    Code that travels with a job has no module in the worker to keep things in, so one is made for it.
    """
    kept = sys.modules.setdefault(MEMORY, ModuleType(MEMORY)).__dict__
    name = (kind, len(said), hashlib.sha256(said.encode()).digest())
    if kept.get("name") != name:
        from tokenizers import Tokenizer

        kept.clear()
        kept.update(name=name, words=Words(Tokenizer.from_str(said), kind))
    return kept["words"]


def pre_tokenizer_text(tokenizer, text: str) -> list[str]:
    """The parts that a tokenizer hands to its model."""
    if tokenizer.normalizer is not None:
        text = tokenizer.normalizer.normalize_str(text)
    return [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer is not None else [text]


def wording(ids: np.ndarray) -> int:
    """The smallest hash of two neighbouring ids; texts with common wording often share it."""
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:] if len(ids) > 1 else ids.astype(np.uint64)
    mixed = (pairs ^ pairs >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return int((mixed ^ mixed >> np.uint64(29)).min() >> np.uint64(1))


def tokenized(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """``(doc_id, near, ids)``: each text's ids and the end id as little-endian bytes, and its min-hash.

    The tokenizer's file is read on the driver and sent along, so tasks need no copy of it.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        said = f.read()
    size = max(Tokenizer.from_str(said).get_vocab_size(), end + 1)
    kind = id_kind(size)
    sent = docs.sparkSession.sparkContext.broadcast(said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = words_of(sent.value, kind), np.array([end], kind).tobytes()
        for batch in batches:
            ids = [words.ids(text.as_py() or b"") + last for text in batch.column(1).cast(pa.binary())]
            near = [wording(np.frombuffer(x, kind)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "near", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, near long, ids binary")
    out.id_kind = kind
    return out


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Index:
    """BM25 over the documents of a shard, by token id."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75, probes: int = 32):
        bags = [np.unique(d, return_counts=True) for d in docs]
        self.n, self.probes = len(docs), probes
        self.starts = np.cumsum([0, *[len(t) for t, _ in bags]])
        terms = np.concatenate([t for t, _ in bags]).astype(np.int64)
        counts = np.concatenate([c for _, c in bags]).astype(np.float64)
        holder = np.repeat(np.arange(self.n), np.diff(self.starts))
        order = np.argsort(terms, kind="stable")
        self.terms, at, df = np.unique(terms[order], return_index=True, return_counts=True)
        self.posted = np.append(at, len(terms))
        length = np.array([len(d) for d in docs], np.float64)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        place = np.searchsorted(self.terms, terms)
        weight = idf[place] * counts * (k1 + 1) / (counts + k1 * (1 - b + b * length[holder] / length.mean()))
        self.place, self.weight = place, weight
        self.holders, self.posted_weight, self.df = holder[order], weight[order], df

    def scores(self, doc: int) -> np.ndarray:
        """A score of each document for the ``probes`` tokens of ``doc`` that weigh most in it and that others hold too."""
        mine = slice(self.starts[doc], self.starts[doc + 1])
        place, weight = self.place[mine], self.weight[mine]
        shared = np.flatnonzero(self.df[place] > 1)
        told = place[shared[np.argsort(-weight[shared], kind="stable")[: self.probes]]]
        if not len(told):
            return np.zeros(self.n)
        runs = [slice(self.posted[t], self.posted[t + 1]) for t in told]
        holders, weights = (np.concatenate([x[r] for r in runs]) for x in (self.holders, self.posted_weight))
        return np.bincount(holders, weights, self.n)

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a telling token with ``doc``, best first, equal ones by place."""
        scores = np.where(unused, self.scores(doc), 0.0)
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


class Packer:
    """Fills windows from one shard after another. Pieces are (doc_id, start, ids, tokens of the document, sequence, offset)."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.filled = window, first, 0
        self.open: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray, start: int) -> tuple[int, list[tuple]]:
        """As much of a document from ``start`` as fits; where it stops, and the pieces of the window if that is full."""
        taken = min(self.window - self.filled, len(ids) - start)
        self.open.append((doc_id, start, ids[start : start + taken], len(ids), self.sequence, self.filled))
        self.filled += taken
        done = []
        if self.filled == self.window:
            done, self.open, self.filled, self.sequence = self.open, [], 0, self.sequence + 1
        return start + taken, done

    def pack(self, doc_ids: list, docs: list[np.ndarray], **index) -> Iterator[tuple]:
        shared = Index(docs, **index) if len(docs) > 1 else None
        unused, ahead, neighbours = np.ones(len(docs), bool), iter(range(len(docs))), iter(())
        while True:
            doc = next(neighbours, None)
            seeded = doc is None
            if seeded:
                doc = next((d for d in ahead if unused[d]), None)
                if doc is None:
                    return
            unused[doc], at = False, 0
            while at < len(docs[doc]):
                at, done = self.put(doc_ids[doc], docs[doc], at)
                yield from done
                seeded = seeded or bool(done)  # the rest of a cut document seeds the next window
            if not self.filled:
                neighbours = iter(())
            elif seeded and shared is not None:
                neighbours = iter(shared.neighbours(doc, unused).tolist())

    def close(self) -> Iterator[tuple]:
        """The open window, cut into sequences whose lengths are powers of two, longest first."""
        left, room = self.filled, 0
        for doc_id, start, ids, tokens, _, _ in self.open:
            while len(ids):
                if not room:
                    room = size = 1 << left.bit_length() - 1
                    left -= size
                    self.sequence += 1
                part, ids = ids[:room], ids[room:]
                yield doc_id, start, part, tokens, self.sequence - 1, size - room
                start, room = start + len(part), room - len(part)
        self.open, self.filled = [], 0


PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END, shard_tokens: int = 1 << 21, **index) -> DataFrame:
    """``PIECE`` rows: where each run of ids (little-endian, 32 bits) of each document stands, and the ids. See the module's text."""
    made = tokenized(docs, tokenizer_path, end)
    kind, landed = made.id_kind, materialize(made, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 40)

        def shards() -> Iterator[tuple[list, list]]:
            doc_ids, arrays, held = [], [], 0
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.frombuffer(ids.as_buffer(), kind).copy()
                    if held and held + len(ids) > shard_tokens:
                        yield doc_ids, arrays
                        doc_ids, arrays, held = [], [], 0
                    doc_ids.append(doc_id)
                    arrays.append(ids)
                    held += len(ids)
            if held:
                yield doc_ids, arrays

        def pieces() -> Iterator[tuple]:
            for doc_ids, arrays in shards():
                yield from packer.pack(doc_ids, arrays, **index)
            yield from packer.close()

        out, held = [], 0
        for piece in pieces():
            out.append(piece)
            held += len(piece[2])
            if held >= shard_tokens:
                yield rows(out)
                out, held = [], 0
        if out:
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        doc_id, start, ids, tokens, sequence, offset = zip(*out, strict=True)
        numbers = [pa.array(x, pa.int64()) for x in (doc_id, start, [len(x) for x in ids], tokens, sequence, offset)]
        blobs = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
        return pa.RecordBatch.from_arrays([*numbers, blobs], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    spread = F.xxhash64("doc_id", "ids")
    dealt = landed.withColumn("spread", spread).repartitionByRange("near", "spread").sortWithinPartitions("near", "spread", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(run, PIECE)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the whole of ``documents`` in sequences of 4096 tokens, with checksums in place of ids."""
    placed = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
