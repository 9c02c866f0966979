"""Language ID by multilingual mixture inference.

Method: for each language of the training rows, counts of byte trigrams,
hashed to a fixed number of buckets, give a smoothed distribution. A document
is a mixture of languages: expectation-maximisation estimates the proportions
from its trigrams' likelihoods. Candidate sets are the leading 1, 2, 3 ...
languages of the full fit, each refitted; the set with the best penalised
log-likelihood (half a log of the sample size for each further language) wins.
The prediction is the language with the largest proportion in it.

Scale: training sums counts in the map tasks and shuffles a row for each
(language, bucket) and task. The model has at most ``max_languages`` times
``BUCKETS`` numbers, whatever the corpus, and that bound is checked before it
reaches the driver. Prediction is row-wise, without a shuffle.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with
score 0; so is every text if nothing was learned. A null language teaches
nothing, a null doc_id hashes as the empty text, repeated rows are predicted
alike; ties go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import crc_of_id, ship, table

ship(__name__)

BUCKETS = 1 << 15
#: ASCII characters other than letters count as spaces.
_PLAIN = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))


def trigrams(text: str) -> np.ndarray:
    """The buckets of the byte trigrams of a text, lower-cased, without those of spaces alone."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()) + b" ", np.uint8)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def count_trigrams(docs: DataFrame) -> DataFrame:
    """``(lang, bucket, n)`` summed over the rows of ``docs``, all of which have a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                found = trigrams(text.as_py() or "")
                if len(found):
                    sums[lang] += np.bincount(found, minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            if not len(at):
                at = np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counted = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram distributions of the learned languages."""

    def __init__(self, langs: list[str], log: np.ndarray):
        self.langs, self.log = langs, log

    @classmethod
    def of_counts(cls, langs: list[str], counts: np.ndarray, smooth: float = 0.5) -> Mixture:
        return cls(langs, np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BUCKETS)) if langs else counts)

    def infer(self, text: str | None, rounds: int = 12, least: float = 0.02) -> tuple[str, float, list[tuple[str, float]]]:
        """The language, its score, and the languages of the chosen set with their proportions."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, []
        found = np.bincount(trigrams(text), minlength=BUCKETS)
        at = np.flatnonzero(found)
        if not len(at):
            return "und", 0.0, []
        n, log = found[at].astype(float), self.log[:, at]
        top = log.max(axis=0)
        like, total = np.exp(log - top), n.sum()
        alone = log @ n
        size = max(2.0, total / 3)  # three trigrams share each letter

        def fit(chosen: np.ndarray, share: np.ndarray, times: int) -> tuple[np.ndarray, float]:
            part = like[chosen]
            for _ in range(times):
                share = share * (part @ (n / (share @ part))) / total
            return share, float(n @ np.log(share @ part)) + float(n @ top)

        share, _ = fit(np.arange(len(self.langs)), np.full(len(self.langs), 1 / len(self.langs)), rounds)
        order = np.argsort(-share, kind="stable")
        best = int(np.argmax(alone))
        chosen, proportions, value = np.array([best]), np.ones(1), alone[best] / 3
        for k in range(2, int((share >= least).sum()) + 1):
            some = order[:k]
            fitted, log_like = fit(some, share[some] / share[some].sum(), rounds)
            worth = log_like / 3 - 0.5 * (k - 1) * math.log(size)
            if worth > value:
                chosen, proportions, value = some, fitted, worth
        ranked = sorted(zip(-proportions, (self.langs[i] for i in chosen), strict=True))
        lang = ranked[0][1]
        shift = alone / 3 - alone.max() / 3
        posterior = float(np.exp(shift[self.langs.index(lang)]) / np.exp(shift).sum())
        certain = posterior if len(chosen) == 1 else 1.0
        return lang, min(1.0, -float(ranked[0][0]) * certain), [(x, -float(p)) for p, x in ranked]


def train(docs: DataFrame, max_languages: int = 256) -> Mixture:
    """Learn from the text and language of every row of ``docs`` that has a language."""
    known = docs.where("lang is not null")
    langs = sorted(r[0] for r in known.groupBy(F.col("lang").cast("string").alias("lang")).count().limit(max_languages + 1).collect())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages if the model may be larger")
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    rows = count_trigrams(known).toPandas()
    if len(rows):
        counts[rows["lang"].map(place).to_numpy(), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return Mixture.of_counts(langs, counts)


def predict(docs: DataFrame, model: Mixture) -> DataFrame:
    """``(doc_id, lang_pred, score, n_langs, mixture)`` for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log))  # at most max_languages * BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(*shared.value)
        for batch in batches:
            got = [mixture.infer(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                    pa.array([len(g[2]) for g in got], pa.int32()),
                    pa.array([",".join(f"{x}:{p:.4f}" for x, p in g[2]) for g in got], pa.string()),
                ],
                names=["doc_id", "lang_pred", "score", "n_langs", "mixture"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int, mixture string")


def held_out(doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % 4 == 2


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, over whole texts."""
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, train(docs.where(~held_out())))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_langs", "mixture")
