"""Quality classifier: regularised quadratic discriminant.

Method: each text becomes a vector of transformed statistics (logs and square
roots of counts and shares). From the labelled rows, each class gets a prior, a
mean and a covariance; the covariance is shrunk towards the pooled one and a
scaled identity. A text's score is the logistic of the difference of the two
classes' log densities, whose Mahalanobis terms use Cholesky factors that are
computed once at the fit.

Scale: statistics are computed in one pass over the texts and written as a
narrow table, so texts are read once. The fit needs, for each class, a count,
a vector of sums and a matrix of products: one aggregation with map-side
partial sums that uses every labelled row, and returns two rows. The model is
a few hundred numbers and travels in the closure.

Nulls and edge cases: a null or empty text has all counts zero and is scored
like any other; a null label teaches nothing; repeated rows are scored alike,
and teach once for each label row they join; with no labelled row of a class
the score is the share of label 1 among labelled rows, or 0.5; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import crc_of_id, id_and_text, materialize, row_key, ship, table

ship(__name__)

# Byte sets that the statistics count.
SYMBOLS = b"#*$%&|<>{}[]\\^~=_"
MARKS = b".,;:!?"
SPACE = b" \t\n\x0b\x0c\r"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"

FEATURES = (
    "log_words", "word_length", "symbols", "bars", "loud", "marks", "upper", "digits", "line_length", "distinct", "adjacent",
)


def statistics(text: str | None) -> tuple[float, ...]:
    """The transformed statistics of one text, in the order of :data:`FEATURES`."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data) - _count(data, SPACE))
    share = lambda chars: math.sqrt(_count(data, chars) / size)
    # Distinct words over blocks of 200: the share does not fall with the text's length.
    blocks = range(0, len(words), 200)
    distinct = sum(len(set(words[i : i + 200])) for i in blocks)
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    return (
        math.log1p(len(words)),
        math.log(size / n + 1),
        share(SYMBOLS),
        math.sqrt(data.count(b" | ") / n),
        math.sqrt(data.count(b"!!") / n),
        share(MARKS),
        share(UPPER),
        share(DIGITS),
        math.log1p(n / (data.count(b"\n") + 1)),
        distinct / n,
        math.sqrt(adjacent / n),
    )


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, key1, key2, f0, f1, ...)`` for each row of ``docs``."""
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            values = np.array(rows, float).reshape(len(rows), len(names))
            columns = [pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], names=["doc_id", "key1", "key2", *names])

    schema = "doc_id long, key1 long, key2 long, " + ", ".join(f"{n} double" for n in names)
    return id_and_text(docs).select("doc_id", "text", *row_key()).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log terms; :meth:`score` gives P(label 1)."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple
    whiten: tuple
    offset: tuple
    constant: float | None = None

    def score(self, values: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(values), self.constant)
        x = (values - self.centre) / self.scale
        log = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offset, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(labelled: DataFrame, label: str, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Fit on all rows of ``labelled``: ``f0, f1, ...`` and a 0/1 column.

    Each class covariance becomes (1 - shrink - ridge) of its own, ``shrink``
    of the pooled one and ``ridge`` of the identity, in units of the overall
    standard deviation.
    """
    k = len(FEATURES)
    names = [f"f{i}" for i in range(k)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(k) for j in range(i, k)]
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*"), *[F.sum(n) for n in names], *products).collect()
    got = {int(r[0]): np.array(r[1:], float) for r in rows}  # two rows at most
    total = sum(g[0] for g in got.values())
    if len(got) < 2 or min(g[0] for g in got.values()) < 2:
        return Discriminant(np.zeros(k), np.ones(k), (), (), (), got[1][0] / total if 1 in got else 0.0 if got else 0.5)

    def moments(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m, square = g[1 : k + 1] / g[0], np.zeros((k, k))
        square[np.triu_indices(k)] = g[k + 1 :] / g[0]
        square += np.triu(square, 1).T
        return g[0], m, square - np.outer(m, m)

    _, centre, cov = moments(got[0] + got[1])
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    parts = {c: moments(g) for c, g in got.items()}
    unit = np.outer(scale, scale)
    pooled = sum(n * c for n, _, c in parts.values()) / total / unit
    means, whiten, offset = [], [], []
    for c in (0, 1):
        n, m, own = parts[c]
        shrunk = (1 - shrink - ridge) * own / unit + shrink * pooled + ridge * np.eye(k)
        factor = np.linalg.cholesky(shrunk)
        means.append((m - centre) / scale)
        whiten.append(np.linalg.inv(factor))
        offset.append(math.log(n / total) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, tuple(means), tuple(whiten), tuple(offset))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``stats`` with a column ``score``."""
    @F.pandas_udf("double")
    def run(values: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(values.to_numpy(float)))

    return stats.withColumn("score", run(F.struct(*[F.col(f"f{i}") for i in range(len(FEATURES))])))


def held_out() -> Column:
    return crc_of_id() % 3 == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, key1, key2, held_out, score, predicted)`` for each row of ``docs``; rows held out never teach."""
    stats = materialize(with_statistics(docs), "statistics").withColumn("held_out", held_out())
    taught = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))
    labelled = stats.where(~F.col("held_out")).join(taught, F.col("doc_id") == F.col("_id"))
    out = scored(stats, fit(labelled, "_label"))
    return out.select("doc_id", "key1", "key2", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, scored again beside their text.

    The model is fitted from one pass; the verdict is a second, row-wise pass, so no join brings texts to scores.
    """
    stats = with_statistics(docs).withColumn("held_out", held_out())
    taught = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))
    model = fit(stats.where(~F.col("held_out")).join(taught, F.col("doc_id") == F.col("_id")), "_label")
    return docs.where(_good(model)(F.col("text")))


def _good(model: Discriminant):
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        values = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(values) >= 0.5)

    return run


def op7_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, over whole texts."""
    got = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", "predicted")
