"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

One pass over the texts gives a row of statistics for each document. Class means and covariances are sums over
all labelled training rows, made by the executors. A class covariance is shrunk towards the pooled one, then towards a
multiple of the identity; its Cholesky factor is inverted once and kept, and a score is the difference of the classes'
Gaussian log densities, by Mahalanobis distance, as a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fertility import repeated_words
from .store import discard, settle
from .words import Words, column_bytes, product, slices


def _bytes_in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": _bytes_in(bytes(range(65, 91))),
    "lower": _bytes_in(bytes(range(97, 123))),
    "digit": _bytes_in(b"0123456789"),
    "stop": _bytes_in(b".,;:?"),
    "shout": _bytes_in(b"!"),
    "symbol": _bytes_in(b"#*$%&|<>@^~_=+\\/{}[]"),
    "line": _bytes_in(b"\n"),
    "beyond": _bytes_in(bytes(range(128, 256))),
}
STATISTICS = ("log_words", "word_length", "word_spread", "upper", "digit", "stop", "shout", "symbol", "beyond", "line", "distinct", "entropy", "top_word", "neighbour", "repeat", "dup_lines", "marked_words")


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log odds of a share, each side half a count more, so that 0 of 0 is 0."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text. A null text has those of an empty one."""
    words = Words(column)
    n = words.lengths.astype(np.float64)
    texts = column_bytes(column)
    sizes = np.array([len(t) if t else 0 for t in texts])
    raw = np.frombuffer(b"".join(t for t in texts if t), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    by = {k: np.diff(np.concatenate([[0], np.cumsum(table[raw])])[bounds]) for k, table in CLASSES.items()}
    letters = by["upper"] + by["lower"]
    length = np.array([len(w) for w in words.vocabulary], np.float64)
    marked = np.array([bool(w) and not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in (b".", b",")) for w in words.vocabulary], np.float64)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, values[words.ids] if len(words.ids) else None, words.n) / np.maximum(n, 1)

    size = mean(np.log1p(length))
    pair, times = np.unique(words.doc * max(1, len(length)) + words.ids, return_counts=True)
    doc = pair // max(1, len(length))
    distinct = np.bincount(doc, minlength=words.n)
    top = np.zeros(words.n)
    np.maximum.at(top, doc, times)
    # summed from the rarest word on: words are numbered as a batch meets them, which must not show in a text's last bits
    times = times[np.lexsort((times, doc))]
    entropy = np.log(np.maximum(n, 1)) - np.bincount(doc, times * np.log(times), words.n) / np.maximum(n, 1)
    same = np.zeros(len(words.ids))
    same[1:] = (words.ids[1:] == words.ids[:-1]) & (words.doc[1:] == words.doc[:-1])
    lines = [[x for x in t.split(b"\n") if x.strip()] if t else [] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    out = {
        "log_words": np.log1p(n),
        "word_length": size,
        "word_spread": np.sqrt(np.maximum(0, mean(np.log1p(length) ** 2) - size**2)),
        "upper": _logit(by["upper"], letters),
        "distinct": _logit(distinct, n),
        "entropy": entropy,
        "top_word": _logit(top, n),
        "neighbour": _logit(np.bincount(words.doc, same, words.n), n),
        "repeat": _logit(repeated_words(words), n),
        "dup_lines": _logit(n_lines - np.array([len(set(x)) for x in lines]), n_lines),
        "marked_words": _logit(mean(marked) * n, n),
    }
    out |= {k: _logit(by[k], sizes) for k in ("digit", "stop", "shout", "symbol", "beyond", "line")}
    return np.column_stack([out[k] for k in STATISTICS])


@dataclass
class Model:
    """Per class (0, 1): log prior, mean, inverse of the Cholesky factor and log determinant of the covariance."""

    priors: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, the same for equal rows wherever they stand."""
        z, each = (x - self.centre) / self.scale, np.ones(x.shape[1])
        log = [self.priors[k] - 0.5 * self.log_dets[k] - 0.5 * product(product(z - self.means[k], self.factors[k].T) ** 2, each) for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def discriminant(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float = 0.7, to_identity: float = 0.02) -> Model:
    """The model of the classes' counts, sums and sums of outer products."""
    p = sums.shape[1]
    total = max(1.0, n.sum())
    centre = sums.sum(0) / total
    scale = np.sqrt(np.maximum(np.diag(squares.sum(0)) / total - centre**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    means, covariances = np.zeros((2, p)), np.zeros((2, p, p))
    for k in (0, 1):
        if n[k]:
            raw = sums[k] / n[k]
            means[k] = (raw - centre) / scale
            covariances[k] = (squares[k] / n[k] - np.outer(raw, raw)) / np.outer(scale, scale)
    pooled = (n[:, None, None] * covariances).sum(0) / total
    factors, dets = np.zeros((2, p, p)), np.zeros(2)
    for k in (0, 1):
        s = (1 - to_pooled) * covariances[k] + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / p, 1e-3) * np.eye(p)
        lower = np.linalg.cholesky(s)
        factors[k], dets[k] = np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum()
    return Model(np.log((n + 1) / (n.sum() + 2)), means, factors, dets, centre, scale)


SCHEMA = "doc_id long, x array<double>"


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document (doc_id, text; other columns are ignored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = statistics(part.column("text"))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def train(described: DataFrame, labels: DataFrame, **shrinkage: float) -> Model:
    """Learns from all of ``labels`` (doc_id, quality) that are 0 or 1 and match; a row for each label counts.

    The driver gathers sums: two classes times the square of the number of statistics, whatever the input.
    With one class or no labels, the model has equal densities and the priors decide.
    """
    rows = described.join(labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")), "doc_id").select("x", "quality")
    p = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x, y = matrix(batch.column("x")), batch.column("quality").to_numpy()
            for k in (0, 1):
                some = x[y == k]
                total[k] += np.concatenate([[len(some)], some.sum(0), (some.T @ some).ravel()])
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], names=["quality", "at", "v"])

    got = rows.mapInArrow(run, "quality int, at int, v double").groupBy("quality", "at").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((2, 1 + p + p * p))
    total[got["quality"], got["at"]] = got["v"]
    if not total[:, 0].all():
        total[:, 1:] = 0
    return discriminant(total[:, 0], total[:, 1 : 1 + p], total[:, 1 + p :].reshape(2, p, p), **shrinkage)


RESULT = "score double, predicted int"


def score(described: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) for each described document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return described.mapInArrow(run, f"doc_id long, {RESULT}")


def train_and_score(docs: DataFrame, labels: DataFrame, training: F.Column | None = None) -> DataFrame:
    """Statistics of all documents in one pass, a model of the labels for which ``training`` (a condition on
    doc_id) holds, and the scores: doc_id, score, predicted.

    A null, empty or blank text is scored by its statistics, which are those of no words. Repeated rows are scored
    one by one, to the same bits, and repeated labels count one by one; null labels and ids match nothing. Texts count whole, of any length. A score
    that equals the threshold is predicted 1. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    described, _ = settle(describe(docs), "statistics")
    return score(described, train(described, labels if training is None else labels.where(training)))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = 50_000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (score >= threshold), columns as they are.

    Learns from about ``most`` of ``labels`` (doc_id, quality), those of smallest hash of doc_id: they are few enough to be sent
    to the texts, so no text is shuffled. Null, empty and blank texts are judged by their statistics, those of no words; texts count
    whole, of any length. Repeated rows stay or go together, whatever their other columns, whose names may be any. A score that
    equals the threshold stays. Without labels of both classes the priors decide, and without any all rows stay; an empty table
    gives no rows.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "quality")
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = texts.join(F.broadcast(known.select("_id").distinct()), texts["doc_id"] == F.col("_id"), "left_semi")
    described, path = settle(describe(some), "statistics")
    model = train(described, known.withColumnRenamed("_id", "doc_id"))
    discard(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield part.filter(pa.array(model.score(statistics(part.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
