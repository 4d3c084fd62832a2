"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives each document posterior probabilities of the domains. Rates, how often a
document is to be used, are the nonnegative least-squares fit of expected domain token totals to their targets:
minimise sum_d ((sum_i r_i t_i p_id) - b_d)^2 / b_d over r >= 0 (over r >= 1 where no document is to go), starting from r = 1. Projected gradient steps are taken in the
metric of the documents' token counts, where a step at document i is p_i . g with g the scaled residuals: so a rate is a function
of p_i and of the short list of residuals so far, each step gathers one number a domain, and no rate is ever stored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, settle, unused
from .tokens import VOCABULARY, encoder
from .words import NumberTable, Words, slices

#: Hash buckets of words, and how far posteriors are sharpened: log likelihood a word times this.
BUCKETS, SHARPNESS = 1 << 14, 12.0
#: Domains that a model may have: it goes to every worker, and this bounds it to 32 MB.
MOST_DOMAINS = 256


@dataclass
class Classifier:
    """Multinomial model of hashed words: log probability of each bucket in each domain, and log priors."""

    domains: list[str]
    priors: np.ndarray
    weights: np.ndarray

    def posteriors(self, words: Words) -> np.ndarray:
        """A row for each text; one without words has the priors."""
        rows = self.weights[buckets().of(words)[:, 0]]
        total = np.column_stack([np.bincount(words.doc, c[words.ids] if len(words.ids) else None, words.n) for c in rows.T]) if self.domains else np.zeros((words.n, 0))
        log = self.priors + SHARPNESS * total / np.maximum(words.lengths, 1)[:, None]
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def buckets() -> NumberTable:
    """The bucket of each word, in one table for each worker process."""
    return NumberTable(lambda new: np.fromiter((xxhash.xxh3_64_intdigest(w.lower().strip(b".,;:!?*#%&$|\"'()")) % BUCKETS for w in new), np.int64, len(new))[:, None])


def train(labelled: DataFrame, most: int = 5_000, smooth: float = 0.5) -> Classifier:
    """Learns from ``labelled`` (doc_id, text, domain); rows without a domain are left out.

    Bounded: about ``most`` documents of each domain, those of smallest hash of doc_id. The driver gathers BUCKETS counts a
    domain. Priors are the domains' shares of all labelled rows. Over MOST_DOMAINS domains are an error.
    """
    rows = labelled.where(F.col("domain").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("domain").cast("string").alias("domain"))
    sizes = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).limit(MOST_DOMAINS + 1).collect()}
    domains = sorted(sizes)
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains: a model of so many would not be small enough to send")
    if not domains:
        return Classifier(["all"], np.zeros(1), np.zeros((BUCKETS, 1)))
    share = F.element_at(F.create_map(*(F.lit(x) for k in domains for x in (k, min(1.0, most / sizes[k])))), F.col("domain"))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 20)) < share * (1 << 20))
    index = {k: i for i, k in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(domains), BUCKETS), np.int64)
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            if len(words.ids):
                at = np.array([index[x] for x in part.column("domain").to_pylist()])[words.doc] * BUCKETS + buckets().of(words)[words.ids, 0]
                total += np.bincount(at, minlength=total.size).reshape(total.shape)
        d, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[d, b])], names=["domain", "bucket", "n"])

    got = rows.mapInArrow(count, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((len(domains), BUCKETS), smooth)
    total[got["domain"], got["bucket"]] += got["n"]
    n = np.array([sizes[k] for k in domains], float)
    return Classifier(domains, np.log(n / n.sum()), np.log(total / total.sum(1, keepdims=True)).T)


@dataclass
class Fit:
    """The steps of the projected gradient: (momentum, step, scaled residuals), and how near the targets they came.

    ``met``: all domains are within the asked share of their targets. Where they can't be met at rates of ``least`` or more, the rates
    are those of the last step, which come as near as they can.
    """

    domains: list[str]
    steps: list[tuple[float, float, np.ndarray]]
    targets: np.ndarray
    reached: np.ndarray
    least: float = 0.0
    met: bool = True

    def last_two(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after the last step and the one before."""
        now = last = np.ones(len(p))
        for momentum, step, g in self.steps:
            y = now + momentum * (now - last)
            last, now = now, np.maximum(self.least, y - step * (p @ g))
        return now, last

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.last_two(p)[0]

    def ahead(self, p: np.ndarray, momentum: float) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and the point that the next step starts from."""
        now, last = self.last_two(p)
        return now, now + momentum * (now - last)


MEMBERS = "doc_id long, n_tokens long, p array<double>"


def memberships(docs: DataFrame, model: Classifier, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens (end id included) and posteriors of each document (doc_id, text; other columns are ignored)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_DOMAINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model = encoder(vocabulary), sent.value
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            p = model.posteriors(words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.lengths(words)), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, MEMBERS)


def fit(members: DataFrame, domains: list[str], targets: dict[str, float] | None = None, temper: float = 0.7, grow: bool = True, rounds: int = 60, close: float = 1e-4) -> Fit:
    """Projected gradient with momentum over ``members``.

    ``targets`` are weights of the domains; by default the expected shares to the power ``temper``. Their total is that of the
    corpus, or with ``grow`` the least at which no domain has to shrink; then no document goes either: rates are 1 or more. Each
    round is one aggregation of a number a domain; it ends when all domains are within ``close`` of their targets, or when rounds
    no longer change the totals. If they still did at the last round, a warning says so.
    """
    k, least = len(domains), float(grow)

    def gather(state: Fit, momentum: float) -> np.ndarray:
        """Expected token totals at the rates and at the next starting point, and the sum of t p p'."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2 + k, k))
            for batch in batches:
                p, t = np.array(batch.column("p").flatten()).reshape(-1, k), batch.column("n_tokens").to_numpy().astype(float)
                now, ahead = state.ahead(p, momentum)
                total[0] += (t * now) @ p
                total[1] += (t * ahead) @ p
                total[2:] += (t[:, None] * p).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "v"])

        got = members.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((2 + k) * k)
        for r in got:
            total[r["at"]] = r["v"]
        return total.reshape(2 + k, k)

    state = Fit(domains, [], np.ones(k), np.ones(k), least)
    first = gather(state, 0.0)
    have = np.maximum(first[0], 1e-9)
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in domains]) if targets else (have / have.sum()) ** temper
    if not weights.sum():
        raise ValueError("no target weight is positive")
    weights = weights / weights.sum()
    size = have.sum()
    if grow:
        # and a little more, so that stopping ``close`` to the targets leaves no rate just below 1
        size *= max(1.0, float(max(h / size / w for h, w in zip(have, weights, strict=True) if w))) * (1 + 10 * close)
    goal = weights * size
    scale = np.maximum(goal, 1e-3 * goal.max())
    step = 1.0 / max(1e-12, float(np.linalg.eigvalsh(first[2:] / np.sqrt(np.outer(scale, scale)))[-1]))
    t, momentum, now, ahead = 1.0, 0.0, first[0], first[1]
    far, still = np.inf, False
    for _ in range(rounds):
        far = float((abs(now - goal) / scale).max())
        if far <= close or still:
            break
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        # this step starts from the point whose totals are `ahead`
        state, before = Fit(domains, [*state.steps, (momentum, step, (ahead - goal) / scale)], goal, now, least), now
        momentum, t = (t - 1) / t2, t2
        now, ahead = gather(state, momentum)[:2]
        still = bool((abs(now - before) <= 0.01 * close * scale).all())
    else:
        far = float((abs(now - goal) / scale).max())
        if far > close:
            warnings.warn(f"mixing: after {rounds} rounds a domain is still {far:.2g} of its target away from it", stacklevel=2)
    return Fit(domains, state.steps, goal, now, least, far <= close)


RESULT = "doc_id long, n_tokens long, domain string, posterior double, rate double"


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior, rate and copies of each document (doc_id, text).

    copies is the rate rounded down or up by a fixed hash of doc_id, so that its mean is the rate. A null or empty text has the
    priors of the domains and one token, the end id; texts of any length count whole. Repeated rows have equal rates; null doc_ids
    hash alike. Posteriors that tie go to the domain that sorts first. Without labelled rows there is one domain and every
    rate is 1. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = train(labelled)
    members, _ = settle(memberships(docs, model), "members")  # the result reads it again
    found = fit(members, model.domains, targets, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column("p").flatten()).reshape(-1, len(found.domains))
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array([found.domains[b] for b in best], pa.string()), pa.array(p.max(1) if len(p) else np.zeros(0)), pa.array(found.rates(p))], names=["doc_id", "n_tokens", "domain", "posterior", "rate"])

    return members.mapInArrow(run, RESULT).withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def copies(rate: F.Column, doc_id: F.Column) -> F.Column:
    even = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + even).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) as often as their copies say, all columns as they are, of whatever names.

    By default rates are 1 or more, so every row stays; with ``grow=False`` those of 0 copies go. Copies of a row are alike in all
    columns. Nulls, empty and long texts, ties, repeated rows and empty tables are as in rates(). The last pass works the
    rates out from the text again, which is cheaper than a shuffle of all texts.
    """
    model = train(labelled)
    members, path = settle(memberships(docs, model), "members")
    found = fit(members, model.domains, targets, **options)
    discard(docs.sparkSession, path)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_DOMAINS
    rate, times, copy = (unused(docs, n) for n in ("rate", "copies", "copy"))
    schema = docs.withColumn(rate, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.rates(model.posteriors(Words(part.column("text")))))], names=[*part.schema.names, rate])

    rated = docs.mapInArrow(run, schema).withColumn(times, copies(F.col(rate), F.col("doc_id").cast("long")))
    return rated.where(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(rate, times, copy)
