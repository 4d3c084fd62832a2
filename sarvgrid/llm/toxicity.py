"""Toxicity by a lexicon that misspelled words meet too, and by what stands around them.

1. The lexicon is learned: words, and stems shared by several words, that documents labelled toxic hold far more often than
   others. 2. It is a trie; a Levenshtein automaton runs along it, its states made as they are met, so a word costs one
   step a character until no term is within reach. 3. Each hit gets a context score from the words around it: quotation
   marks and reporting words lower it, other hits and second persons raise it. 4. Sums over a document go through a
   logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, settle
from .words import NumberTable, Words, mix, product, slices

#: Characters cut from both ends of a word (fixed values).
EDGES = ".,;:!?\"'`()[]{}<>«»“”„‘’‚‹›…|*#%&$-–—_/\\=+~^"
#: Marks that open or close quoted speech, words that report it, and second persons (fixed values).
QUOTES = frozenset("\"«»“”„‘‹›")
REPORTING = frozenset("said says say saying called calls wrote writes quoted quote quotes cited cites claimed reported reports told tells dit dits écrit appelé cité sagte sagt schrieb nannte zitierte zitat dijo dice escribió llamó citó cita".split())
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
CONTEXT = 8
#: Length of a stem at least, and the different words that must share it; misspellings of one word are not different.
STEM, STEM_WORDS = 4, 4


def allowed(term: str, stem: bool) -> int:
    """Edits within which a word still is a term: none below 4 characters, two from 8 on. A stem is met as it stands."""
    return 0 if stem or len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """The Levenshtein automaton of all terms at once, over their trie.

    A state is a set of (trie node, edits); steps are remembered, so the automaton becomes deterministic where words lead.
    A stem's trie node leads to a sink, a node without children that any ending stays in, so stems take nothing from the
    words that begin with them. ``slack`` is added to the edits allowed for each word.
    """

    def __init__(self, words: list[str], stems: list[str], slack: int = 0):
        self.terms, self.n_words = [*words, *stems], len(words)
        self.limit = [allowed(t, k >= len(words)) + (slack if k < len(words) else 0) for k, t in enumerate(self.terms)]
        self.child: list[dict[str, int]] = [{}]
        self.term, self.reach, self.sink = [-1], [0], [-1]
        for k, term in enumerate(self.terms):
            at = 0
            self.reach[0] = max(self.reach[0], self.limit[k])
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = self._node()
                at = self.child[at][c]
                self.reach[at] = max(self.reach[at], self.limit[k])
            if k >= len(words):
                self.sink[at] = at = self._node()
            self.term[at] = k
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.best: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _node(self) -> int:
        self.child.append({})
        self.term.append(-1)
        self.reach.append(0)
        self.sink.append(-1)
        return len(self.child) - 1

    def _state(self, found: set[tuple[int, int]]) -> int:
        """Closes a set under leaving out characters of a term; keeps the least edits at each node. The empty one is -1."""
        todo, least = list(found), {}
        while todo:
            node, e = todo.pop()
            if e <= self.reach[node] and least.get(node, 99) > e:
                least[node] = e
                todo += [(c, e + 1) for c in self.child[node].values()]
                if self.sink[node] >= 0 and e == 0:
                    todo.append((self.sink[node], 0))
        if not least:
            return -1
        state = frozenset(least.items())
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            hits = [(e, self.term[n]) for n, e in state if self.term[n] >= 0 and e <= self.limit[self.term[n]]]
            # a stem is met only where no word is
            hits = [x for x in hits if x[1] < self.n_words] or hits
            self.best.append((min(hits)[1], min(hits)[0]) if hits else None)
        return self.number[state]

    def _step(self, state: int, char: str) -> int:
        found: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if self.term[node] >= self.n_words:
                found.add((node, 0))  # a sink: any ending
            found.add((node, e + 1))
            for c, to in self.child[node].items():
                found.add((to, e if c == char else e + 1))
        return self._state(found)

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the closest word within its limit, or else of a stem; ties go to the first term."""
        if len(self.states) > 100_000:
            self.number, self.states, self.steps, self.best = {}, [], [], []
            self.start = self._state({(0, 0)})
        state = self.start
        for c in word:
            steps = self.steps[state]
            to = steps.get(c)
            if to is None:
                to = steps[c] = self._step(state, c)
            if to < 0:
                return None
            state = to
        return self.best[state]


FEATURES = 8


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    #: Log odds of (term, edits), learned. A misspelling never seen has this part of its term's, by edits.
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    part: tuple[float, float, float] = (1.0, 0.6, 0.35)
    beta: np.ndarray = field(default_factory=lambda: np.concatenate([[-4.0], np.zeros(FEATURES)]))


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(EDGES)


def different(words: list[str], most: int) -> int:
    """How many of ``words`` (the commonest first) are no near-misspellings of an earlier one, up to ``most``.

    One edit more than the automaton allows: two misspellings of one word are further apart than each is from the word.
    """
    found: list[str] = []
    own = Automaton(found, [], 1)
    for w in words:
        if len(found) < most and own.find(w) is None:
            found.append(w)
            own = Automaton(found, [], 1)
    return len(found)


@dataclass
class Hits:
    """The hits of some documents, in the order of the text: document, term, edits and weight of each."""

    doc: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    value: np.ndarray


class Matcher:
    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.words, model.stems)
        self.table = NumberTable(self._kinds, 3, bits=20)
        n = len(self.automaton.terms)
        #: Weight of each (term, edits).
        self.weights = np.array([[self.weight(t, e) for e in range(4)] for t in range(n)]).reshape(n, 4)

    def _kinds(self, words: list[bytes]) -> np.ndarray:
        """(term or -1, edits, flags: 1 quotation mark, 2 reporting, 4 second person) of each word."""
        out = np.zeros((len(words), 3), np.int32)
        for k, w in enumerate(words):
            raw = w.decode("utf-8", "replace")
            p = raw.lower().strip(EDGES)
            hit = self.automaton.find(p) if p else None
            out[k] = (*(hit or (-1, 0)), (not QUOTES.isdisjoint(raw)) | 2 * (p in REPORTING) | 4 * (p in SECOND))
        return out

    def weight(self, term: int, edits: int) -> float:
        known = self.model.weights
        return known[term, edits] if (term, edits) in known else self.model.part[min(edits, 2)] * known.get((term, 0), 1.0)

    def features(self, words: Words) -> tuple[np.ndarray, Hits]:
        """A row for each document, and the hits."""
        term, edits, flags = self.table.of(words)[words.ids].T
        at, bounds = np.flatnonzero(term >= 0), words.bounds
        term, edits, doc = term[at], edits[at], words.doc[at]
        value = self.weights[term, edits] if len(at) else np.zeros(0)
        strong = value > 0.5
        quote, report, person = (np.concatenate([[0], np.cumsum((flags & bit) > 0)]) for bit in (1, 2, 4))
        before = np.concatenate([[0], np.cumsum(np.bincount(at, strong, len(flags)))])
        a, z = np.maximum(bounds[doc], at - CONTEXT), np.minimum(bounds[doc + 1], at + CONTEXT + 1)
        quoted = (quote[at + 1] > quote[a]) & (quote[z] > quote[at])
        reported, second = report[z] > report[a], person[z] > person[a]
        near = np.minimum(before[z] - before[a] - strong, 4)
        context = value * np.where(quoted, 0.25, 1.0) * np.where(reported, 0.6, 1.0) + (0.5 * near + 0.25 * second) * strong
        told, plus = quoted | reported, np.maximum(value, 0)
        rows = np.zeros((words.n, FEATURES))
        for k, x in ((0, plus * told), (1, plus * ~told), (4, edits > 0), (5, strong), (6, near)):
            rows[:, k] = np.bincount(doc, x, words.n)
        np.maximum.at(rows[:, 2], doc[~told], value[~told])
        np.maximum.at(rows[:, 3], doc, context)
        rows[:, 7] = rows[:, 5] / np.maximum(words.lengths, 1) * 100
        rows[:, [0, 1, 4, 5, 6, 7]] = np.log1p(rows[:, [0, 1, 4, 5, 6, 7]])
        return rows, Hits(doc, term, edits, value)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step
        if abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, most: int = 40_000, least_documents: int = 5, log_odds: float = 3.0) -> Model:
    """Learns from ``labels`` (doc_id, toxic: 0 or 1) that match ``docs``.

    Bounded: about ``most`` labels, those of smallest hash of doc_id, whose texts are read once and settled. Of their words, of any
    length, the driver gathers those that at least ``least_documents`` toxic documents hold, in as many contexts, and that pass
    ``log_odds``, then a row of eight numbers for each label. Without both classes, nothing is learned and every score is low.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    # labels are bounded by now: they go to the texts, and no text is shuffled
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "_id").select("text", "toxic")
    rows, rows_path = settle(rows, "toxic-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}
        sizes = [0, 0]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total, pa.string()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in range(2)), pa.array(np.array([v[2] for v in total.values()], np.uint64).view(np.int64))], names=["word", "clean", "toxic", "contexts"])

        for part in slices(batches, "text"):
            words, toxic = Words(part.column("text")), part.column("toxic").to_pylist()
            forms = [plain(w) for w in words.vocabulary]
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, forms), np.uint64, len(forms))
            near = own[words.ids] if len(forms) else own
            # a word's neighbours, as one of 64 bits: copies of a text show a word in one context, however many they are
            around = (mix(np.roll(near, 1) * np.uint64(3) + np.roll(near, -1)) & np.uint64(63)).tolist()
            for d, y in enumerate(toxic):
                sizes[y] += 1
                a, z = words.bounds[d], words.bounds[d + 1]
                ids = words.ids[a:z].tolist()
                for form in {forms[i] for i in ids}:
                    if form:
                        total.setdefault(form, [0, 0, 0])[y] += 1
                if y:
                    for i, bit in zip(ids, around[a:z], strict=True):
                        if forms[i]:
                            total[forms[i]][2] |= 1 << bit
            if len(total) > 300_000:
                yield out()
                total.clear()
        total[""] = [*sizes, 0]  # the number of documents
        yield out()

    counted = rows.mapInArrow(count, "word string, clean long, toxic long, contexts long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("contexts").alias("contexts"))
    counted, path = settle(counted, "toxic-words")
    total = counted.where("word = ''").first()
    if total is None or not total.clean or not total.toxic:
        discard(docs.sparkSession, path, rows_path)
        return Model()
    odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1)) - F.log((F.col("clean") + 0.5) / (total.clean + 1))
    # and not by chance: three standard errors above none
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    enough = (odds >= 3 * error) & (F.col("toxic") >= least_documents) & (F.bit_count("contexts") >= least_documents) & (odds >= log_odds)
    heads = _stems(counted.where("word <> ''"), enough & (F.col("toxic") >= 4 * least_documents) & (F.col("clean") <= 0.02 * F.col("toxic")), 4 * least_documents)
    words = sorted(r.word for r in counted.where(enough & (F.col("word") != "")).select("word").collect())
    model = Model(words, heads)
    got = rows.mapInArrow(_measure(model, "toxic"), "x array<double>, hits array<int>, toxic int").toPandas()
    y = got["toxic"].to_numpy(float)
    seen: dict[int, list[int]] = {}
    for hits, label in zip(got["hits"], y.astype(int), strict=True):
        for code in set(hits):
            seen.setdefault(code, [0, 0])[label] += 1
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    odds_of = {(c // 4, c % 4): (float(np.log((b + 0.1) / (n1 + 1)) - np.log((a + 0.1) / (n0 + 1))), a + b) for c, (a, b) in seen.items()}
    exact = {t: v * min(1.0, n / 5) for (t, e), (v, n) in odds_of.items() if e == 0}
    # few sightings of a misspelling count along with what its term lets expect
    model.weights = {(t, e): exact[t] if e == 0 else (v * n + 2 * model.part[min(e, 2)] * exact.get(t, 1.0)) / (n + 2) for (t, e), (v, n) in odds_of.items()}
    got = rows.mapInArrow(_measure(model, "toxic"), "x array<double>, hits array<int>, toxic int").toPandas()
    discard(docs.sparkSession, path, rows_path)
    model.beta = fit_logistic(np.array(got["x"].tolist()).reshape(-1, FEATURES), got["toxic"].to_numpy(float))
    return model


def _stems(counted: DataFrame, enough: F.Column, least: int) -> list[str]:
    """Beginnings, of any length from STEM, that pass ``enough`` as words do and that STEM_WORDS different words of toxic documents share."""

    def begun(table: DataFrame, lengths: F.Column) -> DataFrame:
        return table.withColumn("n", F.explode(lengths)).where(F.length("word") > F.col("n")).withColumn("head", F.expr("substring(word, 1, n)"))

    sums = [F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("contexts").alias("contexts"), F.count_if(F.col("toxic") > 0).alias("words")]
    toxic = counted.where((F.col("toxic") > 0) & (F.length("word") > STEM))
    some = begun(toxic, F.sequence(F.lit(STEM), F.length("word") - 1)).groupBy("head").agg(*sums).where((F.col("words") >= STEM_WORDS) & (F.col("toxic") >= least))
    lengths = sorted(r.n for r in some.select(F.length("head").alias("n")).distinct().collect())
    if not lengths:
        return []
    # words of clean documents count against a stem too; only lengths that may be a stem's are looked at
    found = begun(counted, F.array(*map(F.lit, lengths))).groupBy("head").agg(*sums)
    heads = [r.head for r in found.where(enough & (F.col("words") >= STEM_WORDS)).select("head").collect()]
    if not heads:
        return []

    def families(table: pa.Table) -> pa.Table:
        order = sorted(zip((-n for n in table.column("toxic").to_pylist()), table.column("word").to_pylist(), strict=True))
        return pa.table({"head": table.column("head").slice(0, 1), "words": pa.array([different([w for _, w in order], STEM_WORDS)], pa.int64())})

    under = begun(toxic, F.array(*map(F.lit, lengths))).where(F.col("head").isin(heads)).select("head", "word", "toxic")
    heads = sorted(r.head for r in under.groupBy("head").applyInArrow(families, "head string, words long").where(F.col("words") >= STEM_WORDS).collect())
    return [s for s in heads if not any(s != t and s.startswith(t) for t in heads)]


def _measure(model: Model, carry: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for part in slices(batches, "text"):
            x, hits = matcher.features(Words(part.column("text")))
            bounds = np.searchsorted(hits.doc, np.arange(len(x) + 1)).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(bounds), pa.array((4 * hits.term + hits.edits).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), codes, part.column(carry)], names=["x", "hits", carry])

    return run


RESULT = "score double, predicted int, n_hits long, terms array<string>"


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (score >= threshold), and of hits that speak for toxicity their number and the
    distinct terms (doc_id, text; other columns are ignored).

    A null, empty or blank text has no hits and the low score of such documents. Whole texts count, of any length. Repeated
    rows are scored one by one, to the same bits; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labels learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, beta = Matcher(sent.value), sent.value.beta
        terms = matcher.automaton.terms
        for part in slices(batches, "text"):
            x, hits = matcher.features(Words(part.column("text")))
            s = 1 / (1 + np.exp(-np.clip(beta[0] + product(x, beta[1:]), -30, 30)))
            strong = hits.value > 0.5
            found: list[set[str]] = [set() for _ in range(len(x))]
            for d, t in zip(hits.doc[strong].tolist(), hits.term[strong].tolist(), strict=True):
                found[d].add(terms[t])
            n = np.bincount(hits.doc[strong], minlength=len(x)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(n), pa.array([sorted(f) for f in found], pa.list_(pa.string()))], names=["doc_id", "score", "predicted", "n_hits", "terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {RESULT}")
