"""Language identification by unigram pieces, all segmentations of a word summed.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of the pieces' probabilities; a forward pass over the
word's characters adds them up. Training is expectation maximisation: the forward pass gives, for each place, how likely each
piece is to be the one that ends there, and a backward pass from the end of the word how likely each place is to be an end;
their products are the expected uses of each piece, which are summed over the training words of a language and normalised.
Both are shares, so no word is too long for the range of doubles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, parts, settle
from .tokens import public_path
from .words import NumberTable, Words, slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"  # where a word begins
MAX_PIECE = 16  # the longest piece of the vocabulary, mark included
#: Runs of up to so many characters take their passes together, by length; longer ones one by one.
TOGETHER = 24
#: Languages that a model may have: it goes to every worker, and this bounds it to 25 MB.
MOST_LANGUAGES = 256
_LETTERS = re.compile(r"[^\W\d_]+").findall


def runs(word: bytes) -> list[str]:
    """The lower-cased letter runs of a word, marked where they begin."""
    return [MARK + r for r in _LETTERS(word.decode("utf-8", "replace").lower())]


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY, longest: int = MAX_PIECE) -> dict[str, int]:
    """Pieces of letters, with or without the mark, of at most ``longest`` characters. Index 0 is any other character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_path(name))
    found = {sp.id_to_piece(i).lower() for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    keep = sorted(p for p in found if len(p) <= longest and (p.replace(MARK, "", 1) or MARK).replace(MARK, "").isalpha() or p == MARK)
    return {p: k + 1 for k, p in enumerate(keep)}


class PieceTable:
    """Piece numbers by a 64-bit polynomial hash of their characters, in an open-addressed table that arrays are looked up in."""

    def __init__(self, pieces: dict[str, int], bits: int = 18):
        self.miss = len(pieces) + 1
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids, self.probes = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.miss, np.int32), 1
        for key, number, slot in zip(keys, pieces.values(), self._slot(keys).tolist(), strict=True):
            n = 1
            while self.ids[slot] != self.miss:
                slot, n = (slot + 1) & self.mask, n + 1
            self.keys[slot], self.ids[slot], self.probes = key, number, max(self.probes, n)

    @staticmethod
    def _key(piece: str) -> int:
        key = 0
        for c in piece:
            key = (key * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ids[slot], self.miss)
        for _ in range(self.probes - 1):
            slot = (slot + 1) & self.mask
            out = np.where(self.keys[slot] == keys, self.ids[slot], out)
        return out


@lru_cache(maxsize=2)
def piece_table(name: str = VOCABULARY) -> PieceTable:
    return PieceTable(vocabulary(name))


def arcs_by_end(found: list[str], n: int, table: PieceTable) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each place in runs of ``n`` characters, the pieces that end there: (where they begin, which runs, which pieces). A
    character that is no piece by itself is the unknown piece."""
    chars = np.frombuffer("".join(found).encode("utf-32-le"), "<u4").reshape(-1, n).T.astype(np.uint64) + np.uint64(1)
    out: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        key = np.zeros(len(found), np.uint64)
        for j in range(i + 1, min(n, i + MAX_PIECE) + 1):
            key = key * np.uint64(0x9E3779B97F4A7C15) + chars[j - 1]
            p = table.find(key)
            if j == i + 1:
                p[p == table.miss] = 0
            hit = np.flatnonzero(p != table.miss)
            if len(hit):
                out[j].append((i, hit, p[hit]))
    return out


def by_length(found: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The runs of each length up to TOGETHER, and the longer ones."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return {n: np.flatnonzero(sizes == n) for n in np.unique(sizes).tolist() if n <= TOGETHER}, np.flatnonzero(sizes > TOGETHER)


def score_many(found: list[str], weights: np.ndarray, table: PieceTable, pieces: dict[str, int]) -> np.ndarray:
    """score_runs() of each run, as a row: runs of one length take each step of the forward pass together."""
    out = np.zeros((len(found), weights.shape[1]))
    groups, long = by_length(found)
    listed = weights.tolist() if len(long) else []
    for r in long.tolist():
        out[r] = score_runs([found[r]], pieces, listed, weights.shape[1])
    for n, rows in groups.items():
        alpha = np.zeros((n + 1, len(rows), weights.shape[1]))
        alpha[0] = 1.0
        for j, arcs in enumerate(arcs_by_end([found[r] for r in rows.tolist()], n, table)):
            for i, hit, p in arcs:
                alpha[j, hit] += alpha[i, hit] * weights[p]
        out[rows] = np.log(alpha[n])
    return out


def _arcs(run: str, j: int, get) -> list[tuple[int, int]]:
    """(where it begins, its number) of each piece that ends at ``j``."""
    out = [(i, p) for i in range(max(0, j - MAX_PIECE), j) if (p := get(run[i:j], -1)) >= 0]
    return out if out and out[-1][0] == j - 1 else [*out, (j - 1, 0)]


def score_runs(found: list[str], pieces: dict[str, int], weights: list[list[float]], languages: int) -> list[float]:
    """Log probability of some runs for each language. Only the sums of the last MAX_PIECE places are held, as shares of the latest, so
    no run is too long."""
    from math import log

    out = [0.0] * languages
    for run in found:
        back = [[1.0] for _ in range(languages)]
        for j in range(1, len(run) + 1):
            arcs = [(i - j, weights[p]) for i, p in _arcs(run, j, pieces.get)]
            for k, own in enumerate(back):
                total = 0.0
                for i, w in arcs:
                    total += own[i] * w[k]
                out[k] += log(total)
                back[k] = [x / total for x in own[-MAX_PIECE + 1 :]]
                back[k].append(1.0)
    return out


class Scorer:
    """Log probabilities of words for each language, with a last column of 1 for words that have a letter."""

    def __init__(self, weights: np.ndarray, name: str = VOCABULARY):
        self.weights, self.pieces, self.table = weights, vocabulary(name), piece_table(name)
        width = weights.shape[1] + 1
        self.known = NumberTable(self.score, width, bits=int(np.log2((64 << 20) / (16 + 8 * width))), dtype=np.float64)

    def of(self, words: Words) -> np.ndarray:
        return self.known.of(words)

    def score(self, words: list[bytes]) -> np.ndarray:
        cut = [runs(w) for w in words]
        number: dict[str, int] = {}
        flat = [number.setdefault(r, len(number)) for found in cut for r in found]
        own = np.column_stack([score_many(list(number), self.weights, self.table, self.pieces), np.ones(len(number))])
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        to = np.repeat(np.arange(len(cut)), n)
        out = np.column_stack([np.bincount(to, c, len(cut)) for c in own[flat].T]) if flat else np.zeros((len(cut), own.shape[1]))
        out[:, -1] = n > 0
        return out


def _forward(run: str, a: int, b: int, back: list[float], pieces: dict[str, int], weights: list[float]) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
    """For each place from ``a`` + 1 to ``b``, the pieces that end there with their shares; and how the sums of the last places compare
    with that of the latest."""
    ends = []
    for j in range(a + 1, b + 1):
        arcs = [(i, p, back[i - j] * weights[p]) for i, p in _arcs(run, j, pieces.get)]
        total = sum(x for _, _, x in arcs)
        ends.append([(i, p, x / total) for i, p, x in arcs])
        back = [x / total for x in back[-MAX_PIECE + 1 :]] + [1.0]
    return ends, back


def expected(run: str, pieces: dict[str, int], weights: list[float], step: int = 1 << 14) -> list[tuple[int, float]]:
    """Expected uses of each piece in a run under one language's weights, by a forward and a backward pass.

    The forward pass keeps its sums at every ``step`` places and is taken again between two of them, from the last to the first: memory
    does not grow with the run.
    """
    n, back, kept = len(run), [1.0], []
    for a in range(0, n, step):
        kept.append(back)
        if a + step < n:
            _, back = _forward(run, a, a + step, back, pieces, weights)
    reached, uses = {n: 1.0}, {}
    for a, back in zip(range(len(kept) - 1, -1, -1), reversed(kept), strict=True):
        a *= step
        ends, _ = _forward(run, a, min(n, a + step), back, pieces, weights)
        for j in range(min(n, a + step), a, -1):
            here = reached.pop(j, 0.0)
            for i, p, share in ends[j - a - 1]:
                reached[i] = reached.get(i, 0.0) + share * here
                uses[p] = uses.get(p, 0.0) + share * here
    return list(uses.items())


def expect_many(found: list[str], times: np.ndarray, lang: np.ndarray, weights: np.ndarray, table: PieceTable, pieces: dict[str, int]) -> np.ndarray:
    """Expected uses of all pieces in runs of languages that each occur so many times: expected() for all runs, in arrays."""
    uses = np.zeros(weights.size)
    k = weights.shape[1]
    groups, long = by_length(found)
    columns = {c: weights[:, c].tolist() for c in set(lang[long].tolist())}
    for r in long.tolist():
        for p, x in expected(found[r], pieces, columns[lang[r]]):
            uses[p * k + lang[r]] += x * times[r]
    for n, rows in groups.items():
        own, ends = lang[rows], arcs_by_end([found[r] for r in rows.tolist()], n, table)
        back, shares = np.zeros((n + 1, len(rows))), []
        back[0] = 1.0
        for j in range(1, n + 1):
            values = [back[i, hit] * weights[p, own[hit]] for i, hit, p in ends[j]]
            total = np.bincount(np.concatenate([hit for _, hit, _ in ends[j]]), np.concatenate(values), len(rows))
            shares.append([x / total[hit] for x, (_, hit, _) in zip(values, ends[j], strict=True)])
            back[max(0, j - MAX_PIECE) : j] /= total
            back[j] = 1.0
        reached, at, value = np.zeros((n + 1, len(rows))), [], []
        reached[n] = 1.0
        for j in range(n, 0, -1):
            for share, (i, hit, p) in zip(shares[j - 1], ends[j], strict=True):
                x = share * reached[j, hit]
                reached[i, hit] += x
                at.append(p.astype(np.int64) * k + own[hit])
                value.append(x * times[rows[hit]])
        uses += np.bincount(np.concatenate(at), np.concatenate(value), weights.size)
    return uses.reshape(weights.shape)


class Model:
    """Log priors and piece probabilities of each language."""

    def __init__(self, languages: list[str], weights: np.ndarray, name: str = VOCABULARY):
        self.languages, self.weights, self.name = languages, weights, name


def train(labelled: DataFrame, most: int = 8_000, rounds: int = 2, smooth: float = 0.1, name: str = VOCABULARY) -> Model:
    """Learns from ``labelled`` (doc_id, text, lang); rows without a text or a lang are left out.

    Bounded: about ``most`` documents of each language, those of smallest hash of doc_id, give the counts of
    words, of any length. Piece counts of a language (one row for each piece) are all that the driver gathers. Over MOST_LANGUAGES
    languages are an error.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: a model of so many would not be small enough to send")
    pieces = vocabulary(name)
    if not languages:
        return Model([], np.zeros((len(pieces) + 1, 0)), name)
    share = F.element_at(F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, most / sizes[k])))), F.col("lang"))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(total.values(), pa.int64())], names=["lang", "run", "n"])

        for part in slices(batches, "text"):
            words, langs = Words(part.column("text")), part.column("lang").to_pylist()
            cut = [runs(w) for w in words.vocabulary]
            for lang in set(langs):
                mine = np.isin(words.doc, [d for d, x in enumerate(langs) if x == lang])
                for word, n in zip(*np.unique(words.ids[mine], return_counts=True), strict=True):
                    for run in cut[word]:
                        total[lang, run] = total.get((lang, run), 0) + int(n)
            if len(total) > 200_000:
                yield out()
                total.clear()
        yield out()

    counted = rows.mapInArrow(count, "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    counted, path = settle(counted.repartition(parts(spark), "run"), "langid-words")
    index = {lang: k for k, lang in enumerate(languages)}
    weights = np.full((len(pieces) + 1, len(languages)), 1.0)
    for p, k in pieces.items():
        weights[k] = 8.0 ** (len(p) - 1)  # at the start, long pieces are not outweighed by their parts
    weights /= weights.sum(0)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            own, table, uses, held, chars = vocabulary(name), piece_table(name), np.zeros(now.shape), [], 0

            def add() -> np.ndarray:
                rows = pa.Table.from_batches(held)
                lang = np.array([index[x] for x in rows.column("lang").to_pylist()], np.int64)
                return expect_many(rows.column("run").to_pylist(), rows.column("n").to_numpy(), lang, now, table, own)

            for batch in batches:
                held.append(batch)
                chars += batch.column("run").nbytes
                if chars > 1 << 20:
                    uses += add()
                    held, chars = [], 0
            if held:
                uses += add()
            p, k = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(uses[p, k])], names=["piece", "lang", "n"])

        got = counted.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        uses = np.zeros(weights.shape)
        uses[got["piece"], got["lang"]] = got["n"]
        weights = (uses + smooth) / (uses + smooth).sum(0)
    discard(spark, path)
    return Model(languages, weights, name)


RESULT = "lang_pred string, score double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each document (doc_id, text; other columns are ignored).

    The score is the posterior probability of the predicted language under equal priors; ties go to the language that
    sorts first. A null text, or one without a letter, is ``und`` with score 0; so are all where nothing was learned.
    Whole texts count, of any length. Repeated rows are scored one by one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # bounded: pieces of a fixed vocabulary times languages
    sent = spark.sparkContext.broadcast((model.languages, model.weights.astype(np.float32), model.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, name = sent.value
        k, scorer = len(languages), Scorer(weights.astype(np.float64), name)
        for part in slices(batches, "text", 4 << 20):
            words = Words(part.column("text"))
            own = scorer.of(words)
            total = np.zeros((words.n, k + 1))
            for c in range(k + 1):
                total[:, c] = np.bincount(words.doc, own[:, c][words.ids] if len(words.ids) else None, words.n)
            known = (total[:, k] > 0) & (k > 0)
            logs = total[:, :k] - total[:, :k].max(1, keepdims=True) if k else total[:, :0]
            best = logs.argmax(1) if k else np.zeros(words.n, int)
            top = 1.0 / np.exp(logs).sum(1) if k else np.zeros(words.n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)], pa.string()), pa.array(np.where(known, top, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {RESULT}")
