"""Packing of documents into sequences: length patterns fitted by non-negative least squares.

1. Every document is tokenised and cut into pieces of at most ``capacity`` tokens.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the size of the corpus) goes to the driver.
3. Lengths are grouped into units; all patterns of up to ``parts`` documents that fill a sequence are
   enumerated; projected gradient fits nonnegative repeat counts to the histogram; counts are rounded down
   and each pattern is made of real lengths, its last place taking the longest length that still fits.
4. What is left is packed best fit, longest first, into the room of the patterns' sequences and into new ones,
   on counts of equal sequences: the work depends on the number of lengths, not of documents.
5. The plan says how many pieces of each length go to which run of sequences; a piece finds its place from
   its rank among the pieces of its length. Ranks come from counts of (length, salt), so no length is one task's.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import parts, settle
from .tokens import END_ID, VOCABULARY, encoder
from .words import slices

CAPACITY = 4096
#: Files of the table of counts, which has a row for each length and salt at most, however many partitions the session has.
COUNT_FILES = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END_ID) -> DataFrame:
    """The pieces of each document (doc_id, text; other columns are ignored): one, or more where it has over
    ``capacity`` tokens. A null text counts as empty: its only token is the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, end)
        for part in slices(batches, "text"):
            ids, bounds = own.encode(part.column("text"))
            n = np.diff(bounds)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            at = bounds[:-1][row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


@lru_cache(maxsize=4)
def patterns(units: int, parts: int) -> np.ndarray:
    """All ways to fill ``units`` with at most ``parts`` sizes, as counts of each size from 1 to units."""
    found: list[list[int]] = []

    def grow(rest: int, most: int, have: list[int]) -> None:
        if not rest:
            found.append(have)
        elif len(have) < parts:
            for size in range(min(rest, most), -(-rest // (parts - len(have))) - 1, -1):
                grow(rest - size, size, [*have, size])

    grow(units, units, [])
    out = np.zeros((len(found), units), np.float32)
    for i, sizes in enumerate(found):
        for s in sizes:
            out[i, s - 1] += 1
    return out


def fit_counts(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nonnegative x that makes the squares of (x @ shapes - histogram) least, by accelerated projected gradient."""
    scale = max(1.0, float(histogram.sum()))
    target = histogram / scale
    gram = shapes.T.astype(np.float64) @ shapes
    step = 1.0 / max(1e-9, float(np.linalg.eigvalsh(gram)[-1]))
    x = np.zeros(len(shapes))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (shapes @ (y @ shapes - target)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x * scale


class _Lengths:
    """Counts of lengths with the longest one that fits found in log time."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v}
        self.sorted = sorted(self.n)

    def fitting(self, room: int, above: int = 0) -> int | None:
        at = bisect_right(self.sorted, room) - 1
        return self.sorted[at] if at >= 0 and self.sorted[at] > above else None

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            self.sorted.pop(bisect_left(self.sorted, length))


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, units: int = 64, parts: int = 5) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences). Every length of the histogram is placed just as often as it occurs."""
    left = _Lengths(histogram)
    runs: list[tuple[tuple[int, ...], int]] = []
    if capacity in left.n:
        runs.append(((capacity,), left.n[capacity]))
        left.take(capacity, left.n[capacity])
    units = min(units, capacity)
    unit = -(-capacity // units)
    grouped = np.zeros(units)
    for length, n in left.n.items():
        grouped[-(-length // unit) - 1] += n
    if left.n:
        shapes = patterns(units, parts)
        counts = np.floor(fit_counts(shapes, grouped) + 1e-6).astype(np.int64)
        for i in np.argsort(-counts, kind="stable"):
            if counts[i] < 1:
                break
            sizes = np.repeat(np.arange(units, 0, -1), shapes[i][::-1].astype(int)).tolist()
            want = int(counts[i])
            while want > 0:
                chosen: list[int] = []
                use: dict[int, int] = {}
                room = capacity
                for k, size in enumerate(sizes):
                    last = k == len(sizes) - 1
                    low, high = (0, room) if last else ((size - 1) * unit, min(size * unit, room))
                    at = bisect_right(left.sorted, high) - 1
                    while at >= 0 and left.sorted[at] > low and left.n[left.sorted[at]] <= use.get(left.sorted[at], 0):
                        at -= 1
                    if at < 0 or left.sorted[at] <= low:
                        break
                    chosen.append(left.sorted[at])
                    use[chosen[-1]] = use.get(chosen[-1], 0) + 1
                    room -= chosen[-1]
                if len(chosen) < len(sizes):
                    break
                times = min(want, *(left.n[length] // n for length, n in use.items()))
                for length, n in use.items():
                    left.take(length, n * times)
                runs.append((tuple(chosen), times))
                want -= times
    return _best_fit(runs, left, capacity)


def _best_fit(runs: list[tuple[tuple[int, ...], int]], left: _Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Places what is left, longest first, where the least room remains. Equal sequences move together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for run in runs:
        open_.setdefault(capacity - sum(run[0]), []).append(run)
    rooms = sorted(open_)
    while left.sorted:
        length = left.sorted[-1]
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            lengths, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        else:
            room, lengths, n = capacity, (), -(-left.n[length] // (capacity // length))
        # each of n equal sequences takes as many of this length as fit, or one more round takes the rest
        each = min(room // length, max(1, left.n[length] // n))
        times = min(n, left.n[length] // each)
        left.take(length, each * times)
        for rest, m in (((*lengths, *[length] * each), times), (lengths, n - times if lengths else 0)):
            if m:
                new = capacity - sum(rest)
                if new not in open_:
                    open_[new] = []
                    insort(rooms, new)
                open_[new].append((rest, m))
    return [run for same in open_.values() for run in same]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, its places in rank order: (rank from which a run of places begins, first sequence, offset)."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            found.setdefault(length, []).append((n, base, offset))
            offset += length
        base += n
    out = {}
    for length, places in found.items():
        n, first, offset = map(np.array, zip(*places, strict=True))
        out[length] = (np.cumsum(n) - n, first.astype(np.int64), offset.astype(np.int64))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END_ID) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    Null texts count as empty and null or repeated doc_ids keep a row each; an empty table gives no rows;
    other columns are ignored. Ties between equal lengths are settled by (salt, doc_id, piece, ids_crc32).
    """
    spark = docs.sparkSession
    pieces, _ = settle(cut_pieces(docs, capacity, vocabulary, end), "pieces")
    n_salts = max(8, min(parts(spark), 1024))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_salts)).cast("int"))
    counts, _ = settle(salted.groupBy("length", "salt").agg(F.count("*").alias("n")).repartition(min(parts(spark), COUNT_FILES)), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = slots(plan_sequences(histogram, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                starts, first, at = places[int(length[rows[0]])]
                run = np.searchsorted(starts, rank[rows], "right") - 1
                sequence[rows], offset[rows] = first[run] + rank[rows] - starts[run], at[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
