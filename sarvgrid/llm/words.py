"""Words, shingles and windows of whole texts as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is exactly how ``bytes.split()``
divides UTF-8, so no text is decoded to be cut into words. Batches are cut by bytes of text, never by
text length: a document always stays whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

#: Bytes of text worked on at once in a Python worker.
BATCH_BYTES = 2 << 20
_LIBC = ctypes.CDLL(None)
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; nulls stay None."""
    return column.cast(pa.large_binary()).to_pylist()


def release() -> None:
    """Gives memory that is free again back to the system: a Python worker outlives its tasks, and its peak would stay."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``limit`` bytes of text and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.array(pa.compute.binary_length(batch.column(text)).fill_null(0)))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def _cut(column: pa.LargeStringArray) -> list[bytes]:
    """The bytes of each text of a column without nulls: to_pylist() takes five times as long."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


class Words:
    """The words of some texts: ``ids`` index ``vocabulary``; document d owns ids[bounds[d]:bounds[d + 1]]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        # taken anew: kernels read a cast slice, whose first offset isn't 0, in the wrong place (ascii_lower, Arrow 23)
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
        texts = pa.compute.fill_null(texts, "")
        if lower:
            texts = pa.compute.ascii_lower(texts)
        lists = pa.compute.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        ids, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        self.vocabulary = _cut(coded.dictionary)
        # white space at either end of a text leaves empty pieces there
        empty = np.flatnonzero(ids == self.vocabulary.index(b"")) if b"" in self.vocabulary else ids[:0]
        self.ids = np.delete(ids, empty)
        self.bounds = bounds - np.searchsorted(empty, bounds)
        self.n = len(texts)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n), self.lengths)

    @cached_property
    def digests(self) -> np.ndarray:
        """A row of 128 bits for each distinct word."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.vocabulary)), "<u8").reshape(-1, 2)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), dtype=np.uint64, count=len(self.vocabulary))
        return own[self.ids] if len(own) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values; the last width - 1 places hold no run.

    Order counts: each doubling step multiplies its left half, so it takes about log2(width) passes.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    power, have, out, got = mix(hashes + np.uint64(seed)), 1, None, 0
    rest = width
    while rest:
        if rest & 1:
            out = power if out is None else mix(out[: n] * _MUL[0] + _shift(power, got, n))
            got += have
        rest >>= 1
        if rest:
            power = mix(power * _MUL[1] + _shift(power, have, n) + _MUL[2])
            have *= 2
    return out[: n - width + 1]


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y``, summed column by column: in a matrix product, a row's last bits depend on where it stands among others."""
    out = np.zeros((len(x), *y.shape[1:]))
    for column, row in zip(x.T, y, strict=True):
        out += np.multiply.outer(column, row)
    return out


def _shift(x: np.ndarray, by: int, n: int) -> np.ndarray:
    return np.concatenate([x[by:], np.zeros(by, np.uint64)])[:n]


def windows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of each run of ``width`` words that lies inside one document."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][doc]
    return doc, start


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's set of distinct shingles: (values, bounds), values sorted inside a document.

    A document of 1 to width - 1 words has its whole word sequence as its one shingle; one without words has none.
    """
    hashes = words.hashes()
    doc, start = windows(words.bounds, width)
    values = rolling(hashes, width)[start] if len(start) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.lengths > 0) & (words.lengths < width))
    if len(short):
        extra = [xxhash.xxh3_64_intdigest(hashes[words.bounds[d] : words.bounds[d + 1]].tobytes(), seed=width) for d in short]
        doc, values = np.concatenate([doc, short]), np.concatenate([values, np.array(extra, np.uint64)])
    if len(short):
        order = np.argsort(doc, kind="stable")
        doc, values = doc[order], values[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=words.n))])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=words.n))]).astype(np.int64)


class WordTable:
    """Values computed once for each distinct word and kept for later batches, up to ``most`` words.

    ``make`` gets a list of new words and returns one value for each. At the limit the table starts afresh:
    memory stays bounded and results don't change.
    """

    def __init__(self, make: Callable[[list[bytes]], list], most: int = 350_000):
        self.make, self.most, self.known = make, most, {}

    def of(self, vocabulary: list[bytes]) -> list:
        if len(self.known) > self.most:
            self.known = {}
        found = list(map(self.known.get, vocabulary))
        missing = [k for k, v in enumerate(found) if v is None]
        if missing:
            new = [vocabulary[k] for k in missing]
            for k, word, value in zip(missing, new, self.make(new), strict=True):
                found[k] = value
                if len(word) <= 64:
                    self.known[word] = value
        return found


class NumberTable:
    """A row of ``width`` numbers for each distinct word, kept for later batches in an open-addressed table of arrays.

    Words are told apart by 128-bit hashes. ``make`` gets a list of new words and returns their rows. The table holds up to
    60 % of 2 ** ``bits`` words and then starts afresh, after ``reset``: memory stays bounded and results don't change. It
    takes some 30 bytes a word, a tenth of what a dict does, so that texts with many rare words find them again.
    """

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], width: int = 1, bits: int = 21, reset: Callable[[], None] = lambda: None, dtype: type = np.int32):
        self.make, self.width, self.size, self.reset, self.dtype = make, width, 1 << bits, reset, dtype
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values, self.held = np.zeros((self.size, 2), np.uint64), np.zeros((self.size, self.width), self.dtype), 0

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        """Where each digest stands, or the empty place where its search ended. A digest of zeros marks an empty place."""
        slot = (digests[:, 0] & np.uint64(self.size - 1)).astype(np.int64)
        todo = np.arange(len(slot))
        while len(todo):
            there = self.keys[slot[todo]]
            wrong = there.any(1) & (there != digests[todo]).any(1)
            todo = todo[wrong]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
        return slot

    def of(self, words: Words) -> np.ndarray:
        """A row for each of the words' vocabulary."""
        digests = words.digests | np.array([0, 1], np.uint64)
        slot = self._slots(digests)
        out, missing = self.values[slot], np.flatnonzero(~self.keys[slot].any(1))
        if not len(missing):
            return out
        if self.held + len(missing) > 0.6 * self.size:
            self.reset()
            self._clear()
            missing = np.arange(len(slot))
        out[missing] = self.make([words.vocabulary[k] for k in missing.tolist()] if len(missing) < len(slot) else words.vocabulary)
        todo = missing if len(missing) <= 0.6 * self.size else missing[:0]
        self.held += len(todo)
        while len(todo):  # of several that want a place, the last one written has it and the others look on
            place = self._slots(digests[todo])
            self.keys[place], self.values[place] = digests[todo], out[todo]
            todo = todo[(self.keys[place] != digests[todo]).any(1)]
        return out
