"""Quality rules: plain counts, and the fertility of public tokenisers.

How a public vocabulary cuts a text says how far the text is from what the vocabulary was made of. Each word is
encoded on its own; a document's figures are characters per token by each vocabulary, the share of byte-fallback pieces,
and the entropy of its tokens. Bands for the document's dominant script say which figures are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import public_path
from .words import Words, WordTable, column_bytes, rolling, slices, windows

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Scripts told apart, by the first word of a letter's Unicode name; all others are OTHER.
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARABIC", "HEBREW", "DEVANAGARI", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "THAI", "OTHER", "NONE")


@dataclass(frozen=True)
class Band:
    """Limits a document must keep within; a figure that a document is too short for is not judged."""

    chars_per_piece: tuple[float, float] = (0.3, 8.0)
    chars_per_byte_token: tuple[float, float] = (0.2, 8.0)
    byte_share: float = 0.9
    #: Least entropy of the pieces in bits, for documents of at least ``entropy_tokens`` pieces.
    entropy: float = 3.0
    entropy_tokens: int = 64


#: Each lies between clean text and words of uniformly random letters, at 20 words (fixed values). The figures of the two overlap
#: for ARABIC, HEBREW and KATAKANA and were not measured for OTHER: their fertility is not judged beyond the loose limits of Band.
BANDS = {
    "LATIN": Band((1.45, 8.0), (1.7, 8.0), 0.2, 4.0),
    "GREEK": Band(chars_per_byte_token=(1.17, 8.0)),
    "CYRILLIC": Band(chars_per_piece=(1.2, 8.0)),
    "DEVANAGARI": Band(chars_per_byte_token=(0.62, 8.0)),
    "HANGUL": Band(chars_per_piece=(0.43, 8.0), chars_per_byte_token=(0.6, 8.0)),
    "HIRAGANA": Band(byte_share=0.33),
    "CJK": Band(chars_per_piece=(0.4, 8.0), byte_share=0.7),
    "THAI": Band(chars_per_byte_token=(0.77, 8.0)),
    "NONE": Band((0.5, 8.0), (0.5, 8.0), 0.3),
}


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Words that a document needs for its fertility to be judged.
    judged_words: int = 20
    bands: dict[str, Band] = field(default_factory=lambda: dict(BANDS))
    other: Band = Band()


@lru_cache(maxsize=1 << 14)
def script(char: str) -> int:
    """Index in SCRIPTS of a letter; NONE for all else."""
    if not char.isalpha():
        return len(SCRIPTS) - 1
    name = unicodedata.name(char, "OTHER").split()[0]
    return SCRIPTS.index(name) if name in SCRIPTS else len(SCRIPTS) - 2


class Fertility:
    """Figures of each distinct word: piece ids, byte pieces, tokens of the byte-level vocabulary, characters, script."""

    def __init__(self, pieces: str = PIECES, byte_tokens: str = BYTES):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_path(pieces))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        with open(public_path(byte_tokens), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table = WordTable(self._measure)

    def _measure(self, words: list[bytes]) -> list[tuple]:
        texts = [w.decode("utf-8", "replace") for w in words]
        made = []
        for text, ids in zip(texts, self.pieces.encode(texts, num_threads=1), strict=True):
            n = len(self.tokens.encode_ordinary(" " + text))
            first = next((c for c in text if c.isalpha()), "")
            made.append((ids, n, len(text), script(first) if first else len(SCRIPTS) - 1))
        return made

    def of(self, words: Words) -> dict[str, np.ndarray]:
        """Figures of each document."""
        own = self.table.of(words.vocabulary)
        bounds = words.bounds

        def total(per_word: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(per_word[words.ids] if len(per_word) else [])])[bounds]).astype(np.int64)

        n_pieces = np.array([len(x[0]) for x in own], np.int64)
        flat = np.fromiter(chain.from_iterable(x[0] for x in own), np.int64, int(n_pieces.sum()))
        begin = np.cumsum(n_pieces) - n_pieces
        bytes_before = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        chars = np.array([x[2] for x in own], np.int64)
        kinds = np.array([x[3] for x in own], np.int64)
        # a distinct word of a document counts once, with its number: its pieces are then looked up once
        pair, times = np.unique(words.doc * max(1, len(own)) + words.ids, return_counts=True)
        doc, word = np.divmod(pair, max(1, len(own)))
        n = n_pieces[word]
        ids = flat[np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        key = np.repeat(doc, n) * len(self.is_byte) + ids
        order = np.argsort(key, kind="stable")
        key, weight = key[order], np.repeat(times, n)[order].astype(np.float64)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        count = np.add.reduceat(weight, edge) if len(edge) else weight
        of = key[edge] // len(self.is_byte) if len(edge) else key
        all_ = np.bincount(of, count, words.n)
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = np.where(all_ > 0, np.log2(all_) - np.bincount(of, count * np.log2(count), words.n) / all_, 0.0)
        by_script = np.zeros((words.n, len(SCRIPTS)))
        np.add.at(by_script, (doc, kinds[word]), chars[word] * times)
        by_script[:, -1] *= 1e-9  # NONE only where no word has a letter
        by_script[:, -1] += 1e-12
        return {"chars": total(chars), "pieces": total(n_pieces), "byte_pieces": total(bytes_before[begin + n_pieces] - bytes_before[begin]), "byte_tokens": total(np.array([x[1] for x in own], np.int64)), "entropy": entropy, "script": by_script.argmax(1)}


def repeated_words(words: Words, width: int = WINDOW) -> np.ndarray:
    """For each document, the words that lie in a ``width``-word window found twice or more in it."""
    doc, start = windows(words.bounds, width)
    covered = np.zeros(len(words.ids) + 1, np.int64)
    if len(start):
        own = rolling(words.hashes(), width)[start] + (doc.astype(np.uint64) << np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        a, b = order[:-1][same], order[1:][same]
        real = doc[a] == doc[b]
        for k in range(width):
            real &= words.ids[start[a] + k] == words.ids[start[b] + k]
        hit = np.unique(np.concatenate([a[real], b[real]]))
        for d in np.unique(doc[np.concatenate([a[~real], b[~real]])]).tolist():  # windows that share a hash only
            seen: dict[bytes, list[int]] = {}
            for w in np.flatnonzero(doc == d).tolist():
                seen.setdefault(words.ids[start[w] : start[w] + width].tobytes(), []).append(w)
            hit = np.union1d(hit, [w for ws in seen.values() if len(ws) > 1 for w in ws]).astype(np.int64)
        np.add.at(covered, start[hit], 1)
        np.add.at(covered, start[hit] + width, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return np.diff(np.concatenate([[0], np.cumsum(inside)])[words.bounds])


def base_counts(column: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """n_words, n_symbols, n_dup_lines and n_repeat_words of each text; a null text has none of them."""
    texts = column_bytes(column)
    lines = [[x for x in t.split(b"\n") if x.strip()] if t else [] for t in texts]
    drop = bytes(set(range(256)) - set(SYMBOLS))
    return {"n_words": words.lengths, "n_symbols": np.array([len(t.translate(None, drop)) if t else 0 for t in texts], np.int64), "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64), "n_repeat_words": repeated_words(words)}


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_piece double, chars_per_byte_token double, byte_share double, token_entropy double"


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Counts, fertility figures and verdict of each document (doc_id, text; other columns are ignored).

    A null, empty or blank text has no words: all counts are 0, the figures of its pieces are null, and it fails the base
    rules. Whole texts are measured, of any length. Repeated rows are judged one by one; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _fertility()
        names = ["doc_id", *(x.split()[0] for x in FIGURES.split(", "))]
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            base, f = base_counts(part.column("text"), words), own.of(words)
            n = base["n_words"]
            failed = (n < rules.min_words) | (100 * base["n_repeat_words"] > rules.max_repeat_percent * n)
            with np.errstate(divide="ignore", invalid="ignore"):
                per_piece, per_token, share = f["chars"] / f["pieces"], f["chars"] / f["byte_tokens"], f["byte_pieces"] / f["pieces"]
            kept = ~failed
            for k, name in enumerate(SCRIPTS):
                band, here = rules.bands.get(name, rules.other), (f["script"] == k) & (n >= rules.judged_words)
                bad = (per_piece < band.chars_per_piece[0]) | (per_piece > band.chars_per_piece[1]) | (per_token < band.chars_per_byte_token[0]) | (per_token > band.chars_per_byte_token[1])
                bad |= (share > band.byte_share) | ((f["entropy"] < band.entropy) & (f["pieces"] >= band.entropy_tokens))
                kept &= ~(here & bad)
            none = n == 0
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n, f["chars"], base["n_symbols"], base["n_dup_lines"], base["n_repeat_words"])), pa.array(failed), pa.array(kept), pa.array([SCRIPTS[k] for k in f["script"]]), *(pa.array(x, mask=none) for x in (per_piece, per_token, share, f["entropy"]))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {FIGURES}")


@lru_cache(maxsize=1)
def _fertility() -> Fertility:
    """One for each worker process."""
    return Fertility()
