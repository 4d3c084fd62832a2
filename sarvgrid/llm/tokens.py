"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once.

The vocabulary drops white space and its pattern never joins characters across it, so a text's ids are
the ids of its words one after another; tests compare this with encoding the text in one piece.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa

from .words import NumberTable, Words

VOCABULARY = "word_bpe_49k.json"
#: Id that ends each document.
END_ID = 1
#: All but line feeds and the characters that NFC leaves alone and that lower-case one by one inside the same range (Latin-1 and Latin
#: Extended-A); and what may begin a special token.
_ODD = re.compile(r"[^\n!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]|<\|").finditer
#: The vocabulary's own pattern, its letter and number classes written out for that range (fixed values); and line feeds.
_CUTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\na-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+").findall
#: Byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip([*_SHOWN, *(b for b in range(256) if b not in set(_SHOWN))], map(chr, [*_SHOWN, *range(256, 324)]), strict=True))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n places on, one after another, as 32-bit numbers where those do."""
    stop = np.cumsum(n)
    kind = np.int32 if len(n) and stop[-1] < 1 << 30 and start.max() < 1 << 30 else np.int64
    at = np.repeat((start - (stop - n)).astype(kind), n)
    at += np.arange(len(at), dtype=kind)
    return at


def public_path(name: str) -> str:
    """Place of a vocabulary file on this machine; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Numbers of texts in the order they are met."""

    def __missing__(self, text: str) -> int:
        self[text] = number = len(self)
        return number


class Encoder:
    """Encodes texts with the tokenizers library, ``end`` appended to each."""

    def __init__(self, name: str = VOCABULARY, end: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(public_path(name)), end
        self.merges = Tokenizer(self.tokenizer.model)
        suffix, size = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab_size()
        #: Ids that end a cut, where the vocabulary marks them.
        self.last = np.array([bool(suffix) and str(self.tokenizer.id_to_token(k)).endswith(suffix) for k in range(size)])
        #: For each distinct word: where its ids begin among ``flat``, and how many they are.
        self.table = NumberTable(self._encode, 2, reset=self._forget)
        self._forget()

    def _forget(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        #: Cuts met so far, and the place of each as of words; the line feed is the first.
        self.cuts, self.places = _Numbers({"\n": 0}), [np.zeros((1, 2), np.int64)]

    def _keep(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places of texts whose ``n`` ids each follow one another in ``ids``."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), "<u4")])
        self.flat[self.used : self.used + len(ids)] = ids
        begin, self.used = self.used + np.cumsum(n) - n, self.used + len(ids)
        return np.column_stack([begin, n])

    def _run(self, tokenizer, texts: list[str]) -> np.ndarray:
        if tokenizer is self.merges:  # in one piece, if the ends of cuts can be told from their ids
            ids = np.array(tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(texts) and (not len(ends) or ends[-1] == len(ids)):
                return self._keep(ids, np.diff(ends, prepend=0))
        made = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, made), np.int64, len(made))
        return self._keep(np.fromiter(chain.from_iterable(made), "<u4", int(n.sum())), n)

    def _encode(self, words: list[bytes]) -> np.ndarray:
        """The place of each word's ids.

        Words of plain Latin characters are cut by the vocabulary's own pattern, and new cuts go to the library's merges;
        all others take the library's whole path."""
        out = np.zeros((len(words), 2), np.int64)
        lines = b"\n".join(words).decode("utf-8", "replace")
        odd = np.array([m.start() for m in _ODD(lines)], np.int64)
        if len(odd):
            ends = np.cumsum(np.fromiter(map(len, lines.split("\n")), np.int64, len(words)) + 1)
            odd = np.unique(np.searchsorted(ends, odd, "right"))
        if len(odd):
            texts = lines.split("\n")
            out[odd] = self._run(self.tokenizer, [texts[k] for k in odd.tolist()])
            plain = np.delete(np.arange(len(words)), odd)
            lines = "\n".join(map(texts.__getitem__, plain.tolist()))
        else:
            plain = np.arange(len(words))
        if not len(plain):
            return out
        if len(self.cuts) > 1_500_000:  # places of words stay good: only cuts are forgotten
            self.cuts, self.places = _Numbers({"\n": 0}), [np.zeros((1, 2), np.int64)]
        known = len(self.cuts)
        number = np.fromiter(map(self.cuts.__getitem__, _CUTS(lines.lower())), np.int64)
        if len(self.cuts) > known:
            new = list(islice(self.cuts, known, None))
            raw = [c if c.isascii() else "".join(map(_BYTE_CHARS.__getitem__, c.encode())) for c in new]
            self.places.append(self._run(self.merges, raw))
        place = np.concatenate(self.places)
        self.places = [place]
        breaks = np.flatnonzero(number == 0)
        first, last = np.append(0, breaks + 1), np.append(breaks, len(number))
        n = last - first
        out[plain[n == 1]] = place[number[first[n == 1]]]
        more = n > 1
        if more.any():
            cut = number[_ranges(first[more], n[more])]
            begin, size = place[cut].T
            ids = self.flat[_ranges(begin, size)]
            own = np.add.reduceat(size, np.cumsum(n[more]) - n[more])
            out[plain[more]] = self._keep(ids, own)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end ids included; bounds of each text in them). A null text counts as empty."""
        words = Words(texts)
        begin, size = self.table.of(words).T
        # the word sequence with one end mark behind each document; the end id stands behind all others
        flat = np.append(self.flat[: self.used], np.uint32(self.end))
        begin, size = np.append(begin, np.int32(self.used)), np.append(size, np.int32(1))
        marks = np.insert(words.ids, words.bounds[1:], len(words.vocabulary))
        n = size[marks]
        ends = np.cumsum(n)[marks == len(words.vocabulary)]
        return flat[_ranges(begin[marks], n)], np.concatenate([[0], ends])

    def lengths(self, words: Words) -> np.ndarray:
        """The number of ids of each text, end id included."""
        size = self.table.of(words)[:, 1]
        return (np.bincount(words.doc, size[words.ids], words.n) if len(words.ids) else np.zeros(words.n)).astype(np.int64) + 1


@lru_cache(maxsize=4)
def _kept(name: str, end: int) -> Encoder:
    return Encoder(name, end)


def encoder(name: str = VOCABULARY, end: int = END_ID) -> Encoder:
    """One encoder for each worker process, however it is asked for: a cache tells defaults from the same values given."""
    return _kept(name, end)
