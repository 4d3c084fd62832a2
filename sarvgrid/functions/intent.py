"""Lexical search intent: which marker phrases a keyword holds, what they say, and the topic that is left."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charclass import ARABIC_DIGITS, ASCII_DIGITS, CHARACTERS, INSUFFICIENT_CORE, INTENTS, MARKERS, PERSIAN_DIGITS, STOPWORDS, SUFFIXES, ZWJ, ZWNJ
from .text import bound, lookup

#: All codes that reason_codes() may give.
CODES = ("intent_unknown", *(f"intent_{c}" for c in INTENTS), "multiple_intent_categories", "informational_precedes_transactional")
FIRED = "array<struct<surface:string,intent:string,start:int,words:array<string>>>"


def analyze_marker(surface: str) -> tuple[str, ...]:
    """Tokens of a marker phrase. Phrases are plain words, so few of the rules apply to them."""
    text = unicodedata.normalize("NFC", surface).translate(str.maketrans(CHARACTERS | dict(zip(PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2, strict=True)) | {ZWNJ: None, ZWJ: None}))
    for suffix in SUFFIXES:
        text = re.sub(f"(?<=[؀-ۿ]) +{suffix}(?![\\w؀-ۿ])", suffix, text)
    return tuple(text.lower().split())


@lru_cache
def catalogue() -> dict[tuple[str, ...], tuple[str, str]]:
    """(surface, intent) of each token sequence, longest first. Phrases alike after analysis must agree on the intent."""
    rows = sorted(((analyze_marker(s), s, intent) for intent, surfaces in MARKERS.items() for s in surfaces), key=lambda r: (-len(r[0]), -len(r[1]), r[1]))
    found: dict[tuple[str, ...], tuple[str, str]] = {}
    for words, surface, intent in rows:
        if found.setdefault(words, (surface, intent))[1] != intent:
            raise ValueError(f"{surface} has two intents")
    return found


def markers(words: Column) -> Column:
    """Marker phrases in tokens from left to right, the longest at each place; a token belongs to one phrase at most."""
    return bound(words, _markers)


def _markers(words: Column) -> Column:
    known = catalogue()
    by_words = {" ".join(w): v for w, v in known.items()}
    surface, intent = {k: v[0] for k, v in by_words.items()}, {k: v[1] for k, v in by_words.items()}
    of_length = {n: [" ".join(w) for w in known if len(w) == n] for n in sorted({len(w) for w in known}, reverse=True)}

    def here(i: Column) -> Column:
        """The number of tokens of the longest phrase that starts at i."""
        return F.coalesce(*(F.when((i + n <= F.size(words)) & F.array_join(F.slice(words, i + 1, n), " ").isin(*phrases), F.lit(n)) for n, phrases in of_length.items()), F.lit(0))

    def step(state: Column, i: Column) -> Column:
        def fire(n: Column) -> Column:
            phrase = F.slice(words, i + 1, F.greatest(n, F.lit(1)))
            text = F.array_join(phrase, " ")
            fired = F.struct(lookup(surface, text).alias("surface"), lookup(intent, text).alias("intent"), i.cast("int").alias("start"), phrase.alias("words"))
            return F.struct(F.when(n > 0, i + n).otherwise(state["free"]).cast("int").alias("free"), F.when(n > 0, F.concat(state["fired"], F.array(fired))).otherwise(state["fired"]).cast(FIRED).alias("fired"))

        return bound(F.when(i >= state["free"], here(i)).otherwise(0), fire)

    start = F.struct(F.lit(0).alias("free"), F.array().cast(FIRED).alias("fired"))
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["fired"])


def categories(fired: Column) -> Column:
    """Intents of the fired markers in order of priority."""
    return F.filter(F.array(*map(F.lit, INTENTS)), lambda c: F.exists(fired, lambda m: m["intent"] == c))


def _first(fired: Column, intent: str) -> Column:
    return F.array_min(F.transform(F.filter(fired, lambda m: m["intent"] == intent), lambda m: m["start"]))


def _informational_first(fired: Column) -> Column:
    return F.coalesce(_first(fired, "informational") < _first(fired, "transactional"), F.lit(False))


def intent(fired: Column) -> Column:
    return bound(categories(fired), lambda found: F.when(F.size(found) == 0, "unknown").when((F.size(found) > 1) & _informational_first(fired), "informational").otherwise(F.try_element_at(found, F.lit(1))))


def reason_codes(fired: Column) -> Column:
    def codes(found: Column) -> Column:
        several = F.size(found) > 1
        more = F.array_compact(F.array(F.when(several, F.lit("multiple_intent_categories")), F.when(several & _informational_first(fired), F.lit("informational_precedes_transactional"))))
        return F.when(F.size(found) == 0, F.array(F.lit("intent_unknown"))).otherwise(F.concat(F.transform(found, lambda c: F.concat(F.lit("intent_"), c)), more))

    return bound(categories(fired), codes)


def competing(fired: Column) -> Column:
    found = categories(fired)
    return F.when(F.size(found) > 1, found).otherwise(F.array().cast("array<string>"))


def topic_core(content: Column, fired: Column) -> Column:
    """Content tokens without those of the markers, each marker token taking out its first equal. What is left stands, unless
    it is only words too weak to be a topic: then all content is the topic."""
    gone = F.filter(F.flatten(F.transform(fired, lambda m: m["words"])), lambda t: ~t.isin(*STOPWORDS))

    def drop(rest: Column, token: Column) -> Column:
        at = F.array_position(rest, token).cast("int")
        return F.when(at > 0, F.concat(F.slice(rest, F.lit(1), at - 1), F.slice(rest, at + 1, F.size(rest)))).otherwise(rest)

    return bound(F.aggregate(gone, content, drop), lambda left: F.when((F.size(left) > 0) & F.forall(left, lambda t: t.isin(*INSUFFICIENT_CORE)), content).otherwise(left))
