"""The row rules on streams, and first-seen keywords within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, keywords, sentences


def analyzed_keywords(stream: DataFrame) -> DataFrame:
    """Intent and topic of each keyword of a stream (text and other columns): no state."""
    return keywords.analyzed(stream)


def audited(stream: DataFrame, key: str = "id") -> DataFrame:
    """Typography findings of a stream (key, field, text): no state."""
    return audit.audit(stream, key)


def rejected_sentences(stream: DataFrame) -> DataFrame:
    """The sentences of a stream (text) with the rule that each breaks, if any: no state."""
    cut = stream.withColumn("sentence", F.explode(X.sentences(F.col("text"))))
    return cut.withColumn("reason", sentences.rejection(F.col("sentence")))


def first_seen(stream: DataFrame, time: str = "at", late: str = "1 hour") -> DataFrame:
    """The first row of each keyword fingerprint within a watermark; older state is dropped."""
    keyed = stream.withColumn("fingerprint", X.fingerprint(F.col("text")))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"])


def intent_counts(stream: DataFrame, time: str = "at", late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Keywords of each intent in windows of time."""
    return keywords.analyzed(stream).withWatermark(time, late).groupBy(F.window(time, window), "intent").agg(F.count("*").alias("n"))
