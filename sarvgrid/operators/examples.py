"""Examples made from sentences, their tokens replaced or minted anew, their sources put right."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.charclass import BLOCKED_DOMAINS, KIND_OF_DOMAIN
from . import labels, sentences

# Fixed values.
WIKI_SOURCE = "fa.wikipedia.org"
RAW_TOKENIZER, MODEL_TOKENIZER = "whitespace_raw", "dadmatools"
MADE_NOTE = "cleaned body sentence; unlabeled"


def installed_version(package: str) -> str:
    """The version of an installed package on the driver, or unknown."""
    from importlib.metadata import PackageNotFoundError, version

    try:
        return version(package)
    except PackageNotFoundError:
        return "unknown"


def make(rows: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """Unlabelled examples of the sentences (text) that break no rule and have ``least`` to ``most`` tokens, all found in the text.
    Other columns stay."""
    # what a row is kept for stands behind once(), so that no test works it out again
    good = X.once(rows.where(sentences.rejection(F.col("text")).isNull()).withColumn("tokens", X.raw_tokens(F.col("text"))))
    good = X.once(good.where(F.size("tokens").between(least, most)).withColumn("char_spans", labels.spans(F.col("text"), F.col("tokens")))).where("char_spans IS NOT NULL")
    return good.withColumns({"ezafe": F.lit(None).cast("array<int>"), "verified": F.lit(False), "strata": sentences.strata(F.col("text")), "note": F.lit(MADE_NOTE), "tokenizer_source": F.lit(RAW_TOKENIZER)})


def _spans(rows: DataFrame, tokens: Column) -> DataFrame:
    """``rows`` with ``tokens`` and their spans; tokens that the text doesn't hold are an error."""
    found = labels.spans(F.col("text"), tokens)
    sure = F.when(found.isNull(), F.raise_error(F.concat(F.lit("tokens not found in the text of "), F.col("id"))).cast(found_type())).otherwise(found)
    return rows.withColumns({"tokens": tokens, "char_spans": sure})


def found_type() -> str:
    return f"array<{labels.SPAN}>"


def replace_tokens(rows: DataFrame, tokens: Column) -> DataFrame:
    """Other token boundaries, and their spans; all other columns, labels too, stay as they are."""
    return _spans(rows, tokens)


def with_source(rows: DataFrame, source: Column, kind: Column) -> DataFrame:
    return rows.withColumns({"source": source, "source_kind": kind})


def mint(rows: DataFrame, tokens: Column, version: str, at: Column | None = None) -> DataFrame:
    """A model's tokens with their spans, where they come from and when; labels never come from a model."""
    return _spans(rows, tokens).withColumns({"tokenizer_source": F.lit(MODEL_TOKENIZER), "dadmatools_version": F.lit(version), "tokens_minted_at": X.now_utc() if at is None else at})


def remint(rows: DataFrame, tokens: Column, version: str, at: Column | None = None) -> DataFrame:
    """mint(), with sources named by their host and kinds by the source; what was labelled isn't any more."""
    host = X.domain(F.col("source_url"))
    host = F.when(host != "", host).otherwise(F.col("source"))
    source = F.when(host.contains("wikipedia"), WIKI_SOURCE).otherwise(host)
    of_host = X.lookup({d: k for k, ds in KIND_OF_DOMAIN.items() for d in ds}, source, F.col("source_kind"))
    kind = X.source_kind(source, of_host, F.col("source_url"))
    kind = F.when(kind.isNull(), F.raise_error(F.concat(F.lit("source_kind can't be resolved for "), F.col("id"))).cast("string")).otherwise(kind)
    out = mint(with_source(rows, source, kind), tokens, version, at)
    return out.withColumns({"ezafe": F.lit(None).cast("array<int>"), "verified": F.lit(False), "labeled_by": F.lit(""), "labeled_at": F.lit("")})


class Migrated(NamedTuple):
    rows: DataFrame
    counts: DataFrame


def migrate(rows: DataFrame) -> Migrated:
    """Sources named by their host; rows whose URL has none, or a blocked one, go. counts: stage (before, after, dropped), domain, n, of
    other sources than Wikipedia."""
    wiki = X.is_wikipedia(F.col("source"), F.col("source_kind"), F.col("source_url"))
    host = X.domain(F.col("source_url"))
    told = rows.withColumns({"_wiki": wiki, "_host": host, "_stays": wiki | ((host != "") & ~host.isin(*BLOCKED_DOMAINS))})
    name = F.when(F.col("_host") != "", F.col("_host")).when(F.col("source") != "", F.col("source")).otherwise("?")
    stages = F.array_compact(F.array(F.when(~F.col("_wiki"), F.lit("before")), F.when(F.col("_stays") & ~F.col("_wiki"), F.lit("after")), F.when(~F.col("_stays"), F.lit("dropped"))))
    counts = told.select(F.explode(stages).alias("stage"), name.alias("domain")).groupBy("stage", "domain").agg(F.count("*").alias("n"))
    kind = X.source_kind(F.col("source"), F.col("source_kind"), F.col("source_url"))
    kept = with_source(told.where("_stays"), F.when(F.col("_wiki"), WIKI_SOURCE).otherwise(F.col("_host")), F.when(F.col("_wiki"), "wiki").otherwise(kind))
    return Migrated(kept.drop("_wiki", "_host", "_stays"), counts)


def unused_ids(rows: DataFrame, taken: DataFrame, key: str = "id", fallback: str = "other_id") -> DataFrame:
    """``key`` becomes ``fallback`` where ``taken`` has it already; the fallback column goes."""
    known = taken.select(F.col(key).alias("_taken")).where("_taken IS NOT NULL").distinct()
    found = rows.join(known, F.col(key) == F.col("_taken"), "left")
    return found.withColumn(key, F.when(F.col("_taken").isNotNull(), F.col(fallback)).otherwise(F.col(key))).select(*(c for c in rows.columns if c != fallback))


def predicted(tokens: Column, marks: Column) -> Column:
    """0/1 for each token from a model's marks; other tokens than the model's, or as many, are an error."""
    names = F.transform(marks, lambda m: m["token"])
    differ = F.when(F.size(tokens) != F.size(marks), "token alignment failed: ").when(tokens != names, "token text mismatch: ")
    said = F.concat(differ, F.array_join(tokens, " "), F.lit(" | "), F.array_join(names, " "))
    return F.when(F.coalesce(differ.isNotNull(), F.lit(False)), F.raise_error(said).cast("array<int>")).otherwise(F.transform(marks, lambda m: m["has_ezafe"].cast("int")))
