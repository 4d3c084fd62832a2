"""A corpus pipeline of training-data operators: judge, join near copies, cut repeated passages, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sarvgrid.llm import mixing, packing, qda, substrings, triejoin
from sarvgrid.llm.queries import by_language
from sarvgrid.llm.store import settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null, empty and blank texts are judged as texts without words; texts of any length count whole; a score on the threshold stays;
    repeated rows stay or go together; an empty table gives none. Columns stay as they are, whatever their names.
    """
    return qda.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more.

    The smallest doc_id of a group stays, of rows that share it the first by text and then by the other columns; rows without a doc_id
    all stay. Null, empty and blank texts are no one's copies; texts count whole; an empty table gives none. Columns stay as they are.
    """
    return triejoin.one_of_each(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of twenty that starts earlier go; the documents stay.

    A null text stays null, one without repeats stays as it is to the last blank, of any length. Earlier is a smaller doc_id, a null one
    being the smallest; rows that share one are not earlier than each other. n_chars follows the text, other columns stay as they
    are; an empty table gives none.
    """
    return substrings.deduplicate(docs, rows=True)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the expected tokens of the languages meet tempered weights; none goes.

    Copies are alike in all columns, so doc_id is no key of what comes out. Null and empty texts have the priors of the languages and
    one token; texts count whole; repeated rows have equal rates; documents without a lang are no part of the model, and without
    any lang every document stays once. An empty table gives none. Columns stay as they are, whatever their names.
    """
    return mixing.mix(docs, by_language(docs))


def pattern_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    A null text counts as empty: its one token is the end. Longer texts than a sequence are cut, of any length. Repeated rows have
    pieces of their own each; ties between equal lengths go by doc_id, piece and checksum. An empty table gives none; other columns
    are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", pattern_packing),
]

#: SQL can't state the classifier, the mixing or the packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = settle(docs, name)
    return docs
