"""Keyword validation, clusters by topic and intent, and topic hubs.

Input: ordinal, keyword_id, text, search_demand, search_demand_status. Every step is a DataFrame; rows that fail a rule are
told apart, never lost.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as X
from ..functions.charclass import INTENTS, SKIP_TEXTS, STATUSES


def analyzed(keywords: DataFrame) -> DataFrame:
    """Adds the analysed text, its content tokens, the fired markers, intent, and topic core: each computed once."""
    out = keywords.withColumn("analyzed", X.analyze(F.coalesce("text", F.lit(""))))
    out = out.withColumn("content_tokens", X.content(F.col("analyzed"))).withColumn("intent_markers", I.markers(X.tokens(F.col("analyzed"))))
    fired = F.col("intent_markers")
    return out.withColumns({"intent": I.intent(fired), "intent_reason_codes": I.reason_codes(fired), "competing_intent_categories": I.competing(fired), "topic_core_tokens": I.topic_core(F.col("content_tokens"), fired)})


def validated(keywords: DataFrame) -> DataFrame:
    """Adds reason_code: the first rule that a row breaks, or null. The first row of an id, by ordinal, is the one that stays."""
    out = analyzed(keywords).withColumn("_id", X.squeeze(F.coalesce("keyword_id", F.lit(""))))
    # blank ids share no one's place: they are dealt out by ordinal
    same = Window.partitionBy("_id", F.when(F.col("_id") == "", F.col("ordinal"))).orderBy("ordinal")
    out = out.withColumn("_nth", F.row_number().over(same))
    status, demand = F.coalesce("search_demand_status", F.lit("")), F.col("search_demand")
    reason = (
        F.when(F.col("_id") == "", "empty_keyword_id")
        .when(F.col("_nth") > 1, "duplicate_keyword_id")
        .when(X.squeeze(F.coalesce("text", F.lit(""))) == "", "empty_keyword_text")
        .when(~status.isin(*STATUSES), "invalid_demand_status")
        .when((status == "unknown") & demand.isNotNull(), "demand_status_conflict")
        .when((status != "unknown") & demand.isNull(), "missing_search_demand")
        .when(demand < 0, "negative_search_demand")
        .when(F.size("content_tokens") == 0, "no_content_tokens")
        .when(F.size("topic_core_tokens") == 0, "only_intent_markers")
    )
    shown = F.when(F.col("_id") == "", F.col("keyword_id")).otherwise(F.col("_id"))
    return out.withColumn("reason_code", reason).withColumn("keyword_id", shown).drop("_id", "_nth")


def records(keywords: DataFrame, ordered: bool = False) -> DataFrame:
    """Valid rows with their fingerprints and cluster_id."""
    good = validated(keywords).where("reason_code IS NULL").drop("reason_code")
    core = X.fingerprint(F.array_join("topic_core_tokens", " "), ordered)
    good = good.withColumns({"fingerprint": X.fingerprint_of(F.col("content_tokens"), ordered), "topic_core_fingerprint": core})
    return good.withColumn("cluster_id", F.concat("topic_core_fingerprint", F.lit(":"), "intent"))


def head_keys() -> list[tuple[str, Column]]:
    """What makes a member the head of its cluster, the strongest first: known demand, more of it, fewer tokens, shorter, smaller id."""
    status = F.col("search_demand_status")
    return [
        ("search_demand_status", -X.lookup(STATUSES, status)),
        ("search_demand", F.when(status == "unknown", F.lit(10**18)).otherwise(-F.col("search_demand"))),
        ("shorter_content_tokens", F.size("content_tokens")),
        ("shorter_normalized_surface", F.length("analyzed")),
        ("keyword_id_tiebreak", F.col("keyword_id")),
    ]


def ranked(keywords: DataFrame, ordered: bool = False) -> DataFrame:
    """records() with head_rank in their cluster and, at the head, head_decided_by: the first key that tells it from the second."""
    rows = records(keywords, ordered)
    # hashed by topic alone: hubs group by it again without another shuffle
    own = Window.partitionBy("topic_core_fingerprint", "intent")
    keys = head_keys()
    rows = rows.withColumn("_keys", F.struct(*(c.alias(n) for n, c in keys)))
    rows = rows.withColumn("head_rank", F.row_number().over(own.orderBy("_keys"))).withColumn("_next", F.lead("_keys").over(own.orderBy("_keys")))
    decided = F.when(F.col("_next").isNull(), "singleton")
    for name, _ in keys[:-1]:
        decided = decided.when(F.col(f"_keys.{name}") != F.col(f"_next.{name}"), name)
    return rows.withColumn("head_decided_by", F.when(F.col("head_rank") == 1, decided.otherwise(keys[-1][0]))).drop("_keys", "_next")


MEMBER = ("keyword_id", "text", "fingerprint", "topic_core_tokens", "intent_markers", "intent_reason_codes", "competing_intent_categories", "search_demand", "search_demand_status")


class Clusters(NamedTuple):
    clusters: DataFrame
    skipped: DataFrame


def cluster(keywords: DataFrame, ordered: bool = False, member: tuple[str, ...] = MEMBER) -> Clusters:
    """One row for each (topic core, intent): its head, members (head first, then by id; fields ``member``, keyword_id the first), their
    number, label and reason codes; and the skipped rows.

    Only members hold a row's fields for each keyword: what doesn't ask for them needs no memory that grows with a cluster.
    """
    after, codes = (F.col("head_rank") != 1).alias("after"), F.col("intent_reason_codes")
    members = F.sort_array(F.collect_list(F.struct(after, *member)))
    head = F.first(F.when(F.col("head_rank") == 1, F.struct("keyword_id", "text", F.array_join("topic_core_tokens", " ").alias("label"))), ignorenulls=True)
    # codes in order of where they first stand in those of the members
    stands = [F.min(F.when(F.array_contains(codes, c), F.struct(after, "keyword_id", F.array_position(codes, c).alias("at"), F.lit(c).alias("code")))) for c in I.CODES]
    stands = F.transform(F.sort_array(F.array_compact(F.array(*stands))), lambda x: x["code"])
    rows = ranked(keywords, ordered).groupBy("topic_core_fingerprint", "intent").agg(members.alias("members"), F.count("*").alias("n_members"), head.alias("head"), stands.alias("codes"), F.max("head_decided_by").alias("head_decided_by"))
    found = rows.select(
        F.concat("topic_core_fingerprint", F.lit(":"), "intent").alias("cluster_id"), "topic_core_fingerprint", "intent",
        F.col("head.keyword_id").alias("head_keyword_id"), F.col("head.text").alias("head_text"), "members", "head_decided_by",
        F.concat("codes", F.when(F.col("n_members") == 1, F.array(F.lit("singleton_cluster"))).otherwise(F.array().cast("array<string>"))).alias("reason_codes"), "n_members", F.col("head.label").alias("head_label"),
    )
    said = F.replace(X.lookup(SKIP_TEXTS, F.col("reason_code")), F.lit("{status}"), F.coalesce("search_demand_status", F.lit("")))
    return Clusters(found, validated(keywords).where("reason_code IS NOT NULL").select("keyword_id", "text", "reason_code", said.alias("reason_fa")))


def hubs(clusters: DataFrame) -> DataFrame:
    """Clusters of one topic core: label, number of keywords and of intents."""
    rank = X.lookup({n: k for k, n in enumerate((*INTENTS, "unknown"))}, F.col("intent"))
    return clusters.groupBy("topic_core_fingerprint").agg(F.min_by("head_label", F.struct(rank, "cluster_id")).alias("label"), F.sum("n_members").alias("keyword_count"), F.count_distinct("intent").alias("intent_count"), F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "cluster_id"))).alias("clusters"))
