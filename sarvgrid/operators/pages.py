"""Pages that compete for one declared keyword, and what to do with each.

Input: page_id, url, title, h1, target_keyword, priority, page_role, word_count, inbound_internal_links.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.charclass import DIFFERENTIATE_TEXT, KEEP_TEXT, MERGE_TEXT, OVERRIDE_TEXT, RETARGET_TEXT, ROLES

SIGNIFICANT_WORDS = 500


class Competition(NamedTuple):
    clusters: DataFrame
    decisions: DataFrame
    skipped: DataFrame


def keys() -> list[tuple[str, Column]]:
    """What makes a page win, the strongest first, larger first."""
    score = X.targets(F.coalesce("title", F.lit("")), F.col("target_keyword")).cast("int") + X.targets(F.coalesce("h1", F.lit("")), F.col("target_keyword")).cast("int")
    return [("priority", F.coalesce("priority", F.lit(-(10**12)))), ("title_h1_match", score), ("page_role", X.lookup(ROLES, F.col("role"))), ("inbound_internal_links", F.col("inbound_internal_links")), ("word_count", F.col("word_count")), ("page_id_tiebreak", F.col("page_id"))]


def competition(pages: DataFrame, significant_words: int = SIGNIFICANT_WORDS) -> Competition:
    """Groups pages by the fingerprint of their keyword; groups of two or more get a winner, and every other page an action.

    Losing pages of another role are told apart; of those of the winner's role, long ones (``significant_words`` or more) get another
    keyword and short ones merge into the winner. Pages without a keyword are skipped. reason_fa explains each decision.
    """
    if significant_words < 0:
        raise ValueError("significant_words must not be negative")
    blank = X.squeeze(F.coalesce("target_keyword", F.lit(""))) == ""
    rows = pages.where(~blank).withColumn("fingerprint", X.fingerprint(F.col("target_keyword")))
    rows = rows.withColumn("role", X.role(F.coalesce("page_role", F.lit(""))))
    names = keys()
    rows = rows.withColumn("_all", F.struct(*(c.alias(n) for n, c in names)))
    group = Window.partitionBy("fingerprint")
    best, rest = group.orderBy(F.desc("_all")), F.struct(*(F.col(f"_all.{n}") for n, _ in names[1:]))
    rows = rows.withColumn("_size", F.count("*").over(group)).where("_size > 1")
    rows = rows.withColumn("rank", F.row_number().over(best)).withColumn("_next", F.lead("_all").over(best)).withColumn("_signal", F.max_by("page_id", rest).over(group))
    decided = F.lit("page_id_tiebreak")
    for n, _ in reversed(names[:-1]):
        decided = F.when(F.col(f"_all.{n}") != F.col(f"_next.{n}"), n).otherwise(decided)
    rows = rows.withColumn("_decided", F.when(F.col("rank") == 1, decided))
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = {n: F.first(c).over(whole) for n, c in (("winner_page_id", F.col("page_id")), ("_winner_role", F.col("role")), ("decided_by", F.col("_decided")))}
    rows = rows.withColumns(first)
    wins = F.col("rank") == 1
    action = F.when(wins, "keep").when(F.col("role") != F.col("_winner_role"), "differentiate").when(F.col("word_count") >= significant_words, "retarget").otherwise("consolidate_into")
    rows = rows.withColumn("action", action)
    long = F.col("action") == "retarget"
    codes = F.when(wins, F.array(F.concat(F.lit("winner_by_"), "decided_by"))).when(F.col("action") == "differentiate", F.array(F.lit("loser_differentiate"), F.lit("role_differs_from_winner"))).otherwise(F.array(F.concat(F.lit("loser_"), "action"), F.lit("significant_word_count_threshold"), F.when(long, f"word_count_gte_{significant_words}").otherwise(f"word_count_lt_{significant_words}")))
    codes = F.concat(codes, F.when(X.unknown_role(F.coalesce("page_role", F.lit(""))), F.array(F.lit("unknown_page_role"))).otherwise(F.array().cast("array<string>")))
    fields = {"decided_by": F.col("decided_by"), "role": F.col("role"), "winner_role": F.col("_winner_role"), "words": F.col("word_count"), "limit": F.lit(significant_words), "winner": F.col("winner_page_id")}
    said = F.when(wins, X.filled(KEEP_TEXT, **fields)).when(F.col("action") == "differentiate", X.filled(DIFFERENTIATE_TEXT, **fields)).when(long, X.filled(RETARGET_TEXT, **fields)).otherwise(X.filled(MERGE_TEXT, **fields))
    decisions = rows.select("fingerprint", "page_id", "url", "action", F.when(F.col("action") == "consolidate_into", F.col("winner_page_id")).alias("consolidate_target_id"), codes.alias("reason_codes"), "decided_by", "winner_page_id", said.alias("reason_fa"))
    overridden = (F.col("page_id") != F.col("_signal")) & F.col("priority").isNotNull()
    clusters = rows.where(wins).select("fingerprint", F.col("target_keyword").alias("keyword_sample"), "decided_by", "winner_page_id", F.col("_size").alias("n_pages"), F.when(overridden, F.array(F.lit("priority_override_conflicts_signals"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"), F.when(overridden, X.filled(OVERRIDE_TEXT, winner=F.col("winner_page_id"), signal=F.col("_signal"))).otherwise("").alias("reason_fa"))
    return Competition(clusters, decisions, pages.where(blank).select("page_id", F.lit("empty_target_keyword").alias("reason_code")))


def signals(pages: DataFrame) -> DataFrame:
    """Title, first heading, paragraphs, words and outgoing links of raw pages (page_id, url, html)."""
    def tag(name: str) -> Column:
        return X.squeeze(F.regexp_replace(F.regexp_extract("html", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"(?s)<[^>]+>", " "))

    paragraphs = X.paragraphs(F.col("html"))
    out = pages.select("page_id", "url", tag("title").alias("title"), tag("h1").alias("h1"), paragraphs.alias("paragraphs"), F.regexp_extract_all("html", F.lit(r"(?i)<a [^>]*href=\"([^\"]*)\""), F.lit(1)).alias("links"))
    return out.withColumn("word_count", F.aggregate(F.transform("paragraphs", X.word_count), F.lit(0), lambda a, b: a + b))
