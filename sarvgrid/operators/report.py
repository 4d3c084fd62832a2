"""Reports: the hub page, written from a stream of rows, and one-row JSON reports of the corpus steps."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.charclass import INTENTS
from .keywords import cluster, hubs, validated
from .labels import MAX_UNALIGNED, alignment_rates, alignment_samples
from .sentences import filtered, template_report

NONE = "—"


def summary(keywords: DataFrame) -> DataFrame:
    """One row: inputs, clusters, hubs, mean_intents (two decimals, — without hubs), skipped, and the clusters by intent as a map."""
    rows, valid = validated(keywords), F.col("reason_code").isNull()
    told = rows.select(F.when(valid, X.fingerprint(F.array_join("topic_core_tokens", " "))).alias("hub"), F.when(valid, F.col("intent")).alias("intent"))
    # one pass: clusters are counted, then hubs, where the skipped rows share the hub that is null; a hub's intents have a column each
    names = sorted((*INTENTS, "unknown"))
    of_hubs = told.groupBy("hub", "intent").agg(F.count("*").alias("n")).groupBy("hub").agg(F.sum("n").alias("n"), *(F.count_if(F.col("intent") == c).alias(c) for c in names))
    hub, own = F.col("hub").isNotNull(), F.col(names[0])
    for c in names[1:]:
        own = own + F.col(c)
    zero = F.lit(0).cast("long")
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.coalesce(F.sum(c), zero).alias("value")) for c in names)), lambda e: e["value"] > 0)
    mean = F.coalesce(F.format_string("%.2f", F.avg(F.when(hub, own))), F.lit(NONE))
    n_hubs = F.count_if(hub)
    return of_hubs.agg(
        F.coalesce(F.sum("n"), zero).alias("inputs"), F.coalesce(F.sum(F.when(hub, own)), zero).alias("clusters"), F.map_from_entries(entries).alias("intents"),
        n_hubs.alias("hubs"), F.when(n_hubs > 0, mean).otherwise(NONE).alias("mean_intents"), F.coalesce(F.sum(F.when(~hub, F.col("n"))), zero).alias("skipped"),
    )


def _cells(*values: Column) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), X.escape_html(v), F.lit("</td>")) for v in values), F.lit("</tr>"))


def pieces(keywords: DataFrame) -> DataFrame:
    """The sections of the page in order (place, html): a row for each cluster, the first of a hub with its heading, and each skipped row.
    All values are escaped."""
    found, skipped = cluster(keywords)
    top = hubs(found).select("topic_core_fingerprint", "label", "keyword_count", "intent_count", F.element_at("clusters", 1)["cluster_id"].alias("first"))
    rank = X.lookup({n: k for k, n in enumerate((*INTENTS, "unknown"))}, F.col("intent"))
    rows = top.join(found, "topic_core_fingerprint")
    e = X.escape_html

    def member(m: Column) -> Column:
        fired = F.array_join(F.transform(m["intent_markers"], lambda x: F.concat(x["surface"], F.lit(" ("), x["intent"], F.lit(", @"), x["start"].cast("string"), F.lit(")"))), ", ")
        core = F.array_join(m["topic_core_tokens"], " ")
        shown = [F.when(c == "", NONE).otherwise(c) for c in (core, fired)]
        return _cells(m["keyword_id"], m["text"], *shown, m["search_demand_status"], F.coalesce(m["search_demand"].cast("string"), F.lit(NONE)))

    head = F.when(F.col("cluster_id") == F.col("first"), F.concat(F.lit("<h2>"), e(F.col("label")), F.lit("</h2><p>"), F.col("topic_core_fingerprint"), F.lit(": "), F.col("keyword_count").cast("string"), F.lit(" / "), F.col("intent_count").cast("string"), F.lit("</p>"))).otherwise("")
    codes = F.array_join("reason_codes", ", ")
    table = F.concat(F.lit("<table>"), F.array_join(F.transform("members", member), ""), F.lit("</table>"))
    body = F.concat(head, F.lit('<section class="cluster"><h3>'), e(F.col("cluster_id")), F.lit("</h3><p>"), e(F.concat_ws(" | ", "intent", "head_keyword_id", "head_text", "head_decided_by", F.when(codes == "", NONE).otherwise(codes))), F.lit("</p>"), table, F.lit("</section>"))
    of_clusters = rows.select(F.struct(F.lit(0).alias("part"), (-F.col("keyword_count")).alias("n"), F.col("label").alias("a"), F.col("topic_core_fingerprint").alias("b"), rank.cast("int").alias("rank"), F.col("cluster_id").alias("c")).alias("place"), body.alias("html"))
    row = _cells(*(F.coalesce(c, F.lit("")) for c in ("keyword_id", "text", "reason_code", "reason_fa")))
    of_skipped = skipped.select(F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), F.coalesce("keyword_id", F.lit("")).alias("a"), F.col("reason_code").alias("b"), F.lit(0).alias("rank"), F.coalesce("text", F.lit("")).alias("c")).alias("place"), row.alias("html"))
    return of_clusters.unionByName(of_skipped)


def page(keywords: DataFrame) -> Iterator[str]:
    """The right-to-left page in parts: totals over everything, all hubs with all their clusters, largest first, then what was skipped.

    Rows come from Spark in their order, a partition at a time: the driver never holds the page.
    """
    s: Row = summary(keywords).first()
    intents = "".join(f"<li>{k}: {n}</li>" for k, n in sorted((s.intents or {}).items()))
    yield '<!doctype html><html lang="fa" dir="rtl"><meta charset="utf-8"><title>گزارش خوشه‌بندی کلیدواژه</title><body>'
    yield f"<ul><li>ورودی: {s.inputs}</li><li>خوشه: {s.clusters}</li><li>هاب موضوعی: {s.hubs}</li><li>میانگین نیت در هر هاب: {s.mean_intents}</li><li>ردشده: {s.skipped}</li><li>توزیع نیت خوشه‌ها:<ul>{intents}</ul></li></ul>"
    in_skipped = False
    for r in pieces(keywords).orderBy("place").toLocalIterator():
        if r.place.part and not in_skipped:
            in_skipped = True
            yield "<h2>ردشده‌ها</h2><table>"
        yield r.html
    yield f"{'</table>' if in_skipped else ''}</body></html>"


def write_page(keywords: DataFrame, path: str) -> None:
    """The page as one file on the driver; missing folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(page(keywords))


# one-row JSON reports (json), for sources.files.write_report


def _counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row: the number of rows by ``key`` as a map in order of its keys."""
    each = rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("k IS NOT NULL")
    return each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))


def _one(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:  # each is one row
        out = out.crossJoin(part)
    return out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def filter_report(rows: DataFrame, shops: int = 40, samples: int = 50) -> DataFrame:
    """Of examples (ordinal, id, text, source, source_kind): rejections by reason with the first ``samples``, wiki templates, and what
    is left by kind and by shop."""
    told = filtered(rows.withColumn("id", F.col("id").cast("string")), carry=("ordinal", "id", "text", "source", "source_kind"))
    few = told.rejected.orderBy("ordinal").limit(samples).agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", "text", "reason", "source", "source_kind"))).alias("rejected_samples"))
    wiki = template_report(told.kept.where("source_kind = 'wiki'")).agg(F.first(F.struct("n_clusters", "largest_cluster", "dropped", F.col("n_out").alias("kept_after_dedupe"))).alias("wiki_template"))
    shop = told.kept.where("source_kind = 'ecommerce'")
    totals = told.kept.agg(F.count("*").alias("final_n"), F.count_if(F.col("source_kind") == "ecommerce").alias("ecommerce_n")).withColumn("ecommerce_shortfall", F.greatest(F.lit(0), shops - F.col("ecommerce_n")))
    return _one([totals, _counts(told.rejected, "reason", "rejection_counts"), wiki, _counts(told.kept, "source_kind", "final_by_kind"), _counts(shop, "source", "ecommerce_domains"), few])


def alignment_report(rows: DataFrame, samples: int = 10) -> DataFrame:
    """Of rows (ordinal, id, source, strata, text, ours, model): totals, the decision, rates by source and stratum, reasons, first samples."""
    rates = alignment_rates(rows)
    each = F.struct((F.col("n") - F.col("unaligned")).alias("n_aligned"), F.col("unaligned").alias("n_unaligned"), F.col("rate").alias("unaligned_rate"))

    def of(dim: str, name: str, value: Column) -> DataFrame:
        return rates.where((F.col("dim") == dim) & (F.col("key") != "aligned")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", value.alias("v"))))).alias(name))

    total = rates.where("dim = 'overall'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("unaligned"), F.lit(0)).alias("n_unaligned"))
    total = total.withColumn("unaligned_rate", F.coalesce(F.try_divide("n_unaligned", "total"), F.lit(0.0)))
    total = total.withColumns({"threshold": F.lit(MAX_UNALIGNED), "decision": F.when(F.col("unaligned_rate") > MAX_UNALIGNED, "switch_token_contract_to_dadma").otherwise("keep_hand_tokens")})
    few = alignment_samples(rows, samples).agg(F.sort_array(F.collect_list(F.struct("ordinal", "id", "source", "strata", "reason", "text", "ours", "model"))).alias("unaligned_samples"))
    return _one([total, of("source", "by_source", each), of("stratum", "by_strata", each), of("reason", "mismatch_reasons", F.col("n")), few])


def evaluation_report(metrics: DataFrame) -> DataFrame:
    """All slices of labels.evaluate() in order of dim and key."""
    return _one([metrics.agg(F.sort_array(F.collect_list(F.struct(*metrics.columns))).alias("slices"))])


def manifest(batch: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """What a labelling batch (ordinal, pool, place) holds, with ids and kinds of its ``rows`` (ordinal, id, kind)."""
    both = batch.join(rows.select("ordinal", "id", "kind"), "ordinal")
    ids = both.agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("pool") != "wiki").alias("p"), "place", "id"))), lambda x: x["id"]).alias("ids"))
    totals = both.agg(F.lit(seed).alias("seed"), F.count_if(F.col("pool") == "wiki").alias("n_wiki"), F.count_if(F.col("pool") != "wiki").alias("n_commercial"))
    return _one([totals, ids, _counts(both, "kind", "source_kinds")])
