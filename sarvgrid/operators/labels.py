"""Token spans, labelling worksheets, ingest of labels, alignment with a model's tokens, and metrics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.charclass import ARABIC, STRATA_QUOTAS, WORD, ZWNJ
from .sentences import labelable

MIN_EXAMPLES, MAX_UNALIGNED = 20, 0.10
SPAN = "struct<start:int,end:int>"


def spans(text: Column, tokens: Column) -> Column:
    """Half-open character spans of tokens in order, each searched from the end of the one before; null where one isn't found."""
    def moved(state: Column, token: Column, at: Column) -> Column:
        ok = state["ok"] & (at >= 0) & (token != "")
        span = F.struct(at.cast("int").alias("start"), (at + F.length(token)).cast("int").alias("end"))
        return F.struct(ok.alias("ok"), F.when(ok, at + F.length(token)).otherwise(state["pos"]).cast("int").alias("pos"), F.when(ok, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, token: Column) -> Column:
        return X.bound(F.call_function("locate", token, text, state["pos"] + 1) - 1, lambda at: moved(state, token, at))

    start = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return F.aggregate(tokens, start, step, lambda s: F.when(s["ok"], s["spans"]))


def problems(text: Column, tokens: Column, given: Column, model_tokens: Column | None = None) -> Column:
    """What is wrong with the tokens and spans of an example, of token texts the first; empty where nothing is. Tokens that can't be
    found in the text end the list."""
    found = spans(text, tokens if model_tokens is None else model_tokens)
    pairs = F.arrays_zip(tokens.alias("t"), given.alias("s"))
    places = F.when(F.size(pairs) > 0, F.sequence(F.lit(0), F.size(pairs) - 1)).otherwise(F.array().cast("array<int>"))
    bad = F.filter(places, lambda i: ~F.coalesce(F.substring(text, F.get(given, i)["start"] + 1, F.get(given, i)["end"] - F.get(given, i)["start"]) == F.get(tokens, i), F.lit(False)))
    first = [F.when(~model_tokens.eqNullSafe(tokens), F.lit("tokens_mismatch"))] if model_tokens is not None else []
    slices = F.when(found.isNotNull() & (F.size(bad) > 0), F.concat(F.lit("span_slice_mismatch@"), F.get(bad, 0).cast("string")))
    return F.array_compact(F.array(*first, F.when(found.isNull(), F.lit("align_failed")), F.when(found.isNotNull() & ~found.eqNullSafe(given), F.lit("char_spans_mismatch")), slices))


def alignment(ours: Column, model: Column) -> Column:
    """Why two token lists differ: aligned, punctuation, zwnj, number, latin or other."""
    a, b = F.array_join(ours, ""), F.array_join(model, "")
    keep = rf"[^{WORD}{ARABIC}\u200c]+"
    marked = F.concat(a, b).rlike(r"[.,!?;:،؛؟۔«»\"'()\[\]{}…\-_/]")
    n = F.least(F.size(ours), F.size(model))
    differs = F.exists(F.zip_with(F.slice(ours, F.lit(1), n), F.slice(model, F.lit(1), n), lambda x, y: x.contains(ZWNJ) != y.contains(ZWNJ)), lambda x: x)
    return (
        F.when(ours == model, "aligned")
        .when(marked & (F.regexp_replace(a, keep, "") == F.regexp_replace(b, keep, "")), "punctuation")
        .when((a.contains(ZWNJ) != b.contains(ZWNJ)) | differs, "zwnj")
        .when(F.concat(a, b).rlike(r"\p{Nd}"), "number")
        .when(F.concat(a, b).rlike("[A-Za-z]"), "latin")
        .otherwise("other")
    )


def alignment_rates(rows: DataFrame) -> DataFrame:
    """dim, key, n, unaligned, rate of ``rows`` (source, strata, ours, model): overall, by source, by stratum and by reason."""
    reason = alignment(F.col("ours"), F.col("model"))
    source = F.when(F.trim("source") == "", "?").otherwise(F.col("source"))
    tags = F.when(F.size("strata") > 0, F.col("strata")).otherwise(F.array(F.lit("(none)")))
    dims = F.concat(F.array(F.struct(F.lit("overall").alias("dim"), F.lit("all").alias("key")), F.struct(F.lit("source").alias("dim"), source.alias("key")), F.struct(F.lit("reason").alias("dim"), F.col("reason").alias("key"))), F.transform(tags, lambda t: F.struct(F.lit("stratum").alias("dim"), t.alias("key"))))
    cells = rows.withColumn("reason", reason).select("reason", F.explode(dims).alias("d")).select("reason", "d.dim", "d.key")
    return cells.groupBy("dim", "key").agg(F.count("*").alias("n"), F.count_if(F.col("reason") != "aligned").alias("unaligned")).withColumn("rate", F.col("unaligned") / F.col("n"))


def alignment_samples(rows: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` rows (ordinal, id, source, strata, text, ours, model), by ordinal, whose tokens differ, with the reason."""
    told = rows.withColumn("reason", alignment(F.col("ours"), F.col("model"))).where("reason <> 'aligned'")
    return told.orderBy("ordinal").limit(most).select("ordinal", "id", "source", "strata", "reason", "text", "ours", "model")


def verified(rows: DataFrame) -> DataFrame:
    """id and problems() of each row (id, text, tokens, char_spans, model: the model's tokens); its problems are empty where all is well."""
    return rows.select("id", problems(F.col("text"), F.col("tokens"), F.col("char_spans"), F.col("model")).alias("problems"))


def contract(rates: DataFrame) -> DataFrame:
    """If the overall unaligned rate says that the token contract must change."""
    return rates.where("dim = 'overall'").select("n", "unaligned", "rate", F.when(F.col("rate") > MAX_UNALIGNED, "switch").otherwise("keep").alias("decision"))


def worksheet(rows: DataFrame) -> DataFrame:
    """For each sentence (ordinal, id, text, tokens) a header row, then a row for each token; labels are never filled in."""
    head = F.struct(F.lit(-1).alias("place"), F.lit("").alias("token_index"), F.col("text").alias("token"), F.lit("").alias("labelable"), F.lit("").alias("ezafe"), F.lit("").alias("ambiguous"))
    body = F.transform("tokens", lambda t, i: F.struct(i.cast("int").alias("place"), i.cast("string").alias("token_index"), t.alias("token"), F.when(labelable(t), "1").otherwise("0").alias("labelable"), F.when(labelable(t), "").otherwise("-").alias("ezafe"), F.lit("").alias("ambiguous")))
    return rows.select("ordinal", "id", F.explode(F.concat(F.array(head), body)).alias("w")).select("ordinal", "id", "w.*")


class Ingested(NamedTuple):
    labelled: DataFrame
    errors: DataFrame


def ingest(sheet: DataFrame, base: DataFrame, labeler: str) -> Ingested:
    """Labels of a filled worksheet (id, token_index, token, labelable, ezafe, ambiguous) joined with their sentences (id, tokens).

    A sentence is labelled whole or not at all: errors has the first rule that each failing one breaks.
    """
    index = F.trim("token_index")
    cells = sheet.where(F.coalesce(index, F.lit("")) != "").withColumn("place", F.expr("try_cast(trim(token_index) AS INT)"))
    cell = F.struct("place", "token", F.trim(F.coalesce("labelable", F.lit(""))).alias("flag"), F.trim(F.coalesce("ezafe", F.lit(""))).alias("label"), F.lower(F.trim(F.coalesce("ambiguous", F.lit("")))).alias("unsure"))
    rows = cells.groupBy("id").agg(F.sort_array(F.collect_list(cell)).alias("cells")).join(base.select("id", "tokens"), "id", "left")
    words = F.transform("cells", lambda c: c["token"])
    real = lambda c: labelable(c["token"])
    error = (
        F.when(F.col("tokens").isNull(), "unknown_id")
        .when(F.transform("cells", lambda c: c["place"]) != F.transform("tokens", lambda t, i: i.cast("int")), "index_sequence")
        .when(words != F.col("tokens"), "token_text")
        .when(F.exists("cells", lambda c: (c["flag"] != "") & (c["flag"] != F.when(real(c), "1").otherwise("0"))), "labelable_flag")
        .when(F.exists("cells", lambda c: ~real(c) & ~c["label"].isin("", "-")), "label_on_unlabelable")
        .when(F.exists("cells", lambda c: real(c) & ~c["label"].isin("0", "1")), "missing_label")
    )
    rows = rows.withColumn("error", error)
    good = rows.where("error IS NULL").select("id", F.transform("cells", lambda c: F.when(c["label"] == "1", 1).otherwise(0)).alias("ezafe"), F.exists("cells", lambda c: real(c) & c["unsure"].isin("1", "true", "yes", "y")).alias("ambiguous"), F.lit(True).alias("verified"), F.lit(labeler).alias("labeled_by"))
    return Ingested(good, rows.where("error IS NOT NULL").select("id", "error"))


def upsert(base: DataFrame, new: DataFrame, key: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """Rows of ``new`` replace those of ``base`` by key and keep their place; the rest of ``new`` comes after all of them.

    Where ``base`` has an ordinal, so does the result: places of the rest run on from its last one, in their own order or by key.
    """
    both = base.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)).select(key, "_new", *(F.col(c).alias(f"_{c}") for c in new.columns if c != key)), key, "full_outer")
    columns = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns and c not in (key, ordinal) else F.col(c) for c in base.columns]
    if ordinal not in base.columns:
        return both.select(*columns)
    last = base.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("m")).first().m
    kept = both.where("_old").select(*columns)
    more = both.where("_old IS NULL").select(*columns, *([F.col(f"_{ordinal}")] if ordinal in new.columns else []))
    # only what is new is numbered: by its own ordinal, or in ranges of the key
    if ordinal in new.columns:
        least = new.agg(F.min(ordinal).alias("m")).first().m
        return kept.unionByName(more.withColumn(ordinal, F.col(f"_{ordinal}") - F.lit(least) + last + 1).drop(f"_{ordinal}"))
    return kept.unionByName(more.sort(key).withColumn(ordinal, F.monotonically_increasing_id() + last + 1))


def masked(rows: DataFrame) -> DataFrame:
    """id, source_kind, domain, strata, gold and pred at labelable tokens only (rows: tokens, ezafe, pred); lengths must agree."""
    same = (F.size("tokens") == F.size("ezafe")) & (F.size("tokens") == F.size("pred"))
    rows = rows.withColumn("_ok", F.when(~F.coalesce(same, F.lit(False)), F.raise_error(F.concat(F.lit("lengths differ for "), F.col("id")))).otherwise(True)).where("_ok")
    cells = F.arrays_zip("tokens", "ezafe", "pred")
    return rows.select("id", "source_kind", "domain", "strata", F.filter(cells, lambda c: labelable(c["tokens"])).alias("cells"))


def confusion(gold: Column, pred: Column) -> list[Column]:
    """tp, fp, tn, fn of 0/1 columns."""
    return [F.count_if((gold == g) & (pred == p)).alias(n) for n, g, p in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))]


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; a ratio of nothing is null, not 0."""
    out = counts.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate(gold: DataFrame, predictions: DataFrame, least: int = MIN_EXAMPLES) -> DataFrame:
    """Metrics overall, by source group, by domain and by stratum: dim, key, status, n_examples, n_tokens, counts and scores.

    gold: id, source_kind, domain, strata, tokens, ezafe. predictions: id, pred. Tokens that can't be labelled don't count, nor do examples
    without others. Slices of fewer than ``least`` examples say so and have no numbers.
    """
    # an example without predictions has none of the right length; as a null it would be filtered out before that is seen
    gold = gold.select("id", "source_kind", "domain", "strata", "tokens", "ezafe")
    both = gold.join(predictions.select("id", "pred"), "id", "left").withColumn("pred", F.coalesce("pred", F.array().cast("array<int>")))
    rows = masked(both).where(F.size("cells") > 0)
    tags = F.when(F.size("strata") > 0, F.col("strata")).otherwise(F.array(F.lit("(none)")))
    group = F.when(F.col("source_kind") == "wiki", "wikipedia").otherwise("commercial")
    dims = F.concat(F.array(F.struct(F.lit("overall").alias("dim"), F.lit("all").alias("key")), F.struct(F.lit("source").alias("dim"), group.alias("key")), F.struct(F.lit("source").alias("dim"), F.concat(F.lit("domain:"), "domain").alias("key"))), F.transform(tags, lambda t: F.struct(F.lit("stratum").alias("dim"), t.alias("key"))))
    # a sentence's counts are summed before it is dealt to its slices
    def cell(g: int, p: int) -> Column:
        return F.size(F.filter("cells", lambda c: (c["ezafe"] == g) & (c["pred"] == p)))

    per = [cell(g, p).alias(n) for n, g, p in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))]
    cells = rows.select(F.explode(dims).alias("d"), F.size("cells").alias("n"), *per).select("d.dim", "d.key", "n", "tp", "fp", "tn", "fn")
    out = scores(cells.groupBy("dim", "key").agg(F.count("*").alias("n_examples"), F.sum("n").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn"))))
    enough = F.col("n_examples") >= least
    numbers = ("n_tokens", "tp", "fp", "tn", "fn", "precision", "recall", "f1")
    return out.select("dim", "key", F.when(enough, "ok").otherwise("insufficient_sample").alias("status"), F.when(enough, F.col("n_examples")).alias("n_examples"), *(F.when(enough, F.col(c)).alias(c) for c in numbers))


def report(metrics: DataFrame) -> DataFrame:
    """The metrics as lines of text, four decimals, n/a for what is undefined."""
    shown = [F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string("%.4f", F.col(c))) for c in ("precision", "recall", "f1")]
    line = F.format_string("%s %s: examples=%d tokens=%d tp=%d fp=%d tn=%d fn=%d precision=%s recall=%s f1=%s", "dim", "key", "n_examples", "n_tokens", "tp", "fp", "tn", "fn", *shown)
    return metrics.select("dim", "key", F.when(F.col("status") == "ok", line).otherwise(F.concat_ws(" ", "dim", "key", "status")).alias("line"))


def quotas() -> dict[str, int]:
    return dict(STRATA_QUOTAS)
