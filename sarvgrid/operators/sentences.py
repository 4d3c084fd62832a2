"""Sentence and token filters, strata, template dedupe, and samples for labelling."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.charclass import ARABIC, BLOCKED_DOMAINS, END, KIND_OF_DOMAIN, LONGEST_WEB_SENTENCE, NAV_WORDS, SHOP_CUES, SPACE, STRATA_QUOTAS, UI_PHRASES, UNITS, VERBS, WORD, ZWNJ

_EDGES = r"[«»\"'()\[\]{}،,؛;:.!?؟۔…\-_/]+"
_CLAUSE = "|".join(VERBS) + rf"|می{ZWNJ}[{WORD}]+|مي[{WORD}]+|نمى[{WORD}]+|نمی{ZWNJ}[{WORD}]+|[{WORD}]+(?:ند|ید|یم|م|ی|د)"
_LIGHT = "|".join(VERBS[:7]) + rf"|می{ZWNJ}[{WORD}]+|مي[{WORD}]+"


def rejection(sentence: Column) -> Column:
    """The first rule that a sentence breaks, or null."""
    return X.bound(X.squeeze(sentence), _rejection)


def _rejection(s: Column) -> Column:
    def chrome(bare: Column) -> Column:
        found = s.contains(UI_PHRASES[0]) | bare.contains(UI_PHRASES[0])
        for phrase in UI_PHRASES[1:]:
            found |= s.contains(phrase) | bare.contains(phrase)
        return found

    def of_words(words: Column) -> Column:
        persian = F.size(F.filter(words, lambda t: t.rlike(f"[{ARABIC}]")))
        foreign = F.size(F.filter(words, lambda t: ~F.regexp_replace(t, f"^{_EDGES}|{_EDGES}\\z", "").rlike(f"[{ARABIC}]")))
        return F.when(persian < 7, "too_few_persian_tokens").when(foreign / F.size(words) > 0.30, "non_persian_token_ratio")

    end = X.squeeze(F.regexp_replace(s, rf"[.!?؟۔…»\"']+{END}", ""))
    return (
        F.when(s == "", "empty")
        .when(s.contains("...") | s.contains("…") | s.contains("|") | s.contains("｜"), "ellipsis_or_pipe")
        .when(s.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}") | s.rlike(r"(?i)https?://|www\."), "email_or_url")
        .when(s.rlike(rf"\p{{Nd}}+[{SPACE}]*(?:روز|ساعت|دقیقه|هفته|ماه)[{SPACE}]*(?:قبل|پیش)|دیروز|امروز[{SPACE}]+ساعت"), "relative_time")
        .when(X.bound(F.translate(s, ZWNJ, ""), chrome), "ui_chrome")
        .otherwise(F.coalesce(X.bound(F.split(s, " "), of_words), F.when(~end.rlike(rf"(?:{_CLAUSE})[{SPACE}]*[.!?؟۔…]?{END}"), "no_finite_verb_end")))
    )


def labelable(token: Column) -> Column:
    """Not empty, controls, punctuation, digits or Latin letters only."""
    return ~(F.length(token) == 0) & ~token.rlike(rf"^(?:[\x00-\x1f\x7f-\x9f‌-‏]+|[^\p{{L}}\p{{N}}]+|\p{{Nd}}+|[A-Za-z]+)\z")


def strata(text: Column) -> Column:
    """Tags for sampling, in their order."""
    number = rf"\p{{Nd}}|{'|'.join(UNITS)}"
    # white space or the end
    stop = f"(?:[{SPACE}]|\\z)"
    ye = rf"ی[{SPACE}]+که|یی{stop}|یک[{SPACE}]+[^{SPACE}]+ی{stop}|(?:^|[{SPACE}])[^{SPACE}]+ی[{SPACE}]+را{stop}"
    clause = X.bound(X.word_count(text), lambda n: n.between(5, 10)) & ~text.rlike(rf"[{SPACE}]+(?:ی|ِ)[{SPACE}]+") & text.rlike(rf"(?:{_LIGHT})[{SPACE}]*[.!?؟۔]?{END}")
    tags = {"zwnj": text.contains(ZWNJ), "plural_ha": text.contains("ها"), "ye_non_ezafe": text.rlike(ye), "latin_brand": text.rlike("[A-Za-z]"), "number_unit": text.rlike(number), "no_ezafe_candidate": clause}
    return F.array_compact(F.array(*(F.when(test, F.lit(tag)) for tag, test in tags.items())))


def candidate(sentence: Column) -> Column:
    """5 to 15 words and at least 8 characters of the Arabic block."""
    return X.word_count(sentence).between(5, 15) & (F.length(F.regexp_replace(sentence, f"[^{ARABIC}]", "")) >= 8)


class Filtered(NamedTuple):
    kept: DataFrame
    rejected: DataFrame
    counts: DataFrame


def filtered(rows: DataFrame, text: str = "text", carry: tuple[str, ...] = ("id", "text", "source", "source_kind")) -> Filtered:
    """The rows whose sentence breaks no rule; the others as ``carry`` and the reason; and the number of rows by reason."""
    # behind once(), so that what asks for the reason doesn't work it out again
    told = X.once(rows.withColumn("reason", rejection(F.col(text))))
    rejected = told.where("reason IS NOT NULL").select(*(c for c in carry if c in rows.columns), "reason")
    return Filtered(told.where("reason IS NULL").drop("reason"), rejected, rejected.groupBy("reason").agg(F.count("*").alias("n")))


def shop_sentence(sentence: Column, host: Column) -> Column:
    """A candidate of a web page: short enough, without words of menus, and from a shop or with a word of shopping."""
    plain = (F.length(sentence) <= LONGEST_WEB_SENTENCE) & candidate(sentence) & ~sentence.rlike(f"(?iu){NAV_WORDS}")
    return plain & (host.isin(*KIND_OF_DOMAIN["ecommerce"]) | sentence.rlike(SHOP_CUES))


def unblocked(rows: DataFrame, source: str = "source") -> DataFrame:
    return rows.where(F.coalesce(F.col(source), F.lit("")) != "").where(~F.col(source).isin(*BLOCKED_DOMAINS))


def dedupe_templates(rows: DataFrame, text: str = "text", ordinal: str = "ordinal", most: int = 3) -> DataFrame:
    """The first ``most`` rows of each sentence template, by ordinal."""
    own = Window.partitionBy("template").orderBy(ordinal)
    return rows.withColumn("template", X.template_fingerprint(F.col(text))).withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= most).drop("_n")


def template_report(rows: DataFrame, text: str = "text", most: int = 3) -> DataFrame:
    """n_in, n_out, n_clusters, largest_cluster, dropped."""
    sizes = rows.groupBy(X.template_fingerprint(F.col(text)).alias("template")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_in"), F.coalesce(F.sum(F.least("n", F.lit(most))), F.lit(0)).alias("n_out"), F.count("*").alias("n_clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_cluster"))
    return total.withColumn("dropped", F.col("n_in") - F.col("n_out"))


def first_texts(rows: DataFrame, text: str = "text", ordinal: str = "ordinal") -> DataFrame:
    """The first row of each text."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(text).orderBy(ordinal))).where("_n = 1").drop("_n")


def unseen(rows: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    return rows.join(seen.select(text).distinct(), text, "left_anti")


def quota_mix(rows: DataFrame, wiki: int, keep: int, floor: int = 40) -> DataFrame:
    """The first ``wiki`` rows of kind wiki; of the others ``keep``: shops first up to a floor, then other kinds, then more shops.

    Each kind is cut to as many rows as could be wanted before rows are numbered, whatever the input.
    """
    shop, first = F.coalesce(F.col("kind") == "ecommerce", F.lit(False)), min(keep, max(floor, keep // 2))
    from_wiki = F.coalesce(F.col("kind") == "wiki", F.lit(False))
    some = rows.where(from_wiki).orderBy("ordinal").limit(wiki).withColumn("tier", F.lit(0))
    shops = rows.where(shop).orderBy("ordinal").limit(keep).withColumn("tier", F.when(F.row_number().over(Window.orderBy("ordinal")) <= first, 1).otherwise(3))
    others = rows.where(~shop & ~from_wiki).orderBy("ordinal").limit(keep).withColumn("tier", F.lit(2))
    return some.unionByName(shops.unionByName(others).orderBy("tier", "ordinal").limit(keep))


def first_of_each(rows: DataFrame, quotas: dict[str, int], most: int, *order: Column | str) -> DataFrame:
    """What greedy picks of at most ``most`` rows can reach: the first ``most`` rows of each stratum, a row for each ordinal."""
    each = rows.withColumn("_s", F.explode("strata")).where(F.col("_s").isin(*quotas))
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy(*order))).where(F.col("_n") <= most)
    return each.drop("_s", "_n").dropDuplicates(["ordinal"])


def greedy_strata(rows: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """Rounds over the strata in order: each unmet one takes the first unused row that has it, which counts for all of its strata.

    Only sequential picks can state this, so Spark first keeps what may be picked: the first ``sum of quotas`` rows of each
    stratum, a bound that doesn't depend on the input; those go through one group.
    """
    quotas = quotas or STRATA_QUOTAS
    few = first_of_each(rows, quotas, sum(quotas.values()), "ordinal").select("ordinal", "strata")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        found = take_in_rounds(list(zip(pdf["ordinal"], pdf["strata"], strict=True)), quotas, None)
        return pd.DataFrame([(o, s, k) for k, (o, s) in enumerate(found)], columns=["ordinal", "picked_for", "place"])

    return few.groupBy().applyInPandas(pick, "ordinal long, picked_for string, place long")


def take_in_rounds(left: list[tuple[int, list[str]]], quotas: dict[str, int], most: int | None) -> list[tuple[int, str]]:
    """(row, stratum it was picked for) in order. What is unmet is looked up once a round. With ``most``, rounds go on over all strata
    once none is unmet, up to so many picks."""
    filled, picked = dict.fromkeys(quotas, 0), []
    while most is None or len(picked) < most:
        before = len(picked)
        unmet = [s for s in quotas if filled[s] < quotas[s]]
        for stratum in unmet or (list(quotas) if most is not None else []):
            at = next((k for k, (_, has) in enumerate(left) if stratum in has), None)
            if at is not None:
                row, has = left.pop(at)
                picked.append((row, stratum))
                for s in has:
                    if s in filled:
                        filled[s] += 1
            if most is not None and len(picked) >= most:
                break
        if len(picked) == before:
            break
    return picked


def labelling_batch(rows: DataFrame, n_wiki: int = 25, n_commercial: int = 25, seed: int = 20260728, quotas: dict[str, int] | None = None) -> DataFrame:
    """A fixed sample of each pool, wiki and commercial: ordinal, pool, place.

    Rows are shuffled by md5 of (seed, ordinal). Strata come first, in rounds, until each has a sixth of its quota or more; then rows
    in shuffled order fill the pool. Only the first rows of each stratum and of the pool can be picked, and no others leave Spark.
    """
    quotas = {k: max(1, q // 6) for k, q in (quotas or STRATA_QUOTAS).items()}
    wiki = F.coalesce(F.col("kind") == "wiki", F.lit(False))
    shuffled = rows.select("ordinal", "strata", F.md5(F.concat(F.lit(f"{seed}:"), F.col("ordinal").cast("string"))).alias("_h"), wiki.alias("_w"))
    found = []
    for pool, own, n in (("wiki", F.col("_w"), n_wiki), ("commercial", ~F.col("_w"), n_commercial)):
        some = shuffled.where(own)
        few = first_of_each(some, quotas, n, "_h", "ordinal").unionByName(some.orderBy("_h", "ordinal").limit(n)).dropDuplicates(["ordinal"])

        found.append(few.groupBy().applyInPandas(_pool(pool, n, quotas), "ordinal long, pool string, place long"))
    return found[0].unionByName(found[1])


def _pool(pool: str, n: int, quotas: dict[str, int]):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "ordinal"])
        picked = dict.fromkeys([*(o for o, _ in take_in_rounds(list(zip(pdf["ordinal"], pdf["strata"], strict=True)), quotas, n)), *pdf["ordinal"]])
        return pd.DataFrame({"ordinal": list(picked)[:n], "pool": pool, "place": range(min(n, len(picked)))})

    return pick


def select_corpus(rows: DataFrame, n_wiki: int = 120, n_web: int = 80, quotas: dict[str, int] | None = None) -> DataFrame:
    """ordinal, kind (wiki or web), place of the rows of a corpus: those picked for the strata, as far as the caps on kinds allow,
    then the first of each kind up to its cap. No sentence is made up: what is missing shows in shortfalls().

    Picks go through the first ``n_wiki`` wiki and ``n_web`` other rows before all others. Only rows that can be reached leave Spark.
    """
    quotas = quotas or STRATA_QUOTAS
    most = sum(quotas.values())
    own = rows.select("ordinal", "strata", F.coalesce(F.col("kind") == "wiki", F.lit(False)).alias("_w"))
    heads, later = [], F.lit(False)
    for wiki, n in ((True, n_wiki), (False, n_web)):
        first = own.where(F.col("_w") == wiki).orderBy("ordinal").limit(n + most)
        heads.append(first)
        last = first.orderBy("ordinal").limit(n).agg(F.max("ordinal").alias("m")).first().m
        later |= (F.col("_w") == wiki) & (F.col("ordinal") > (last if last is not None else -1))
    few = first_of_each(own, quotas, most, later, ~F.col("_w"), "ordinal").unionByName(heads[0]).unionByName(heads[1]).dropDuplicates(["ordinal"]).withColumn("_later", later)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["_web"] = ~pdf["_w"]
        ordered = pdf.sort_values(["_later", "_web", "ordinal"])
        is_wiki = dict(zip(pdf["ordinal"], pdf["_w"], strict=True))
        cap, final = {True: n_wiki, False: n_web}, []
        count = {True: 0, False: 0}
        chosen = [o for o, _ in take_in_rounds(list(zip(ordered["ordinal"], ordered["strata"], strict=True)), quotas, None)]
        by_kind = [o for wiki in (True, False) for o in pdf.loc[pdf["_w"] == wiki, "ordinal"].sort_values()]
        for o in dict.fromkeys([*chosen, *by_kind]):
            if count[is_wiki[o]] < cap[is_wiki[o]]:
                final.append(o)
                count[is_wiki[o]] += 1
        return pd.DataFrame({"ordinal": final, "kind": ["wiki" if is_wiki[o] else "web" for o in final], "place": range(len(final))})

    return few.groupBy().applyInPandas(pick, "ordinal long, kind string, place long")


def shortfalls(rows: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """stratum, filled, shortfall for each quota."""
    quotas = quotas or STRATA_QUOTAS
    asked = rows.sparkSession.createDataFrame(list(quotas.items()), "stratum string, quota long")
    have = rows.select(F.explode("strata").alias("stratum")).groupBy("stratum").agg(F.count("*").alias("filled"))
    return asked.join(have, "stratum", "left").select("stratum", F.coalesce("filled", F.lit(0)).alias("filled"), F.greatest(F.lit(0), F.col("quota") - F.coalesce("filled", F.lit(0))).alias("shortfall"))
