"""What must hold for time to grow no faster than the input: costly texts are made once a row, by all cores."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sarvgrid import catalogue
from sarvgrid.functions import intent as I
from sarvgrid.functions import text as X
from sarvgrid.operators import backends, keywords, labels, report, sentences
from sarvgrid.plans import fixtures
from sarvgrid.sources import files

SF = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_round_trip_reads_each_map_once(spark):
    plan = plan_of(catalogue.queries()["examples_round_trip"](spark, SF))
    # unknown keys of each line, and once the fields and the unknown keys to be written; a lambda over them reads none anew
    assert plan.count("from_json(") <= 4 and plan.count("parse_json(") <= 2
    assert re.search(r"map_keys\([^)]*from_json", plan) is None


@pytest.mark.parametrize("name", ["token_rows", "sentence_rows", "sourced_rows", "keywords", "page_targets"])
def test_keys_are_dealt_over_all_cores(spark, name):
    rows = getattr(fixtures, name)(spark, SF)
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism


def test_lines_that_are_no_objects_are_named(spark):
    for line in ("[1]", '"x"', "3", "null", ' \t[{"id":"a"}]'):
        with pytest.raises(Exception, match="not a JSON object"):
            files.decode(spark.createDataFrame([(line, 1)], "value string, number long")).collect()
    kept = ['\t {"id":"a","text":"x","tokens":["x"]}', " ", " # c", "", None]
    assert files.decode(spark.createDataFrame([(k, 1) for k in kept], "value string, number long")).count() == 1


ENTITIES = [
    ("<title>a&&amp;b&amp</title> <p>c&amp d</p>", "a&&b&amp c&amp d", "a&&b& c& d"),
    ("<p>&lt;x&gt; &quot;&#39;&#x27;&nbsp;&copy;&middot;</p>", "<x> \"'' ©·", "<x> \"'' ©·"),
    ("<p>&amplify; &nosuch; &; &#; &amp;lt; &notin; &noti;</p>", "&amplify; &nosuch; &; &#; &lt; ∉ &noti;", "&lify; &nosuch; &; &#; &lt; ∉ ¬i;"),
]


def test_entities_without_a_semicolon_stay(spark):
    pages = spark.createDataFrame([(k, html) for k, (html, _, _) in enumerate(ENTITIES)], "k int, html string")
    rows = pages.select("k", X.strip_html(F.col("html")).alias("closed"), X.strip_html(F.col("html"), unclosed=True).alias("all"), X.paragraphs(F.col("html")).alias("p")).orderBy("k").collect()
    assert [(r.closed, r["all"]) for r in rows] == [(a, b) for _, a, b in ENTITIES]
    assert rows[0].p == ["c&amp d"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(k, html) for k, (html, _, _) in enumerate(ENTITIES[:2])])
    said = dict(con.execute(catalogue.oracle_sql()["html_strip"]).fetchall())
    assert said[0] == rows[0].closed


ONE_TEXT = "text string"


def test_made_examples_find_tokens_once(spark):
    plan = plan_of(catalogue.queries()["made_examples"](spark, SF))
    # words of the rejection and raw tokens; strata cut the text for its number of words
    assert plan.count("split(") <= 3 and plan.count("locate(") <= 1


@pytest.mark.parametrize("name", ["rejected_rows", "reject_histogram", "sentence_reject", "made_examples"])
def test_rules_run_above_the_deal(spark, name):
    """Filters move below a deal by key unless something stands between: there, one task would run the rules."""
    above, below = plan_of(catalogue.queries()[name](spark, SF)).split("RepartitionByExpression")
    assert "regexp_replace" in above and "regexp_replace" not in below and "RLIKE" not in below


@pytest.mark.parametrize("name,words", [("rejected_rows", 1), ("reject_histogram", 1), ("sentence_reject", 1)])
def test_a_sentence_is_cut_into_words_once(spark, name, words):
    assert plan_of(catalogue.queries()[name](spark, SF)).count("split(") == words


def test_rejection_of_null_and_odd_sentences(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \u00a0 ",), ("a|b",), ("سلام دنیا",), ("یک دو سه چهار پنج شش هفت هشت است\n",)], ONE_TEXT)
    assert [r.r for r in rows.select(sentences.rejection(F.col("text")).alias("r")).collect()] == [None, "empty", "empty", "ellipsis_or_pipe", "too_few_persian_tokens", None]


def test_display_unifies_a_text_once(spark):
    plan = plan_of(spark.createDataFrame([("a",)], ONE_TEXT).select(X.display(F.col("text")).alias("d")))
    assert plan.count("regexp_replace(") <= 12


def test_hubs_hold_no_members(spark):
    for name in ("topic_hubs", "cluster_members"):
        assert "collect_list" not in plan_of(catalogue.queries()[name](spark, SF))


def test_markers_cut_a_text_once(spark):
    plan = plan_of(spark.createDataFrame([("a",)], ONE_TEXT).select(I.markers(X.tokens(F.col("text"))).alias("m")))
    assert plan.count("split(") == 1


def test_strata_count_words_once(spark):
    assert plan_of(catalogue.queries()["strata_tags"](spark, SF)).count("split(") == 1


def test_summary_is_one_pass(spark):
    plan = plan_of(catalogue.queries()["report_summary"](spark, SF))
    assert plan.count("Window [") == 1 and "Join" not in plan


def test_audit_runs_its_backend_once(spark):
    @backends.register("halting")
    def halting(text):
        if text == "bad":
            raise RuntimeError(text)
        return [(0, text)] if text == "short" else [(i, w, w.startswith("x"), 0.5, None) for i, w in enumerate(text.split())]

    rows = spark.createDataFrame([(0, "xa b xc"), (1, "bad"), (2, " "), (3, None), (4, "b"), (5, "short"), (6, "xd")], "id int, text string")
    found = backends.audit(rows, "halting", True)
    assert plan_of(found).count("EvalPython") == 1
    assert sorted((r.id, r["index"], r.token, r.skipped, r.skip_reason) for r in found.where("NOT skipped").collect()) == [(0, 0, "xa", False, None), (0, 2, "xc", False, None), (6, 0, "xd", False, None)]
    assert sorted((r.id, r["index"], r.token, r.skip_reason) for r in found.where("skipped").collect()) == [(1, None, None, "backend_error"), (5, None, None, "backend_error")]


def test_marks_of_mixed_texts(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["", None, "کتابِ من", " ", "a"])], "k int, text string").coalesce(1)
    got = [r.m for r in rows.select("k", backends.marks(F.col("text")).alias("m")).orderBy("k").collect()]
    assert [m and [tuple(x) for x in m] for m in got] == [[], [], [(0, "کتابِ", True, None, "S-kasreh"), (1, "من", False, None, "O")], [], [(0, "a", False, None, "O")]]
    assert rows.where("text = ''").select(backends.marks(F.col("text")).alias("m")).first().m == []


def test_spans_look_up_a_token_once(spark):
    plan = plan_of(spark.createDataFrame([("a b",)], ONE_TEXT).select(labels.spans(F.col("text"), F.split("text", " ")).alias("s")))
    assert plan.count("locate(") == 1


def test_clusters_with_few_fields_of_members(spark):
    rows = fixtures.keywords(spark, SF)
    found, few = keywords.cluster(rows).clusters.collect(), {r.cluster_id: r for r in keywords.cluster(rows, member=("keyword_id",)).clusters.collect()}
    assert len(found) == len(few) > 1
    for r in found:
        codes = dict.fromkeys(c for m in r.members for c in m.intent_reason_codes)
        assert r.reason_codes == [*codes, *(["singleton_cluster"] if len(r.members) == 1 else [])]
        assert (r.head_keyword_id, r.head_text, r.head_label, r.n_members) == (r.members[0].keyword_id, r.members[0].text, " ".join(r.members[0].topic_core_tokens), len(r.members))
        own = few[r.cluster_id]
        assert [m.keyword_id for m in own.members] == [m.keyword_id for m in r.members] and own.members[0].__fields__ == ["after", "keyword_id"]
        assert (own.reason_codes, own.head_text, own.head_decided_by) == (r.reason_codes, r.head_text, r.head_decided_by)


def test_summary_of_skipped_rows_only(spark):
    s = report.summary(spark.createDataFrame([(0, " ", "x", None, "unknown"), (1, "a", "", None, "unknown")], "ordinal long, keyword_id string, text string, search_demand long, search_demand_status string")).first()
    assert s.asDict() == {"inputs": 2, "clusters": 0, "intents": {}, "hubs": 0, "mean_intents": "—", "skipped": 2}
