"""Every query against its SQL on the smallest tables; sources, sinks, streams and the entry module."""

import importlib
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sarvgrid import catalogue
from sarvgrid.operators import backends, report
from sarvgrid.sources import files
from sarvgrid.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    def value(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted(([value(r[n]) for n in names] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rows = got.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(rows, names) == plain([dict(zip(names, r)) for r in found.fetchall()], names)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.queries()) <= set(entry.queries())


def test_keyword_file(spark, tmp_path):
    path = tmp_path / "k.txt"
    path.write_text("# head\nخرید لپ تاپ\n\nx1\tقیمت طلا\n \tبدون شناسه\nlast\n", encoding="utf-8")
    rows = files.keyword_file(spark, str(path)).orderBy("ordinal").collect()
    assert [(r.keyword_id, r.text) for r in rows] == [("k001", "خرید لپ تاپ"), ("x1", "قیمت طلا"), ("", "بدون شناسه"), ("k002", "last")]


def test_keyword_file_over_many_blocks(spark, tmp_path):
    lines = [f"x{k}\tقیمت {k}" if k % 3 == 0 else "" if k % 7 == 0 else f"خرید {k}" for k in range(400)]
    for name, some in (("a.txt", lines[:250]), ("b.txt", lines[250:])):
        (tmp_path / name).write_text("\n".join(some) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = files.keyword_file(spark, str(tmp_path)).orderBy("ordinal").collect()
        assert files.numbered_lines(spark, str(tmp_path)).select("block").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected, n = [], 0
    for k, line in enumerate(lines):
        if line:
            n += "\t" not in line
            expected.append((k, *line.split("\t")) if "\t" in line else (k, f"k{n:03d}", line))
    assert [tuple(r) for r in rows] == expected


def test_examples_round_trip(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('# c\n{"id":"a","text":"x y","tokens":["x","y"],"char_spans":[[0,1],[2,3]],"ezafe":[1,0],"verified":true,"more":5,"deep":{"b":[1,"2",null]},"dadmatools_version":"2"}\n\n{"id":7,"text":"é z","tokens":["z"],"verified":false}\n', encoding="utf-8")
    rows = files.examples(spark, str(path))
    assert [(r.id, r.extra, r.char_spans[1].end, r.dadmatools_version) for r in rows.collect()] == [("a", '{"more":5,"deep":{"b":[1,"2",null]}}', 3, "2")]
    every = files.examples(spark, str(path), labelled=False)
    assert {r.id: [tuple(s) for s in r.char_spans] for r in every.collect()}["7"] == [(2, 3)]
    files.write_examples(every, str(tmp_path / "out"))
    text = "".join((tmp_path / "out" / p).read_text(encoding="utf-8") for p in sorted(os.listdir(tmp_path / "out")) if p.endswith(".txt"))
    back = {x["id"]: x for x in map(json.loads, text.splitlines())}
    assert back["a"]["more"] == 5 and back["a"]["deep"] == {"b": [1, "2", None]} and back["7"]["ezafe"] is None and "é" in text
    assert list(back["a"])[: len(files.FIELDS)] == list(files.FIELDS)
    assert files.examples(spark, str(tmp_path / "out"), labelled=False).exceptAll(every).count() == 0
    won = files.encode(rows.withColumn("extra", F.lit('{"note":"mine","z":1}'))).first().value
    assert json.loads(won)["note"] == "mine" and json.loads(won)["z"] == 1


@pytest.mark.parametrize("line,said", [("{oops", "not a JSON object"), ("[1]", "not a JSON object"), ('{"id":"a","text":"x"}', "missing"), ('{"id":"a","text":"x","tokens":[]}', "non-empty"), ('{"id":"a","text":"x","tokens":["y"]}', "not found"), ('{"id":"a","text":"x","tokens":["x"],"ezafe":[2]}', "0 or 1"), ('{"id":"a","text":"x","tokens":["x"],"ezafe":["q"]}', "0 or 1"), ('{"id":"a","text":"x","tokens":["x"],"ezafe":[1,0]}', "as many labels"), ('{"id":"a","text":"x","tokens":["x"],"char_spans":[[0,2]]}', "bad char_span"), ('{"id":"a","text":"xy","tokens":["x"],"char_spans":[[1,2]]}', "differs"), ('{"id":"a","text":"x","tokens":["x"],"source":"nowhere"}', "source_kind")])
def test_a_line_that_is_no_example_is_named(spark, line, said):
    lines = spark.createDataFrame([(line, 12)], "value string, number long")
    with pytest.raises(Exception, match=f"line 12: not an example: .*{said}"):
        files.decode(lines).collect()


def test_files_without_examples(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.examples(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "e.jsonl").write_text("# only a comment\n\n")
    with pytest.raises(ValueError, match="no examples"):
        files.examples(spark, str(tmp_path / "e.jsonl"))
    (tmp_path / "u.jsonl").write_text('{"id":"a","text":"x","tokens":["x"]}\n')
    with pytest.raises(ValueError, match="no verified"):
        files.examples(spark, str(tmp_path / "u.jsonl"))
    (tmp_path / "w.csv").write_text("id,token\n1,x\n")
    with pytest.raises(ValueError, match="token_index, ezafe"):
        files.worksheet(spark, str(tmp_path / "w.csv"))


def test_worksheet_file(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", ["کتاب", "."])], "ordinal long, id string, tokens array<string>").withColumn("text", F.array_join("tokens", " "))
    from sarvgrid.operators import labels

    assert files.write_worksheet(labels.worksheet(rows), str(tmp_path / "w")) == 3
    part = next(p for p in os.listdir(tmp_path / "w") if p.endswith(".csv"))
    assert (tmp_path / "w" / part).read_bytes().startswith(b"\xef\xbb\xbf")
    got = files.worksheet(spark, str(tmp_path / "w")).collect()
    assert len(got) == 3 and got[1].token == "کتاب" and got[2].ezafe == "-"


def test_report(spark, tmp_path):
    from sarvgrid.operators import keywords
    from sarvgrid.plans import fixtures

    rows = fixtures.keywords(spark, SF)
    odd = spark.createDataFrame([(10**6, "<b>", "<script> لپ", 3, "known"), (10**6 + 1, " ", "x & y", None, "unknown")], rows.schema)
    rows = rows.unionByName(odd)
    report.write_page(rows, str(tmp_path / "deep" / "page.html"))
    page = (tmp_path / "deep" / "page.html").read_text(encoding="utf-8")
    found, skipped = keywords.cluster(rows)
    s = report.summary(rows).first()
    assert (s.inputs, s.clusters, s.hubs, s.skipped) == (rows.count(), found.count(), keywords.hubs(found).count(), skipped.count())
    assert page.startswith("<!doctype html>") and 'dir="rtl"' in page and page.endswith("</body></html>")
    assert page.count("<h2>") == s.hubs + 1 and page.count('<section class="cluster">') == s.clusters and f"ردشده: {s.skipped}" in page
    assert "&lt;script&gt;" in page and "<script>" not in page and "x &amp; y" in page
    assert sum(s.intents.values()) == s.clusters
    none = report.summary(rows.where("false")).first()
    assert (none.inputs, none.clusters, none.mean_intents) == (0, 0, "—") and "".join(report.page(rows.where("false"))).endswith("</body></html>")


def test_json_reports(spark, tmp_path):
    from sarvgrid.operators import labels, sentences
    from sarvgrid.plans import fixtures

    rows = fixtures.sourced_rows(spark, SF)
    made = json.loads(report.filter_report(rows, samples=5).first().json)
    told = sentences.filtered(rows)
    assert made["final_n"] == told.kept.count() and sum(made["rejection_counts"].values()) == told.rejected.count() and len(made["rejected_samples"]) == 5
    pairs = catalogue._pairs(spark, SF)
    found = json.loads(report.alignment_report(pairs).first().json)
    assert found["total"] == pairs.count() and found["n_unaligned"] == sum(found["mismatch_reasons"].values()) and len(found["unaligned_samples"]) == 10
    assert found["decision"] == "switch_token_contract_to_dadma" and set(found["by_strata"]) == {"(none)", "zwnj", "latin_brand"}
    tokens = fixtures.token_rows(spark, SF)
    metrics = labels.evaluate(tokens, tokens.select("id", "pred"))
    assert len(json.loads(report.evaluation_report(metrics).first().json)["slices"]) == metrics.count()
    batch = catalogue.queries()["labelling_batch"](spark, SF)
    kinds = fixtures.sentence_rows(spark, SF).withColumn("id", F.concat(F.lit("s"), "ordinal"))
    listed = json.loads(report.manifest(batch, kinds, 7).first().json)
    assert listed["n_wiki"] == 25 and listed["n_commercial"] == 25 and listed["seed"] == 7 and len(set(listed["ids"])) == 50
    assert listed["ids"] == [f"s{r.ordinal}" for r in batch.orderBy(F.desc("pool"), "place").collect()] and sum(listed["source_kinds"].values()) == 50
    files.write_report(report.evaluation_report(metrics), str(tmp_path / "r"))
    assert any(p.endswith(".txt") for p in os.listdir(tmp_path / "r"))


def by_rounds(pool, quotas, most):
    """The rounds told once more, over the whole pool."""
    filled, chosen, moved = {q: 0 for q in quotas}, [], True
    while moved and (most is None or len(chosen) < most):
        moved = False
        todo = [q for q in quotas if filled[q] < quotas[q]]
        if most is not None and not todo:
            todo = [*quotas]
        for q in todo:
            for o, has in pool:
                if o not in chosen and q in has:
                    chosen.append(o)
                    moved = True
                    for h in has:
                        filled[h] += 1
                    break
            if most is not None and len(chosen) >= most:
                break
    return chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_samples_against_the_whole_pool(spark, seed):
    import hashlib
    import random

    from sarvgrid.functions.charclass import STRATA_QUOTAS
    from sarvgrid.operators import sentences

    rng = random.Random(seed)
    data = [(k, [s for s in STRATA_QUOTAS if rng.random() < 0.12], rng.choice(["wiki", "news", "ecommerce", "wiki"])) for k in rng.sample(range(3000), 700)]
    rows = spark.createDataFrame(data, "ordinal long, strata array<string>, kind string")
    data.sort()
    assert [r.ordinal for r in sentences.greedy_strata(rows).orderBy("place").collect()] == by_rounds([(o, h) for o, h, _ in data], STRATA_QUOTAS, None)
    small = {k: max(1, v // 6) for k, v in STRATA_QUOTAS.items()}
    got = sentences.labelling_batch(rows, 25, 40, 99).orderBy("place").collect()
    for pool, n in (("wiki", 25), ("commercial", 40)):
        own = sorted(((hashlib.md5(f"99:{o}".encode()).hexdigest(), o, h) for o, h, k in data if (k == "wiki") == (pool == "wiki")))
        picked = by_rounds([(o, h) for _, o, h in own], small, n)
        picked += [o for _, o, _ in own if o not in picked]
        assert [r.ordinal for r in got if r.pool == pool] == picked[:n]
    for n_wiki, n_web in ((120, 80), (30, 200), (0, 10)):
        wiki, web = ([(o, h) for o, h, k in data if (k == "wiki") == w] for w in (True, False))
        cap, have, final = {True: n_wiki, False: n_web}, {True: 0, False: 0}, []
        is_wiki = {o for o, _ in wiki}
        for o in [*by_rounds(wiki[:n_wiki] + web[:n_web] + wiki[n_wiki:] + web[n_web:], STRATA_QUOTAS, None), *(o for o, _ in wiki), *(o for o, _ in web)]:
            if o not in final and have[o in is_wiki] < cap[o in is_wiki]:
                final.append(o)
                have[o in is_wiki] += 1
        assert [r.ordinal for r in sentences.select_corpus(rows, n_wiki, n_web).orderBy("place").collect()] == final
    assert sentences.select_corpus(rows.where("false")).count() == 0


def test_upsert_places_new_rows_last(spark):
    from sarvgrid.operators import labels

    base = spark.createDataFrame([(3, "a", 1), (5, "b", 1), (9, "c", 1)], "ordinal long, id string, x int")
    new = spark.createDataFrame([(0, "z", 2), (1, "b", 2), (2, "d", 2)], "ordinal long, id string, x int")
    assert [(r.id, r.x) for r in labels.upsert(base, new).orderBy("ordinal").collect()] == [("a", 1), ("b", 2), ("c", 1), ("z", 2), ("d", 2)]
    assert [(r.id, r.x) for r in labels.upsert(base, new.drop("ordinal")).orderBy("ordinal").collect()] == [("a", 1), ("b", 2), ("c", 1), ("d", 2), ("z", 2)]


def test_tools_and_predictions(spark):
    from sarvgrid.operators import audit, examples

    told = {r.name: r for r in audit.described(audit.tools(spark)).collect()}
    assert told["publish.apply"].annotations.asDict() == {"readOnlyHint": False, "destructiveHint": True, "idempotent": True} and told["publish.apply"].requires_approval_id
    marks = "array<struct<token:string,has_ezafe:boolean>>"
    rows = spark.createDataFrame([(["x", "y"], [("x", True), ("y", False)], 1), (["x"], [("x", True), ("y", False)], 2), (["x", "z"], [("x", True), ("y", False)], 3)], f"tokens array<string>, m {marks}, k int")
    flags = lambda k: rows.where(f"k = {k}").select(examples.predicted(F.col("tokens"), F.col("m")).alias("f")).collect()
    assert flags(1)[0].f == [1, 0]
    for k, said in ((2, "alignment failed"), (3, "text mismatch")):
        with pytest.raises(Exception, match=said):
            flags(k)
    assert examples.installed_version("no-such-package") == "unknown" and examples.installed_version("pyspark")[0].isdigit()
    row = spark.createDataFrame([("a", "x y", [1])], "id string, text string, ezafe array<int>")
    other = examples.replace_tokens(row, F.array(F.lit("x"), F.lit("y"))).first()
    assert other.ezafe == [1] and [tuple(s) for s in other.char_spans] == [(0, 1), (2, 3)]
    with pytest.raises(Exception, match="tokens not found in the text of a"):
        examples.mint(row, F.array(F.lit("q")), "1").collect()


def test_pages_over_http(spark):
    import http.server
    import threading
    import urllib.parse

    from sarvgrid.sources import web

    tries = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            tries.append(self.path)
            url = urllib.parse.urlparse(self.path)
            code = 503 if url.path == "/later" and tries.count(self.path) < 3 else 404 if url.path == "/none" else 200
            body = "سلام".encode("cp1256") if url.path == "/old" else b"\xff ok" if url.path != "/api" else json.dumps({"query": {"pages": {str(k): {"pageid": k, "title": t, "extract": f"about {t}", "fullurl": "u", "revisions": [{"revid": 5}]} if t != "gone" else {"title": t, "missing": ""} for k, t in enumerate(urllib.parse.parse_qs(url.query)["titles"][0].split("|"))}}}).encode()
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=" + ("windows-1256" if url.path == "/old" else "utf-8"))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{at}/{p}",) for p in ("ok", "old", "later", "none")], "url string")
        quick = lambda url: web.get(url, pause=0.01)
        got = {r.url.rsplit("/", 1)[1]: r for r in web.pages(urls, quick).collect()}
        assert got["ok"].html == "\ufffd ok" and got["old"].html == "سلام" and got["later"].html and "404" in got["none"].error
        assert tries.count("/later") == 3 and tries.count("/none") == 1
        titles = spark.createDataFrame([(f"t{k}",) for k in range(5)] + [("gone",)], "title string").coalesce(1)
        found = sorted((r.page_title, r.text, r.revision_id) for r in web.extracts(titles, f"{at}/api", quick, batch=4).collect())
        assert found == [(f"t{k}", f"about t{k}", "5") for k in range(5)] and sum(t.startswith("/api") for t in tries) == 2
    finally:
        server.shutdown()


def test_models_and_adapters(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace as N

    monkeypatch.delenv(backends.MODELS, raising=False)
    for wrong in (None, "relative/folder"):
        with pytest.raises(LookupError, match="absolute"):
            backends.models_dir(wrong)
    monkeypatch.setenv(backends.MODELS, str(tmp_path / "m"))
    with pytest.raises(LookupError, match="no folder"):
        backends.assert_ready(backends.models_dir())
    (tmp_path / "m").mkdir()
    with pytest.raises(LookupError, match="incomplete"):
        backends.assert_ready(str(tmp_path / "m"))
    backends.mark_ready(str(tmp_path / "m"))
    backends.assert_ready(str(tmp_path / "m"))
    with pytest.raises(LookupError, match="not installed"):
        backends.pipeline_backend("n", "no_such_module", lambda m, at: None)
    backends.pipeline_backend("own", "json", lambda m, at: lambda text: [N(text=w, kasreh=w == "کتاب", score=3) for w in text.split()])
    backends.smoke_check(backends.REGISTRY["own"])
    assert backends.REGISTRY["own"]("کتاب علی") == [(0, "کتاب", True, 1.0, "S-kasreh"), (1, "علی", False, 1.0, "O")]
    with pytest.raises(LookupError, match="marks nothing"):
        backends.smoke_check(lambda text: [(0, text, False, None, "O")])
    tokens = [{"word": "a", "kasreh": "O"}, N(form="b", _=N(kasreh="I-kasreh")), N(text="c", kasreh=None)]
    assert [m[1:] for m in backends.doc_marks(N(tokens=tokens))] == [("a", False, None, "O"), ("b", True, None, "I-kasreh"), ("c", False, None, None)]
    assert len(backends.doc_tokens(N(_=N(sentences=[N(tokens=tokens), N(tokens=tokens[:1])])))) == 4 and backends.doc_tokens("text") == []
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    keys = names("l1.layer_text_task_adapters.ner.w", "l2.layer_text_task_adapters.ner.w", "other")
    ok = names("l1.layer_text_task_adapters.embedding.w", "l2.layer_text_task_adapters.embedding.w")
    assert sorted(r.target for r in backends.adapter_mapping(keys, ok).collect()) == sorted(r.name for r in ok.collect())
    with pytest.raises(LookupError, match="part of the mapping"):
        backends.adapter_mapping(keys, ok.limit(1))
    for none in (names("x"), keys.unionByName(names("l1.layer_text_task_adapters.pos.w"))):
        with pytest.raises(LookupError, match="one task"):
            backends.adapter_mapping(none, ok)


def test_times_and_labels(spark):
    from sarvgrid.functions import text as X

    row = spark.sql("SELECT parse_json(x) AS v FROM VALUES ('true'), ('0'), ('2'), ('\" B-x \"'), ('\"\"'), ('null') t(x)").select(X.label_of(F.col("v")).alias("l"), X.now_utc().alias("t")).collect()
    assert [r.l for r in row] == ["S-kasreh", "O", "S-kasreh", "B-x", None, None]
    import datetime

    assert abs((datetime.datetime.fromisoformat(row[0].t) - datetime.datetime.now(datetime.UTC)).total_seconds()) < 60


def test_backend_failures_are_unknown(spark):
    @backends.register("broken")
    def broken(text):
        raise RuntimeError(text)

    rows = spark.createDataFrame([("a", "متن"), ("b", " ")], "id string, text string")
    assert [(r.id, r.skipped, r.skip_reason) for r in backends.audit(rows).collect()] == [("a", True, "disabled")]
    assert [(r.id, r.skip_reason) for r in backends.audit(rows, "broken", True).collect()] == [("a", "backend_error")]
    with pytest.raises(LookupError):
        backends.marks(F.col("text"), "neural")


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "خرید لپ تاپ", "2024-01-01 00:00:00"), ("b", "لپ تاپ خرید", "2024-01-01 00:01:00"), ("c", "قیمت طلا", "2024-01-01 00:02:00")], "id string, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    stream = spark.readStream.schema("id string, text string, at timestamp").parquet(source)
    for name, frame, mode in (("intents", live.analyzed_keywords(stream), "append"), ("firsts", live.first_seen(stream), "append"), ("counts", live.intent_counts(stream), "complete")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.intent for r in spark.table("intents").collect()) == ["commercial", "transactional", "transactional"]
    assert spark.table("firsts").count() == 2 and sum(r.n for r in spark.table("counts").collect()) == 3
