"""The pipeline's stages, each against a plain version on its own input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sarvgrid.llm import queries, qda
from sarvgrid.llm.words import Words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((docs, out))
        docs = out
    return dict(zip((n for n, _ in P.STAGES), seen))


def test_names_and_columns(spark, stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == columns
    assert queries.oracle_sql().keys() <= queries.queries().keys()


def test_quality_stage_keeps_good_documents(spark, stages):
    before, after = stages["quality_classifier"]
    kept = {r.doc_id for r in after.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert np.mean([d in kept for d in good]) > 0.9 and np.mean([d not in kept for d in bad]) > 0.9
    assert kept <= {r.doc_id for r in before.collect()}


def test_join_stage_keeps_one_of_each(stages):
    before, after = stages["ngram_jaccard_join"]
    rows = {r.doc_id: r.text for r in before.collect()}
    sets = {}
    for d, t in rows.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    left, expected = set(rows), set()
    for d in sorted(rows):
        if d in left:
            expected.add(d)
            todo = [d]
            while todo:
                a = sets[todo.pop()]
                near = [x for x in left if 100 * len(a & sets[x]) >= 80 * len(a | sets[x])]
                left -= set(near)
                todo += near
            left.discard(d)
    assert {r.doc_id for r in after.collect()} == expected


def test_dedup_stage_leaves_no_window_twice(stages):
    before, after = stages["substring_dedup"]
    was = {r.doc_id: r.text for r in before.collect()}
    seen, expected = set(), {}
    for d in sorted(was):
        w = was[d].encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        expected[d] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else was[d]
    assert {r.doc_id: r.text for r in after.collect()} == expected


def test_mixing_stage_meets_weights(stages):
    before, after = stages["source_mixing"]
    n = lambda df: {r.lang: r.n for r in df.groupBy("lang").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    a, b = n(before), n(after)
    share = {k: v / sum(a.values()) for k, v in a.items()}
    want = {k: v**0.7 for k, v in share.items()}
    for k in a:
        assert b[k] / sum(b.values()) == pytest.approx(want[k] / sum(want.values()), abs=0.06)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.join(before, "doc_id").where(after["text"] != before["text"]).count() == 0


def test_packing_stage_places_all(stages):
    before, after = stages["best_fit_packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_stages_take_nulls_and_nothing(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(k, None if k % 7 == 3 else " ".join(random.Random(k).choices("one two three four five six seven eight".split(), k=30)), [None, "en"][k % 2], None, None) for k in range(30)] + [(None, "no id", None, None, None), (5, "", "en", "s", 0)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_run(spark):
    assert P.run(spark, SF).count() > 0 and P.ORACLE_SQL is None


def test_statistics_do_not_see_other_columns():
    import pyarrow as pa

    assert np.isfinite(qda.statistics(pa.array(["", None, "x", "A!! b"]))).all() and Words(pa.array([None])).n == 1
