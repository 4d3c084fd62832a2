"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, fertility, graphsearch, langid, mixing, packing, qda, substrings, toxicity, triejoin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: F.Column, of: int) -> F.Column:
    """crc32(doc_id as text) mod ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def op1_regularised_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = remainder(F.col("doc_id"), 3) != 1
    found = qda.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op2_bitplane_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.token_files(table(spark, sf_dir, "documents"))


def by_language(docs: DataFrame) -> DataFrame:
    """The labelled table of the mixing queries: documents whose language is known, as their domain."""
    return docs.select("doc_id", "text", F.col("lang").alias("domain"))


def op3_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.rates(docs, by_language(docs))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"))


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triejoin.jaccard_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


def op6_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    found = langid.predict(docs, langid.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graphsearch.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels").where(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", "n_hits")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_fingerprint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_regularised_qda, op2_bitplane_token_files, op3_soft_membership_mixing, op4_tokeniser_fertility, op5_prefix_tree_join, op6_marginal_unigrams, op7_robust_graph, op8_lexicon_automata, op9_pattern_packing, op10_fingerprint_runs)}


_WORDS = r"[^\x20\x09-\x0D]+"

_OP5 = f"""WITH RECURSIVE wo AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda s: array_to_string(w[s:s + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM wo)),
 si AS (SELECT wo.doc_id, count(g) AS n FROM wo LEFT JOIN sh ON wo.doc_id = sh.doc_id GROUP BY wo.doc_id),
 ov AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 li AS (SELECT a, b FROM ov JOIN si x ON x.doc_id = a JOIN si y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
 re AS (SELECT doc_id AS a, doc_id AS b FROM wo UNION SELECT re.a, li.b FROM re JOIN li ON re.b = li.a),
 co AS (SELECT a, min(b) AS c FROM re GROUP BY a), nl AS (SELECT a, count(*) AS k FROM li GROUP BY a)
 SELECT si.doc_id, si.n AS n_shingles, co.c AS component_id, coalesce(nl.k, 0) AS n_links FROM si JOIN co ON co.a = si.doc_id LEFT JOIN nl ON nl.a = si.doc_id"""

_OP10 = f"""WITH wo AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
 wi AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM wo WHERE len(w) >= 20)),
 du AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM wi) WHERE n > 1),
 re AS (SELECT DISTINCT doc_id, s + o.range AS place FROM du, range(20) o),
 po AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM wo),
 ke AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM po ANTI JOIN re USING (doc_id, place) GROUP BY doc_id)
 SELECT wo.doc_id, len(w) AS n_words, len(w) - coalesce(ke.n, 0) AS n_removed, sha256(coalesce(ke.kept, '')) AS kept_sha256 FROM wo LEFT JOIN ke ON ke.doc_id = wo.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Only the operators on sets of words can be stated in SQL. doc_ids are taken to be unique and not null there."""
    return {"op5_prefix_tree_join": _OP5, "op10_fingerprint_runs": _OP10}
