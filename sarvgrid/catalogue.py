"""Registry of the engine's queries and of DuckDB SQL that states the same results.

Arrays are shown as joined texts and counts as 64-bit integers, so both sides have plain columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import charclass as C
from .functions import text as X
from .operators import audit, backends, examples, governance, keywords, labels, pages, report, sentences
from .plans import fixtures as fx
from .plans import oracle as q
from .sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def joined(column: Column | str, by: str = " ") -> Column:
    return F.array_join(column, by)


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


# texts


@query(f"WITH {fx.KEYWORDS} SELECT ordinal, {q.analyze('text')} AS analyzed FROM kw")
def normalize_analyze(spark: SparkSession, sf: str) -> DataFrame:
    return fx.keywords(spark, sf).select("ordinal", X.analyze(F.col("text")).alias("analyzed"))


@query(f"WITH {fx.SENTENCE_ROWS} SELECT ordinal, {q.display('text')} AS shown FROM se")
def normalize_display(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sentence_rows(spark, sf).select("ordinal", X.display(F.col("text")).alias("shown"))


@query(f"WITH {fx.KEYWORDS} SELECT ordinal, translate(text, '{C.PERSIAN_DIGITS}{C.ARABIC_DIGITS}', '{C.ASCII_DIGITS * 2}') AS ascii, translate(text, '{C.ASCII_DIGITS}{C.ARABIC_DIGITS}', '{C.PERSIAN_DIGITS * 2}') AS persian FROM kw")
def digit_fold(spark: SparkSession, sf: str) -> DataFrame:
    return fx.keywords(spark, sf).select("ordinal", X.to_ascii_digits(F.col("text")).alias("ascii"), X.to_persian_digits(F.col("text")).alias("persian"))


@query(f"SELECT doc_id, {q.analyze('text')} AS analyzed FROM documents")
def analyze_documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", X.analyze(F.col("text")).alias("analyzed"))


@query(f"WITH {fx.KEYWORDS}, an AS (SELECT ordinal, {q.analyze('text')} AS a FROM kw) SELECT ordinal, {q.fingerprint(q.content('a'))} AS fingerprint, {q.fingerprint(q.content('a'), True)} AS ordered FROM an")
def keyword_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.keywords(spark, sf).select("ordinal", X.content(X.analyze(F.col("text"))).alias("c"))
    return rows.select("ordinal", X.fingerprint_of(F.col("c")).alias("fingerprint"), X.fingerprint_of(F.col("c"), True).alias("ordered"))


@query(f"WITH {fx.KEYWORDS}, an AS (SELECT ordinal, {q.analyze('text')} AS a FROM kw), fp AS (SELECT ordinal, {q.fingerprint(q.content('a'))} AS fingerprint FROM an) SELECT fingerprint, count(*) AS n, min(ordinal) AS first_ordinal FROM fp GROUP BY fingerprint HAVING count(*) > 1")
def same_keywords(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.keywords(spark, sf).select("ordinal", X.fingerprint(F.col("text")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal")).where("n > 1")


# keywords


@query(f"WITH {fx.KEYWORDS}, {q.intents()} SELECT ordinal, intent, array_to_string(fired, '|') AS phrases, array_to_string(codes, ' ') AS codes, CASE WHEN len(cats) > 1 THEN array_to_string(cats, ' ') ELSE '' END AS competing FROM it")
def intent_detect(spark: SparkSession, sf: str) -> DataFrame:
    rows = keywords.analyzed(fx.keywords(spark, sf))
    phrases = F.transform("intent_markers", lambda m: F.array_join(m["words"], " "))
    return rows.select("ordinal", "intent", joined(phrases, "|").alias("phrases"), joined("intent_reason_codes").alias("codes"), joined("competing_intent_categories").alias("competing"))


@query(f"WITH {fx.KEYWORDS}, {q.intents()} SELECT intent, count(*) AS n FROM it GROUP BY intent")
def intent_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.analyzed(fx.keywords(spark, sf)).groupBy("intent").agg(F.count("*").alias("n"))


@query(f"WITH {fx.KEYWORDS}, {q.intents()} SELECT ordinal, array_to_string(core, ' ') AS core FROM it")
def topic_core(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.analyzed(fx.keywords(spark, sf)).select("ordinal", joined("topic_core_tokens").alias("core"))


@query(f"WITH {fx.KEYWORDS}, {q.validated()} SELECT ordinal, keyword_id, coalesce(reason_code, 'ok') AS reason_code FROM va")
def keyword_validate(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.validated(fx.keywords(spark, sf)).select("ordinal", "keyword_id", F.coalesce("reason_code", F.lit("ok")).alias("reason_code"))


@query(f"WITH {fx.KEYWORDS}, {q.ranked()} SELECT topic_core_fingerprint || ':' || intent AS cluster_id, keyword_id, head_rank, fingerprint FROM ra")
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.ranked(fx.keywords(spark, sf)).select("cluster_id", "keyword_id", long("head_rank").alias("head_rank"), "fingerprint")


_DECIDED = "CASE WHEN n1 IS NULL THEN 'singleton' WHEN k1 <> n1 THEN 'search_demand_status' WHEN k2 <> n2 THEN 'search_demand' WHEN k3 <> n3 THEN 'shorter_content_tokens' WHEN k4 <> n4 THEN 'shorter_normalized_surface' ELSE 'keyword_id_tiebreak' END"


@query(f"""WITH {fx.KEYWORDS}, {q.ranked()}, he AS (SELECT topic_core_fingerprint || ':' || intent AS cluster_id, keyword_id AS head_keyword_id, text AS head_text, {_DECIDED} AS head_decided_by FROM ra WHERE head_rank = 1),
 me AS (SELECT topic_core_fingerprint || ':' || intent AS cluster_id, count(*) AS n_members, array_to_string(list(keyword_id ORDER BY head_rank > 1, keyword_id), ' ') AS members, flatten(list(codes ORDER BY head_rank > 1, keyword_id)) AS codes FROM ra GROUP BY 1)
 SELECT cluster_id, head_keyword_id, head_text, head_decided_by, n_members, members, array_to_string(list_concat(list_transform(list_filter(range(1, len(codes) + 1), lambda i: list_position(codes, codes[i]) = i), lambda i: codes[i]), CASE WHEN n_members = 1 THEN ['singleton_cluster'] ELSE [] END), ' ') AS reason_codes FROM he JOIN me USING (cluster_id)""")
def keyword_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = keywords.cluster(fx.keywords(spark, sf), member=("keyword_id",)).clusters
    return found.select("cluster_id", "head_keyword_id", "head_text", "head_decided_by", "n_members", joined(F.transform("members", lambda m: m["keyword_id"])).alias("members"), joined("reason_codes").alias("reason_codes"))


_RANK = "CASE intent " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(C.INTENTS)) + " ELSE 4 END"


@query(f"""WITH {fx.KEYWORDS}, {q.ranked()}, he AS (SELECT topic_core_fingerprint, intent, {_RANK} AS rank, array_to_string(core, ' ') AS label, count(*) OVER (PARTITION BY topic_core_fingerprint) AS keyword_count, head_rank FROM ra)
 SELECT topic_core_fingerprint, arg_min(label, rank) FILTER (head_rank = 1) AS label, max(keyword_count) AS keyword_count, count(DISTINCT intent) AS intent_count FROM he GROUP BY topic_core_fingerprint""")
def topic_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.hubs(keywords.cluster(fx.keywords(spark, sf)).clusters).select("topic_core_fingerprint", "label", long("keyword_count").alias("keyword_count"), "intent_count")


@query(f"""WITH {fx.KEYWORDS}, {q.ranked()}, cl AS (SELECT DISTINCT topic_core_fingerprint AS hub, intent FROM ra), hi AS (SELECT string_agg(intent || ':' || n, ' ' ORDER BY intent) AS intents FROM (SELECT intent, count(*) AS n FROM cl GROUP BY intent))
 SELECT (SELECT count(*) FROM kw) AS inputs, (SELECT count(*) FROM va WHERE reason_code IS NOT NULL) AS skipped, count(*) AS clusters, count(DISTINCT hub) AS hubs, CASE WHEN count(*) > 0 THEN printf('%.2f', count(*) / count(DISTINCT hub)) ELSE '—' END AS mean_intents, any_value(intents) AS intents FROM cl, hi""")
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = report.summary(fx.keywords(spark, sf))
    return found.withColumn("intents", joined(F.transform(F.map_entries("intents"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))))


_SKIP_TEXT = "CASE reason_code WHEN 'empty_keyword_id' THEN 'شناسهٔ کلیدواژه خالی است.' WHEN 'duplicate_keyword_id' THEN 'شناسهٔ کلیدواژه تکراری است؛ فقط نخستین نگه داشته شد.' WHEN 'empty_keyword_text' THEN 'متن کلیدواژه خالی است.' WHEN 'invalid_demand_status' THEN 'وضعیت حجم نامعتبر: ''' || search_demand_status || '''.' WHEN 'demand_status_conflict' THEN 'با status=unknown نباید search_demand عددی باشد.' WHEN 'missing_search_demand' THEN 'status شناخته‌شده/تخمینی نیاز به search_demand دارد.' WHEN 'negative_search_demand' THEN 'search_demand منفی مجاز نیست (۰ با known معتبر است).' WHEN 'no_content_tokens' THEN 'پس از حذف استاپ‌ورد توکن محتوایی نماند.' WHEN 'only_intent_markers' THEN 'پس از حذف نشانگر نیت توکن موضوعی نماند.' END"


@query(f"WITH {fx.KEYWORDS}, {q.validated()} SELECT keyword_id, text, reason_code, {_SKIP_TEXT} AS reason_fa FROM va WHERE reason_code IS NOT NULL")
def keyword_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.cluster(fx.keywords(spark, sf)).skipped


@query(f"""WITH {fx.SENTENCE_ROWS} SELECT ordinal, replace(replace(replace(replace(replace(text || ' <a href="x">''&amp;', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM se""")
def escape_html(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sentence_rows(spark, sf).select("ordinal", X.escape_html(F.concat("text", F.lit(' <a href="x">\'&amp;'))).alias("html"))


# pages

_ROLE = f"CASE WHEN lower(trim(page_role)) IN ({q.quoted(tuple(C.ROLES))}) THEN lower(trim(page_role)) ELSE 'other' END"
_HAS = "len({k}) > 0 AND len(list_filter({k}, lambda t: NOT list_contains(string_split({f}, ' '), t))) = 0"
_COMPETE = f"""{fx.PAGES}, pa AS (SELECT *, {_ROLE} AS role, {q.analyze('title')} AS ti, {q.analyze('h1')} AS hi, {q.analyze('target_keyword')} AS ka FROM pg WHERE trim(target_keyword) <> ''),
 pc AS (SELECT *, {q.content('ka')} AS kc FROM pa), pf AS (SELECT *, {q.fingerprint('kc')} AS fingerprint, coalesce(priority, -1000000000000) AS k1, CAST({_HAS.format(k='kc', f='ti')} AS INT) + CAST({_HAS.format(k='kc', f='hi')} AS INT) AS k2, CASE role WHEN 'pillar' THEN 3 WHEN 'commercial' THEN 2 WHEN 'informational' THEN 1 ELSE 0 END AS k3 FROM pc),
 pr AS (SELECT *, count(*) OVER (PARTITION BY fingerprint) AS n_pages, row_number() OVER w AS rank, row_number() OVER (PARTITION BY fingerprint ORDER BY k2 DESC, k3 DESC, inbound_internal_links DESC, word_count DESC, page_id DESC) AS signal,
  first_value(page_id) OVER (PARTITION BY fingerprint ORDER BY k2 DESC, k3 DESC, inbound_internal_links DESC, word_count DESC, page_id DESC) AS signal_page,
  lead(k1) OVER w AS n1, lead(k2) OVER w AS n2, lead(k3) OVER w AS n3, lead(inbound_internal_links) OVER w AS n4, lead(word_count) OVER w AS n5 FROM pf WINDOW w AS (PARTITION BY fingerprint ORDER BY k1 DESC, k2 DESC, k3 DESC, inbound_internal_links DESC, word_count DESC, page_id DESC)),
 pw AS (SELECT fingerprint, page_id AS winner_page_id, role AS winner_role, target_keyword AS keyword_sample, n_pages, CASE WHEN signal > 1 AND priority IS NOT NULL THEN 'priority_override_conflicts_signals' ELSE '' END AS reason_codes,
  CASE WHEN signal > 1 AND priority IS NOT NULL THEN 'priority صفحهٔ ' || page_id || ' را برنده کرد، در حالی که بر اساس سیگنال‌های title/h1، نقش و لینک/حجم، صفحهٔ ' || signal_page || ' برنده می‌شد. اختیار انسان حفظ شد.' ELSE '' END AS reason_fa,
  CASE WHEN k1 <> n1 THEN 'priority' WHEN k2 <> n2 THEN 'title_h1_match' WHEN k3 <> n3 THEN 'page_role' WHEN inbound_internal_links <> n4 THEN 'inbound_internal_links' WHEN word_count <> n5 THEN 'word_count' ELSE 'page_id_tiebreak' END AS decided_by FROM pr WHERE rank = 1 AND n_pages > 1)"""


@query(f"WITH {_COMPETE} SELECT fingerprint, keyword_sample, decided_by, winner_page_id, n_pages, reason_codes, reason_fa FROM pw")
def cannibal_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.competition(fx.page_targets(spark, sf)).clusters
    return found.withColumn("reason_codes", joined("reason_codes"))


@query(f"""WITH {_COMPETE}, ac AS (SELECT fingerprint, page_id, page_role, role, winner_role, word_count, winner_page_id, decided_by, CASE WHEN page_id = winner_page_id THEN 'keep' WHEN role <> winner_role THEN 'differentiate' WHEN word_count >= 500 THEN 'retarget' ELSE 'consolidate_into' END AS action FROM pr JOIN pw USING (fingerprint))
 SELECT fingerprint, page_id, action, CASE WHEN action = 'consolidate_into' THEN winner_page_id END AS consolidate_target_id,
 CASE action WHEN 'keep' THEN 'winner_by_' || decided_by WHEN 'differentiate' THEN 'loser_differentiate role_differs_from_winner' WHEN 'retarget' THEN 'loser_retarget significant_word_count_threshold word_count_gte_500' ELSE 'loser_consolidate_into significant_word_count_threshold word_count_lt_500' END
 || CASE WHEN trim(page_role) <> '' AND lower(trim(page_role)) NOT IN ({q.quoted(tuple(C.ROLES))}) THEN ' unknown_page_role' ELSE '' END AS reason_codes,
 CASE action WHEN 'keep' THEN 'برنده بر اساس معیار ' || decided_by || '.' WHEN 'differentiate' THEN 'نقش صفحه (' || role || ') با برنده (' || winner_role || ') فرق دارد؛ زاویه را جدا کنید، حذف نکنید.' WHEN 'retarget' THEN 'نقش یکسان است ولی محتوا قابل توجه است (' || word_count || ' کلمه ≥ 500)؛ کیورد هدف را عوض کنید.' ELSE 'نقش یکسان و محتوای کم (' || word_count || ' < 500)؛ ادغام/۳۰۱ به ' || winner_page_id || ' پیشنهاد می‌شود.' END AS reason_fa FROM ac""")
def cannibal_decisions(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.competition(fx.page_targets(spark, sf)).decisions
    return found.select("fingerprint", "page_id", "action", "consolidate_target_id", joined("reason_codes").alias("reason_codes"), "reason_fa")


@query(f"WITH {fx.PAGES} SELECT page_id, 'empty_target_keyword' AS reason_code FROM pg WHERE trim(target_keyword) = ''")
def cannibal_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return pages.competition(fx.page_targets(spark, sf)).skipped


_H = r"regexp_replace(html, '(?is)<{t}[^>]*>.*?</{t}>', ' ', 'g')"


def _no_blocks(html: str) -> str:
    for tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript"):
        html = q.replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return html


def _entities(text: str) -> str:
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


@query(rf"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h1, len(regexp_extract_all(html, '(?i)<a [^>]*href=\x22([^\x22]*)\x22', 1)) AS n_links FROM pages")
def html_title_h1(spark: SparkSession, sf: str) -> DataFrame:
    return pages.signals(fx.table(spark, sf, "pages")).select("page_id", "title", "h1", long(F.size("links")).alias("n_links"))


@query(f"SELECT page_id, {q.squeeze(_entities(q.replace(q.replace(q.replace('html', '(?is)<script[^>]*>.*?</script>', ' '), '(?is)<style[^>]*>.*?</style>', ' '), '(?s)<[^>]+>', ' ')))} AS plain FROM pages")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("plain"))


_PARAGRAPHS = f"""bo AS (SELECT page_id, {_no_blocks('html')} AS body FROM pages), ar AS (SELECT *, regexp_extract_all(body, '(?is)<(?:article|main)[^>]*>(.*?)</(?:article|main)>', 1) AS parts FROM bo),
 sc AS (SELECT *, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE body END AS scope FROM ar), fo AS (SELECT *, regexp_extract_all(scope, '(?is)<p[^>]*>(.*?)</p>', 1) AS i, regexp_extract_all(body, '(?is)<p[^>]*>(.*?)</p>', 1) AS o FROM sc),
 pp AS (SELECT page_id, list_filter(list_transform(CASE WHEN len(i) > 0 THEN i ELSE o END, lambda p: {q.squeeze(_entities(q.replace('p', '(?s)<[^>]+>', ' ')))}), lambda p: p <> '') AS paragraphs FROM fo)"""


@query(f"WITH {_PARAGRAPHS} SELECT page_id, len(paragraphs) AS n_paragraphs, array_to_string(paragraphs, '|') AS paragraphs, len(list_filter(string_split(array_to_string(paragraphs, ' '), ' '), lambda w: w <> '')) AS word_count FROM pp")
def html_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.signals(fx.table(spark, sf, "pages"))
    return rows.select("page_id", long(F.size("paragraphs")).alias("n_paragraphs"), joined("paragraphs", "|").alias("paragraphs"), long("word_count").alias("word_count"))


# typography

_FIELD = fx.sql_pick(("title", "body", "slug", "h1"), "ordinal")
_VERB_AT = "(^|[^\\p{L}\\p{N}_\\x{0600}-\\x{06FF}])"
_RULES = [
    ("arabic_yeh_kaf", "regexp_matches(text, '[\\x{064A}\\x{0643}\\x{0649}]')", "CASE WHEN field = 'body' THEN 'high' ELSE 'critical' END"),
    ("zwnj_issue", f"regexp_matches(text, '{_VERB_AT}ن?می +{q.A}') OR regexp_matches(text, '{_VERB_AT}ن?می{q.A}{{2,}}')", "'medium'"),
    ("mixed_digits", "regexp_matches(text, '[\\x{06F0}-\\x{06F9}]') AND regexp_matches(text, '[0-9]')", "'medium'"),
    ("bidi_no_space", f"regexp_matches(text, '{q.A}[A-Za-z]|[A-Za-z]{q.A}')", "'low'"),
    ("punct_spacing", f"regexp_matches(text, '{q.A}') AND regexp_matches(text, '\\s[،؟!.]')", "'low'"),
    ("unencoded_persian_slug", f"field = 'slug' AND regexp_matches(text, '{q.A}') AND NOT contains(text, '%')", "'high'"),
]
_AUDIT = f"{fx.KEYWORDS}, tx AS (SELECT ordinal, {_FIELD} AS field, CASE WHEN ordinal % 4 = 2 THEN replace(text, ' ', '-') ELSE text || CASE WHEN ordinal % 9 = 0 THEN ' 7 !' ELSE '' END END AS text FROM kw), au AS (" + " UNION ALL ".join(f"SELECT ordinal, field, '{c}' AS code, {s} AS severity FROM tx WHERE {t}" for c, t, s in _RULES) + ")"


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("ordinal")
    rows = fx.keywords(spark, sf).select("ordinal", fx.pick(("title", "body", "slug", "h1"), k).alias("field"), F.when(k % 4 == 2, F.replace("text", F.lit(" "), F.lit("-"))).otherwise(F.concat("text", F.when(k % 9 == 0, " 7 !").otherwise(""))).alias("text"))
    return audit.audit(rows, "ordinal")


@query(f"WITH {_AUDIT} SELECT ordinal, field, code, severity FROM au")
def rtl_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).select("ordinal", "field", "code", "severity")


@query(f"WITH {_AUDIT} SELECT code, severity, count(*) AS n FROM au GROUP BY code, severity")
def rtl_audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{s}')" for i, s in audit.CHECKS) + ") t(id, severity)")
def audit_checks(spark: SparkSession, sf: str) -> DataFrame:
    return audit.checks(spark)


@query("SELECT severity, count(*) AS n FROM (VALUES " + ", ".join(f"('{s}')" for _, s in audit.CHECKS) + ") t(severity) GROUP BY severity")
def checks_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return audit.checks(spark).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT destructive, needs_approval, count(*) AS n FROM (VALUES (false, false), (true, true)) t(destructive, needs_approval), range(10) r WHERE NOT destructive OR r.range < 2 GROUP BY ALL")
def tool_gate(spark: SparkSession, sf: str) -> DataFrame:
    return audit.tools(spark).groupBy("destructive", "needs_approval").agg(F.count("*").alias("n"))


# sentences


@query(f"WITH {fx.SENTENCE_ROWS} SELECT {q.domain('source_url')} AS domain, count(*) AS n FROM se GROUP BY 1")
def domain_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sentence_rows(spark, sf).groupBy(X.domain(F.col("source_url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.SOURCED_ROWS} SELECT ordinal, {q.source_kind('source', 'source_kind', 'source_url')} AS kind FROM so")
def source_kind(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sourced_rows(spark, sf).select("ordinal", X.source_kind(F.col("source"), F.col("source_kind"), F.col("source_url")).alias("kind"))


@query(f"WITH {fx.SOURCED_ROWS} SELECT {q.is_wikipedia('source', 'source_kind', 'source_url')} AS wikipedia, count(*) AS n FROM so GROUP BY 1")
def wiki_vs_commercial(spark: SparkSession, sf: str) -> DataFrame:
    wiki = X.is_wikipedia(F.col("source"), F.col("source_kind"), F.col("source_url"))
    return fx.sourced_rows(spark, sf).groupBy(wiki.alias("wikipedia")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.SENTENCE_ROWS}, ho AS (SELECT ordinal, {q.domain('source_url')} AS d FROM se) SELECT ordinal, d AS source FROM ho WHERE d <> '' AND d NOT IN ({q.quoted(C.BLOCKED_DOMAINS)})")
def blocked_domains(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.unblocked(fx.sentence_rows(spark, sf).select("ordinal", X.domain(F.col("source_url")).alias("source")))


@query(r"WITH sp AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '([.!?؟۔\n])[\s]+', '\1' || chr(1), 'g'), '\s+', ' ', 'g'), chr(1))) AS s FROM conversations) SELECT conv_id, turn, count(*) AS n, sum(length(trim(s)))::BIGINT AS n_chars FROM sp WHERE trim(s) <> '' GROUP BY conv_id, turn")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("long").alias("n_chars"))


@query(f"WITH {fx.SENTENCE_ROWS} SELECT ordinal, coalesce({q.rejection('text')}, 'ok') AS reason FROM se")
def sentence_reject(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sentence_rows(spark, sf).select("ordinal", F.coalesce(sentences.rejection(F.col("text")), F.lit("ok")).alias("reason"))


@query(f"WITH {fx.SENTENCE_ROWS}, re AS (SELECT {q.rejection('text')} AS reason FROM se) SELECT reason, count(*) AS n FROM re WHERE reason IS NOT NULL GROUP BY reason")
def reject_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.once(fx.sentence_rows(spark, sf).select(sentences.rejection(F.col("text")).alias("reason")))
    return rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {fx.SOURCED_ROWS}, re AS (SELECT *, {q.rejection('text')} AS reason FROM so) SELECT id, text, source, source_kind, reason FROM re WHERE reason IS NOT NULL")
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.filtered(fx.sourced_rows(spark, sf)).rejected


@query(rf"WITH {fx.SOURCED_ROWS}, ho AS (SELECT *, {q.domain('source_url')} AS host FROM so) SELECT ordinal, host FROM ho WHERE length(text) <= 220 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) BETWEEN 5 AND 15 AND length(regexp_replace(text, '[^\x{{0600}}-\x{{06FF}}]', '', 'g')) >= 8 AND NOT regexp_matches(text, '(?i)ورود|ثبت[\s\x{{200c}}]?نام|سبد خرید|اپلیکیشن|دانلود|کپی\x{{200c}}رایت|Copyright') AND (host IN ('digikala.com', 'blog.okala.com', 'okala.com', 'basalam.com', 'emalls.ir', 'torob.com', 'modiseh.com') OR regexp_matches(text, 'خرید|محصول|قیمت|دسته\x{{200c}}?بند|کالا|ارسال|گارانتی|تومان|سبد|فروشگاه|برند'))")
def shop_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.sourced_rows(spark, sf).select("ordinal", "text", X.domain(F.col("source_url")).alias("host"))
    return rows.where(sentences.shop_sentence(F.col("text"), F.col("host"))).select("ordinal", "host")


@query(r"WITH sp AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?؟۔])[\s]+', '\1' || chr(1), 'g'), '\s+', ' ', 'g'), chr(1))) AS s FROM conversations) SELECT conv_id, turn, count(*) AS n, sum(length(trim(s)))::BIGINT AS n_chars FROM sp WHERE trim(s) <> '' GROUP BY conv_id, turn")
def paragraph_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.sentences(F.col("text"), lines=False)).alias("s"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("long").alias("n_chars"))


@query(f"WITH {fx.SENTENCE_ROWS} SELECT ordinal FROM se WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) BETWEEN 5 AND 15 AND length(regexp_replace(text, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) >= 8")
def candidate_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sentence_rows(spark, sf).where(sentences.candidate(F.col("text"))).select("ordinal")


@query(f"WITH {fx.SENTENCE_ROWS} SELECT ordinal, array_to_string({q.strata('text')}, ' ') AS strata FROM se")
def strata_tags(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sentence_rows(spark, sf).select("ordinal", joined(sentences.strata(F.col("text"))).alias("strata"))


_QUOTAS = ", ".join(f"('{k}', {v})" for k, v in C.STRATA_QUOTAS.items())


@query(f"WITH {fx.SENTENCE_ROWS}, ta AS (SELECT unnest({q.strata('text')}) AS stratum FROM se), fi AS (SELECT stratum, count(*) AS filled FROM ta GROUP BY stratum) SELECT q.stratum, coalesce(filled, 0) AS filled, greatest(0, q.quota - coalesce(filled, 0))::BIGINT AS shortfall FROM (VALUES {_QUOTAS}) q(stratum, quota) LEFT JOIN fi USING (stratum)")
def strata_shortfall(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.shortfalls(fx.sentence_rows(spark, sf).select(sentences.strata(F.col("text")).alias("strata")))


@query(f"WITH {fx.SENTENCE_ROWS}, te AS (SELECT ordinal, row_number() OVER (PARTITION BY {q.template('text')} ORDER BY ordinal) AS n, {q.template('text')} AS template FROM se) SELECT ordinal, template FROM te WHERE n <= 3")
def template_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.dedupe_templates(fx.sentence_rows(spark, sf)).select("ordinal", "template")


@query(f"WITH {fx.SENTENCE_ROWS}, te AS (SELECT {q.template('text')} AS template, count(*) AS n FROM se GROUP BY 1) SELECT sum(n)::BIGINT AS n_in, sum(least(n, 3))::BIGINT AS n_out, count(*) AS n_clusters, max(n) AS largest_cluster, (sum(n) - sum(least(n, 3)))::BIGINT AS dropped FROM te")
def dedupe_report(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.template_report(fx.sentence_rows(spark, sf))


@query(f"WITH {fx.SENTENCE_ROWS} SELECT text, min(ordinal) AS ordinal FROM se GROUP BY text")
def first_text_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.first_texts(fx.sentence_rows(spark, sf)).select("text", "ordinal")


@query(f"WITH {fx.SENTENCE_ROWS} SELECT ordinal FROM se WHERE text NOT IN (SELECT text FROM se WHERE ordinal < 6)")
def anti_seen(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.sentence_rows(spark, sf)
    return sentences.unseen(rows, rows.where("ordinal < 6").select(F.col("text").alias("text"))).select("ordinal")


@query(f"""WITH {fx.SENTENCE_ROWS}, nu AS (SELECT *, row_number() OVER (PARTITION BY kind = 'wiki', kind = 'ecommerce' ORDER BY ordinal) AS n FROM se), ti AS (SELECT *, CASE WHEN kind = 'wiki' THEN 0 WHEN kind = 'ecommerce' AND n <= 40 THEN 1 WHEN kind <> 'ecommerce' THEN 2 ELSE 3 END AS tier FROM nu),
 pl AS (SELECT *, row_number() OVER (PARTITION BY tier = 0 ORDER BY tier, ordinal) AS p FROM ti) SELECT ordinal, kind, tier::BIGINT AS tier FROM pl WHERE p <= CASE WHEN tier = 0 THEN 120 ELSE 80 END""")
def quota_mix(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.quota_mix(fx.sentence_rows(spark, sf), 120, 80).select("ordinal", "kind", long("tier").alias("tier"))


def _rounds(quotas: tuple[int, ...], most: str = "NULL") -> str:
    """Rounds over the strata as a recursive CTE: a row a step, with what is used so far. ``most`` picks in the order of ``rank``, or all."""
    goal = "[" + ", ".join(map(str, quotas)) + "]"
    names = "['zwnj', 'plural_ha', 'ye_non_ezafe', 'no_ezafe_candidate', 'latin_brand', 'number_unit']"
    unmet = f"list_filter([1, 2, 3, 4, 5, 6], lambda i: filled[i] < {goal}[i])"
    return f"""na AS (SELECT unnest({names}) AS s, unnest(range(1, 7)) AS i), ca AS (SELECT list(ords ORDER BY i) AS cands FROM (SELECT i, coalesce(list(rank ORDER BY rank) FILTER (rank IS NOT NULL), []) AS ords FROM na LEFT JOIN st ON list_contains(tags, s) GROUP BY i)),
 mp AS (SELECT list(tags ORDER BY rank) AS tags_of FROM st),
 go AS (SELECT []::BIGINT[] AS used, []::VARCHAR[] AS wanted, [0, 0, 0, 0, 0, 0]::BIGINT[] AS filled, [1, 2, 3, 4, 5, 6]::BIGINT[] AS todo, 1 AS pos, 0 AS before, false AS done
  UNION ALL SELECT CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, CASE WHEN pick IS NULL THEN wanted ELSE list_append(wanted, {names}[todo[pos]]) END,
   CASE WHEN pick IS NULL THEN filled ELSE list_transform([1, 2, 3, 4, 5, 6], lambda i: filled[i] + CAST(list_contains(tags_of[pick], {names}[i]) AS BIGINT)) END,
   CASE WHEN pos > len(todo) THEN CASE WHEN len({unmet}) = 0 AND {most} IS NOT NULL THEN [1, 2, 3, 4, 5, 6] ELSE {unmet} END ELSE todo END, CASE WHEN pos > len(todo) THEN 1 ELSE pos + 1 END, CASE WHEN pos > len(todo) THEN len(used) ELSE before END,
   CASE WHEN pos > len(todo) THEN len(used) = before WHEN pick IS NULL THEN false ELSE coalesce(len(used) + 1 >= {most}, false) END
  FROM (SELECT *, CASE WHEN pos <= len(todo) THEN list_filter(cands[todo[pos]], lambda x: NOT list_contains(used, x))[1] END AS pick FROM go, ca, mp WHERE NOT done) x),
 en AS (SELECT unnest(used) AS rank, unnest(wanted) AS picked_for, unnest(range(0, len(used))) AS place FROM go WHERE done)"""


@query(f"WITH RECURSIVE {fx.SENTENCE_ROWS}, st AS (SELECT row_number() OVER (ORDER BY ordinal) AS rank, ordinal, {q.strata('text')} AS tags FROM se), {_rounds((30, 30, 25, 25, 20, 20))} SELECT ordinal, picked_for, place FROM en JOIN st USING (rank)")
def strata_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.greedy_strata(fx.sentence_rows(spark, sf).withColumn("strata", sentences.strata(F.col("text"))))


def _batch(pool: str, test: str) -> str:
    return f"""SELECT ordinal, '{pool}' AS pool, n AS place FROM (SELECT ordinal, row_number() OVER (ORDER BY coalesce(place, 1000000), rank) - 1 AS n FROM (WITH RECURSIVE st AS (SELECT row_number() OVER (ORDER BY md5('20260728:' || ordinal), ordinal) AS rank, ordinal, {q.strata('text')} AS tags FROM se WHERE {test}), {_rounds((5, 5, 4, 4, 3, 3), '25')} SELECT rank, ordinal, place FROM st LEFT JOIN en USING (rank))) WHERE n < 25"""


@query(f"WITH {fx.SENTENCE_ROWS} {_batch('wiki', "kind = 'wiki'")} UNION ALL {_batch('commercial', "kind <> 'wiki'")}")
def labelling_batch(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.labelling_batch(fx.sentence_rows(spark, sf).withColumn("strata", sentences.strata(F.col("text"))))


@query(f"""WITH RECURSIVE {fx.SENTENCE_ROWS}, kd AS (SELECT ordinal, kind = 'wiki' AS w, {q.strata('text')} AS tags, row_number() OVER (PARTITION BY kind = 'wiki' ORDER BY ordinal) AS r FROM se), st AS (SELECT row_number() OVER (ORDER BY r > CASE WHEN w THEN 120 ELSE 80 END, NOT w, ordinal) AS rank, * FROM kd), {_rounds((30, 30, 25, 25, 20, 20))},
 al AS (SELECT ordinal, w, CASE WHEN place IS NOT NULL THEN 0 WHEN w THEN 1 ELSE 2 END AS g, coalesce(place, ordinal) AS o FROM st LEFT JOIN en USING (rank)), nu AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY g, o) AS n FROM al) SELECT ordinal, CASE WHEN w THEN 'wiki' ELSE 'web' END AS kind, row_number() OVER (ORDER BY g, o) - 1 AS place FROM nu WHERE n <= CASE WHEN w THEN 120 ELSE 80 END""")
def select_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.select_corpus(fx.sentence_rows(spark, sf).withColumn("strata", sentences.strata(F.col("text"))))


# labels


@query(f"WITH {fx.TOKEN_ROWS}, ex AS (SELECT id, unnest(tokens) AS token FROM tr) SELECT token, {q.labelable('token')} AS labelable, count(*) AS n FROM ex GROUP BY token")
def token_labelable(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.token_rows(spark, sf).select(F.explode("tokens").alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n")).select("token", sentences.labelable(F.col("token")).alias("labelable"), "n")


@query(rf"WITH {fx.SENTENCE_ROWS} SELECT ordinal, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(text), '\s+'), lambda t: regexp_replace(regexp_replace(t, '^[«»\x22\x27()\[\]{{}}،,؛;:…\-_/]+', ''), '[«»\x22\x27()\[\]{{}}،,؛;:.!?؟۔…\-_/]+$', '')), lambda t: t <> ''), '|') AS tokens FROM se")
def tokenize_raw(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sentence_rows(spark, sf).select("ordinal", joined(X.raw_tokens(F.col("text")), "|").alias("tokens"))


@query(f"WITH RECURSIVE {fx.SENTENCE_ROWS}, tx AS (SELECT DISTINCT text AS k, text, {q.raw_tokens('text')} AS t FROM se), {q.spans('tx', 't')} SELECT ordinal, spans FROM se LEFT JOIN (SELECT k, spans FROM sp WHERE i = len(t)) f ON f.k = se.text")
def token_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.sentence_rows(spark, sf).select("ordinal", "text", X.raw_tokens(F.col("text")).alias("t"))
    return rows.select("ordinal", labels.spans(F.col("text"), F.col("t")).alias("s")).select("ordinal", joined(F.transform("s", lambda s: F.concat_ws("-", s["start"], s["end"]))).alias("spans"))


_ALIGNED = f"{fx.TOKEN_ROWS}, al AS (SELECT *, {q.alignment('tokens', 'model')} AS reason FROM tr)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fx.token_rows(spark, sf).select(F.substring("id", 2, 20).cast("long").alias("ordinal"), "id", F.col("domain").alias("source"), "strata", joined("tokens").alias("text"), F.col("tokens").alias("ours"), "model")


@query(f"""WITH {_ALIGNED}, ce AS (SELECT 'overall' AS dim, 'all' AS key, reason FROM al UNION ALL SELECT 'source', domain, reason FROM al UNION ALL SELECT 'reason', reason, reason FROM al UNION ALL SELECT 'stratum', unnest(CASE WHEN len(strata) > 0 THEN strata ELSE ['(none)'] END), reason FROM al)
 SELECT dim, key, count(*) AS n, count(*) FILTER (reason <> 'aligned') AS unaligned, round(count(*) FILTER (reason <> 'aligned') / count(*), 6) AS rate FROM ce GROUP BY dim, key""")
def alignment_rates(spark: SparkSession, sf: str) -> DataFrame:
    return labels.alignment_rates(_pairs(spark, sf)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_ALIGNED} SELECT count(*) AS n, count(*) FILTER (reason <> 'aligned') AS unaligned, CASE WHEN count(*) FILTER (reason <> 'aligned') / count(*) > 0.10 THEN 'switch' ELSE 'keep' END AS decision FROM al")
def contract_decision(spark: SparkSession, sf: str) -> DataFrame:
    return labels.contract(labels.alignment_rates(_pairs(spark, sf))).select("n", "unaligned", "decision")


@query(f"WITH {_ALIGNED} SELECT id, reason, array_to_string(model, ' ') AS model FROM al WHERE reason <> 'aligned' ORDER BY k LIMIT 10")
def alignment_samples(spark: SparkSession, sf: str) -> DataFrame:
    return labels.alignment_samples(_pairs(spark, sf)).select("id", "reason", joined("model").alias("model"))


@query(f"WITH RECURSIVE {fx.TOKEN_ROWS}, tx AS (SELECT k, array_to_string(tokens, ' ') AS text, tokens, model, k % 5 = 0 AS cut FROM tr), {q.spans('tx', 'model')}, ok AS (SELECT k FROM sp WHERE i = len(model)) SELECT 'e' || tx.k AS id, concat_ws(' ', CASE WHEN tokens <> model THEN 'tokens_mismatch' END, CASE WHEN ok.k IS NULL THEN 'align_failed' END, CASE WHEN ok.k IS NOT NULL AND (cut OR tokens <> model) THEN 'char_spans_mismatch' END, CASE WHEN ok.k IS NOT NULL AND cut AND len(tokens) > 1 THEN 'span_slice_mismatch@0' END) AS problems FROM tx LEFT JOIN ok ON tx.k = ok.k")
def span_verify(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.token_rows(spark, sf).select("id", joined("tokens").alias("text"), "tokens", "model")
    given = labels.spans(F.col("text"), F.col("tokens"))
    cut = F.transform(given, lambda s, i: F.when(i == 0, F.struct(s["start"].alias("start"), (s["end"] + 1).alias("end"))).otherwise(s))
    rows = rows.withColumn("char_spans", F.when(F.substring("id", 2, 20).cast("long") % 5 == 0, cut).otherwise(given))
    return labels.verified(rows).select("id", joined("problems").alias("problems"))


@query(f"WITH {fx.SOURCED_ROWS}, ok AS (SELECT *, {q.raw_tokens('text')} AS t FROM so WHERE {q.rejection('text')} IS NULL) SELECT id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens, array_to_string({q.strata('text')}, ' ') AS strata, false AS verified FROM ok WHERE len(t) BETWEEN 5 AND 20")
def made_examples(spark: SparkSession, sf: str) -> DataFrame:
    made = examples.make(fx.sourced_rows(spark, sf))
    return made.select("id", long(F.size("tokens")).alias("n_tokens"), joined("tokens", "|").alias("tokens"), joined("strata").alias("strata"), "verified")


@query(rf"WITH {fx.SOURCED_ROWS}, ho AS (SELECT id, CASE WHEN {q.domain('source_url')} <> '' THEN {q.domain('source_url')} ELSE source END AS h, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM so WHERE source_kind IN ('wiki', 'magazine')) SELECT id, CASE WHEN contains(h, 'wikipedia') THEN 'fa.wikipedia.org' ELSE h END AS source, len(w) AS n_tokens, 'dadmatools' AS tokenizer_source, '1.0' AS version, false AS verified FROM ho")
def reminted(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.sourced_rows(spark, sf).where("source_kind IN ('wiki', 'magazine')").withColumns({"ezafe": F.array(F.lit(1)), "verified": F.lit(True)})
    found = examples.remint(rows, F.filter(F.split("text", f"[{C.SPACE}]+"), lambda t: t != ""), "1.0")
    return found.where("ezafe IS NULL AND tokens_minted_at LIKE '20__-__-__T%+00:00' AND size(char_spans) = size(tokens)").select("id", "source", long(F.size("tokens")).alias("n_tokens"), "tokenizer_source", F.col("dadmatools_version").alias("version"), "verified")


_MIGRATED = f"{fx.SOURCED_ROWS}, wi AS (SELECT *, {q.is_wikipedia('source', 'source_kind', 'source_url')} AS w, {q.domain('source_url')} AS h FROM so)"


@query(f"WITH {_MIGRATED}, na AS (SELECT *, w OR (h <> '' AND h <> 'technolife.ir') AS stays, CASE WHEN h <> '' THEN h WHEN source <> '' THEN source ELSE '?' END AS d FROM wi) SELECT 'before' AS stage, d AS domain, count(*) AS n FROM na WHERE NOT w GROUP BY d UNION ALL SELECT 'after', d, count(*) FROM na WHERE stays AND NOT w GROUP BY d UNION ALL SELECT 'dropped', d, count(*) FROM na WHERE NOT stays GROUP BY d")
def migrated_domains(spark: SparkSession, sf: str) -> DataFrame:
    return examples.migrate(fx.sourced_rows(spark, sf)).counts


@query(f"WITH {_MIGRATED} SELECT id, CASE WHEN w THEN 'fa.wikipedia.org' ELSE h END AS source, CASE WHEN w THEN 'wiki' ELSE {q.source_kind('source', 'source_kind', 'source_url')} END AS source_kind FROM wi WHERE w OR (h <> '' AND h <> 'technolife.ir')")
def migrated_sources(spark: SparkSession, sf: str) -> DataFrame:
    return examples.migrate(fx.sourced_rows(spark, sf)).rows.select("id", "source", "source_kind")


@query(f"WITH {fx.SOURCED_ROWS} SELECT ordinal, CASE WHEN ordinal % 4 = 0 THEN 'other-' || ordinal ELSE id END AS id FROM so")
def id_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.sourced_rows(spark, sf).select("ordinal", "id", F.concat(F.lit("other-"), "ordinal").alias("other_id"))
    return examples.unused_ids(rows, rows.where("ordinal % 4 = 0").select("id"))


@query(rf"WITH {fx.SENTENCE_ROWS}, wo AS (SELECT ordinal, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM se) SELECT ordinal, array_to_string(list_transform(w, lambda t: CAST(ends_with(t, 'ِ') OR ends_with(t, 'ه{C.ZWNJ}ی') AS INT)), ' ') AS flags FROM wo")
def positional_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.sentence_rows(spark, sf).select("ordinal", F.filter(F.split("text", f"[{C.SPACE}]+"), lambda t: t != "").alias("tokens"), backends.marks(F.col("text")).alias("m"))
    return rows.select("ordinal", joined(F.transform(examples.predicted(F.col("tokens"), F.col("m")), lambda x: x.cast("string"))).alias("flags"))


@query(f"""WITH {fx.TOKEN_ROWS} SELECT id, k % 9 < 4 AS verified, len(tokens) AS n_tokens, (list_sum(list_transform(tokens, lambda t: length(t))) + len(tokens) - 1)::BIGINT AS last_end, CASE WHEN k % 3 > 0 THEN array_to_string(ezafe, ' ') END AS labels, CASE domain WHEN 'digikala.com' THEN 'ecommerce' WHEN 'isna.ir' THEN 'news' ELSE 'wiki' END AS source_kind, '2.3' AS version, '{{"more":{{"n":' || k || ',"s":["x",null]}}}}' AS extra FROM tr WHERE k % 50 > 0""")
def examples_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines decoded, encoded and decoded again."""
    once = files.decode(fx.example_lines(spark, sf))
    again = files.decode(files.encode(once).withColumn("number", F.lit(0).cast("long")))
    return again.select("id", "verified", long(F.size("tokens")).alias("n_tokens"), long(F.element_at("char_spans", -1)["end"]).alias("last_end"), joined(F.transform("ezafe", lambda x: x.cast("string"))).alias("labels"), "source_kind", F.col("dadmatools_version").alias("version"), "extra")


_METRICS = f"""WITH {fx.TOKEN_ROWS}, ce AS (SELECT id, source_kind, domain, strata, list_filter(list_transform(range(1, len(tokens) + 1), lambda i: {{'t': tokens[i], 'g': ezafe[i], 'p': pred[i]}}), lambda c: {q.labelable('c.t')}) AS cells FROM tr),
 pe AS (SELECT *, len(cells) AS n, len(list_filter(cells, lambda c: c.g = 1 AND c.p = 1)) AS tp, len(list_filter(cells, lambda c: c.g = 0 AND c.p = 1)) AS fp, len(list_filter(cells, lambda c: c.g = 0 AND c.p = 0)) AS tn, len(list_filter(cells, lambda c: c.g = 1 AND c.p = 0)) AS fn FROM ce WHERE len(cells) > 0),
 sl AS (SELECT 'overall' AS dim, 'all' AS key, n, tp, fp, tn, fn FROM pe UNION ALL SELECT 'source', CASE WHEN source_kind = 'wiki' THEN 'wikipedia' ELSE 'commercial' END, n, tp, fp, tn, fn FROM pe UNION ALL SELECT 'source', 'domain:' || domain, n, tp, fp, tn, fn FROM pe
  UNION ALL SELECT 'stratum', unnest(CASE WHEN len(strata) > 0 THEN strata ELSE ['(none)'] END), n, tp, fp, tn, fn FROM pe),
 ag AS (SELECT dim, key, count(*) AS n_examples, sum(n)::BIGINT AS n_tokens, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn FROM sl GROUP BY dim, key)"""


@query(f"""{_METRICS}
 SELECT dim, key, CASE WHEN n_examples >= 20 THEN 'ok' ELSE 'insufficient_sample' END AS status, n_examples, n_tokens, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, CASE WHEN tp > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM ag""")
def metrics_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.token_rows(spark, sf)
    found = labels.evaluate(rows.select("id", "source_kind", "domain", "strata", "tokens", "ezafe"), rows.select("id", "pred"))
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""{_METRICS} SELECT dim, key, CASE WHEN n_examples < 2000 THEN dim || ' ' || key || ' insufficient_sample' ELSE printf('%s %s: examples=%d tokens=%d tp=%d fp=%d tn=%d fn=%d precision=%s recall=%s f1=%s', dim, key, n_examples, n_tokens, tp, fp, tn, fn, CASE WHEN tp + fp > 0 THEN printf('%.4f', tp / (tp + fp)) ELSE 'n/a' END, CASE WHEN tp + fn > 0 THEN printf('%.4f', tp / (tp + fn)) ELSE 'n/a' END, CASE WHEN tp > 0 THEN printf('%.4f', 2.0 * tp / (2 * tp + fp + fn)) ELSE 'n/a' END) END AS line FROM ag""")
def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the report; slices of fewer than 2 000 examples are told to be too small."""
    rows = fx.token_rows(spark, sf)
    return labels.report(labels.evaluate(rows, rows.select("id", "pred"), 2000))


@query(f"WITH {fx.TOKEN_ROWS} SELECT k AS ordinal, id, count(*) + 1 AS n_rows, count(*) FILTER ({q.labelable('t')}) AS n_labelable FROM (SELECT k, id, unnest(tokens) AS t FROM tr) GROUP BY k, id")
def worksheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.token_rows(spark, sf).select(F.substring("id", 2, 20).cast("long").alias("ordinal"), "id", joined("tokens").alias("text"), "tokens")
    return labels.worksheet(rows).groupBy("ordinal", "id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("labelable") == "1").alias("n_labelable"))


@query(f"""WITH {fx.TOKEN_ROWS}, ce AS (SELECT id, unnest(range(1, len(tokens) + 1)) AS i, tokens FROM tr) SELECT id, '' AS token_index, array_to_string(tokens, ' ') AS token, '' AS labelable, '' AS ezafe, '' AS ambiguous FROM tr
 UNION ALL SELECT id, CAST(i - 1 AS VARCHAR), tokens[i], CASE WHEN {q.labelable('tokens[i]')} THEN '1' ELSE '0' END, CASE WHEN {q.labelable('tokens[i]')} THEN '' ELSE '-' END, '' FROM ce""")
def worksheet_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.token_rows(spark, sf).select(F.substring("id", 2, 20).cast("long").alias("ordinal"), "id", joined("tokens").alias("text"), "tokens")
    return labels.worksheet(rows).select("id", "token_index", "token", "labelable", "ezafe", "ambiguous")


@query(f"WITH {fx.TOKEN_ROWS} SELECT id, array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN {q.labelable('tokens[i]')} THEN ezafe[i] ELSE 0 END), ' ') AS ezafe, 'ok' AS error FROM tr WHERE k % 10 > 0 UNION ALL SELECT id, NULL, 'token_text' FROM tr WHERE k % 10 = 0")
def worksheet_ingest(spark: SparkSession, sf: str) -> DataFrame:
    base = fx.token_rows(spark, sf).select("id", "tokens", "ezafe", (F.substring("id", 2, 20).cast("long") % 10 == 0).alias("bad"))
    cells = base.select("id", "bad", F.posexplode(F.arrays_zip("tokens", "ezafe")).alias("i", "c"))
    token, fits = F.col("c.tokens"), sentences.labelable(F.col("c.tokens"))
    sheet = cells.select("id", F.col("i").cast("string").alias("token_index"), F.when(F.col("bad") & (F.col("i") == 0), F.concat(token, F.lit("?"))).otherwise(token).alias("token"), F.when(fits, "1").otherwise("0").alias("labelable"), F.when(fits, F.col("c.ezafe").cast("string")).otherwise("-").alias("ezafe"), F.lit("").alias("ambiguous"))
    got = labels.ingest(sheet, base, "ann")
    return got.labelled.select("id", joined(F.transform("ezafe", lambda x: x.cast("string"))).alias("ezafe"), F.lit("ok").alias("error")).unionByName(got.errors.select("id", F.lit(None).cast("string").alias("ezafe"), "error"))


@query("SELECT coalesce(n.doc_id, o.doc_id) AS id, CASE WHEN n.doc_id IS NOT NULL THEN n.quality ELSE o.quality END AS quality FROM (SELECT * FROM labels WHERE doc_id % 3 < 2) o FULL JOIN (SELECT doc_id, 1 - quality AS quality FROM labels WHERE doc_id % 3 > 0) n USING (doc_id)")
def label_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return labels.upsert(rows.where("id % 3 < 2"), rows.where("id % 3 > 0").select("id", (1 - F.col("quality")).alias("quality")))


@query(f"WITH la AS (SELECT o_orderkey AS id, {fx.sql_pick(fx.LABELS, 'o_orderkey')} AS label FROM orders) SELECT id, NOT (lower(trim(label)) IN ({q.quoted(C.OUTSIDE_LABELS)}) OR starts_with(lower(trim(label)), 'o-')) AS positive FROM la")
def label_parse(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.positive_label(fx.pick(fx.LABELS, F.col("o_orderkey"))).alias("positive"))


@query(f"WITH {fx.SENTENCE_ROWS}, wo AS (SELECT ordinal AS id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS token FROM se) SELECT id, token FROM wo WHERE ends_with(token, 'ِ') OR ends_with(token, 'ه\u200cی')")
def ezafe_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.sentence_rows(spark, sf).select(F.col("ordinal").alias("id"), "text")
    return backends.audit(rows, enabled=True).where("NOT skipped").select("id", "token")


# governance


@query(f"WITH {fx.JOBS}, {fx.APPROVALS}, ju AS (SELECT jo.*, a.approval_id IS NULL AS bad, row_number() OVER (PARTITION BY idempotency_key ORDER BY job_id) > 1 AS again FROM jo LEFT JOIN (SELECT DISTINCT approval_id FROM ap WHERE status = 'approved') a ON jo.approval_id = a.approval_id) SELECT job_id, 'not_approved' AS rule FROM ju WHERE bad UNION ALL SELECT job_id, 'no_snapshot' FROM ju WHERE snapshot_before IS NULL UNION ALL SELECT job_id, 'idempotency_key_reused' FROM ju WHERE again")
def gate_publish(spark: SparkSession, sf: str) -> DataFrame:
    return governance.publish_violations(fx.jobs(spark, sf), fx.approvals(spark, sf))


@query(f"WITH {fx.APPROVALS}, dr AS (SELECT c_custkey AS draft_id, c_custkey % 3 = 0 AS has_unique_asset, CASE WHEN c_custkey % 2 = 0 THEN 'chart' END AS unique_asset_kind FROM customer) SELECT draft_id AS id, 'unique_asset_kind' AS rule FROM dr WHERE NOT (has_unique_asset = false OR unique_asset_kind IS NOT NULL) UNION ALL SELECT approval_id, 'reviewed' FROM ap WHERE NOT (status = 'pending' OR (reviewer IS NOT NULL AND reviewed_at IS NOT NULL))")
def gate_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    drafts = fx.table(spark, sf, "customer").select(k.alias("draft_id"), (k % 3 == 0).alias("has_unique_asset"), F.when(k % 2 == 0, "chart").alias("unique_asset_kind"))
    return governance.check_violations(drafts, fx.approvals(spark, sf))


@query(f"WITH {fx.JOBS}, {fx.SITES}, ra AS (SELECT job_id, jo.site_id, max_posts_per_day, row_number() OVER (PARTITION BY jo.site_id, CAST(moment AS DATE) ORDER BY moment, job_id) AS place FROM jo JOIN si USING (site_id)) SELECT job_id, site_id, place FROM ra WHERE place > max_posts_per_day")
def gate_throttle(spark: SparkSession, sf: str) -> DataFrame:
    return governance.over_throttle(fx.jobs(spark, sf), fx.sites(spark, sf)).withColumn("place", long("place"))


@query(f"WITH {fx.JOBS}, {fx.SITES} SELECT job_id, site_id FROM jo WHERE site_id IS NOT NULL AND site_id NOT IN (SELECT site_id FROM si)")
def fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return governance.orphans(fx.jobs(spark, sf).select("job_id", "site_id"), "site_id", fx.sites(spark, sf), "site_id")


@query(f"WITH {fx.CALLS} SELECT call_id, tenant_id, CAST(sum(cost_usd) OVER (PARTITION BY tenant_id, date_trunc('month', moment) ORDER BY moment, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS spent FROM ca")
def llm_spend_running(spark: SparkSession, sf: str) -> DataFrame:
    return governance.running_spend(fx.calls(spark, sf)).select("call_id", "tenant_id", F.col("spent").cast("double").alias("spent"))


@query(f"WITH {fx.CALLS}, su AS (SELECT *, sum(cost_usd) OVER (PARTITION BY tenant_id, date_trunc('month', moment) ORDER BY moment, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent, row_number() OVER (PARTITION BY tenant_id, date_trunc('month', moment) ORDER BY moment, call_id) AS n FROM ca) SELECT tenant_id, strftime(moment, '%Y-%m') AS month, arg_min(call_id, n) AS call_id, CAST(min(spent) AS DOUBLE) AS spent FROM su WHERE spent > 50 GROUP BY 1, 2")
def llm_first_breach(spark: SparkSession, sf: str) -> DataFrame:
    return governance.first_breach(fx.calls(spark, sf), 50).withColumn("spent", F.col("spent").cast("double"))


@query(f"WITH {fx.CALLS} SELECT provider, count(*) AS calls, count(fallback_from) AS fallbacks, round(count(fallback_from) / count(*), 6) AS fallback_share, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM ca GROUP BY provider")
def llm_fallback_rate(spark: SparkSession, sf: str) -> DataFrame:
    return governance.fallback_rate(fx.calls(spark, sf)).withColumns({"fallback_share": F.round("fallback_share", 6), "cost_usd": F.col("cost_usd").cast("double")})


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extra(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


def entry(spark: SparkSession) -> DataFrame:
    """Clusters of keywords by topic and intent, from the smallest tables."""
    return keyword_clusters(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
