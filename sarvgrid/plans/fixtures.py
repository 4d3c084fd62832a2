"""Persian tables derived from keys of the given ones, and the same tables as DuckDB SQL.

None of the given tables holds Arabic-script text, so rules for it would never fire on them. A row's texts are picked from short
lists by its key; both sides state the picks, each in its own language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once

MARKED = ("خرید", "قیمت", "بهترین", "آموزش", "قیمت خرید", "ارزان\u200cترین", "ارزان ترین", "چیست", "ورود به سایت", "مقایسه", "ثبت نام", "فروشگاه", "در", "")
TOPICS = ("لپ تاپ", "گوشی سامسونگ", "كتاب\u200cها", "کتاب ها", "طراحی سایت", "ايرانسل", "اینترنتی", "دوربین ۱۵", "دوربین 15", "می رود", "Laptop Dell", "سَلام", "")
STATUS = ("known", "estimated", "unknown", "unknown", "bogus")
ROLE = ("pillar", "commercial", "informational", "other", "", "Blog")
SENTENCES = (
    "این کتاب در تهران با قیمت مناسب برای همه دانشجویان منتشر شد.",
    "آن روستا در استان فارس از توابع بخش مرکزی شهرستان شیراز است.",
    "این روستا در استان یزد از توابع بخش مرکزی شهرستان تفت است.",
    "برای خرید کتاب\u200cهای درسی به سایت رسمی دانشگاه تهران مراجعه کنید.",
    "ادامه مطلب...",
    "نمایش بیشتر محصولات فروشگاه ما برای شما عزیزان در این بخش است.",
    "۳ روز پیش در همین صفحه درباره این موضوع مهم نوشته بود.",
    "تماس با ما از طریق info@example.com برای همه کاربران ممکن است.",
    "سلام دنیا",
    "The quick brown fox این متن کوتاه را در باغ ما jumped over دید lazy dogs today.",
    "یک خانه بزرگ و زیبا در کنار رودخانه آرام شهر قدیمی ما",
    "گوشی Samsung با وزن ۲۰۰ گرم در بازار ایران به فروش می\u200cرود.",
    "او کتابی را که دوست داشت به دوست قدیمی خود داد.",
    "",
    "| منو | جستجو | تماس |",
    "کتابِ خوبِ من در خانه\u200cی دوست ما است.",
    "کودکان در پارک شهر با هم بازی می\u200cکنند و می\u200cخندند.",
)
TOKENS = ("کتاب", "می\u200cرود", "۱۲۳", "iPhone", "،", ".", "خانهٔ", "B2B", "_", "است")
URLS = ("https://www.digikala.com/a?b=1", "http://fa.wikipedia.org/wiki/x", "https://ISNA.ir/news/1", "https://technolife.ir/p", "not a url", "https://user@www.zoomit.ir:8080/x", "")
KINDS = ("wiki", "ecommerce", "news", "magazine", "ecommerce", "ecommerce")
LABELS = ("S-kasreh", "O", "o-x", "None", "X-weird", "", "0", "B-kasreh", "_")


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], at: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST(({at}) % {len(values)} + 1 AS INT)]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt over all cores by the first, its key. A table of keys may be one row group, whose one task would derive
    all texts; what filters the texts must stand above once(), or Spark moves it below this."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, name).select(*columns).repartition(n, columns[0])


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    words = F.array_join(F.filter(F.array(pick(MARKED, k), F.when(k % 5 == 0, pick(MARKED, F.floor(k / 3))).otherwise(""), pick(TOPICS, F.floor(k / 7))), lambda w: w != ""), " ")
    turned = F.array_join(F.filter(F.array(pick(TOPICS, F.floor(k / 7)), pick(MARKED, k)), lambda w: w != ""), "  ")
    status = pick(STATUS, F.floor(k / 11))
    return once(dealt(spark, sf_dir, "part", "p_partkey", "p_size").select(
        k.alias("ordinal"),
        F.when(k % 97 == 0, " ").when(k % 53 == 0, F.concat(F.lit("k"), k - 1)).otherwise(F.concat(F.lit("k"), k)).alias("keyword_id"),
        F.when(k % 3 == 1, turned).otherwise(words).alias("text"),
        F.when((status == "unknown") & (k % 13 > 0), None).when(k % 41 == 0, None).when(k % 43 == 0, -F.col("p_size")).otherwise(F.col("p_size")).cast("long").alias("search_demand"),
        status.alias("search_demand_status"),
    ))


KEYWORDS = f"""kw AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 97 = 0 THEN ' ' WHEN p_partkey % 53 = 0 THEN 'k' || (p_partkey - 1) ELSE 'k' || p_partkey END AS keyword_id,
 CASE WHEN p_partkey % 3 = 1 THEN array_to_string(list_filter([{sql_pick(TOPICS, 'p_partkey // 7')}, {sql_pick(MARKED, 'p_partkey')}], lambda w: w <> ''), '  ')
 ELSE array_to_string(list_filter([{sql_pick(MARKED, 'p_partkey')}, CASE WHEN p_partkey % 5 = 0 THEN {sql_pick(MARKED, 'p_partkey // 3')} ELSE '' END, {sql_pick(TOPICS, 'p_partkey // 7')}], lambda w: w <> ''), ' ') END AS text,
 {sql_pick(STATUS, 'p_partkey // 11')} AS search_demand_status,
 CAST(CASE WHEN {sql_pick(STATUS, 'p_partkey // 11')} = 'unknown' AND p_partkey % 13 > 0 THEN NULL WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN -p_size ELSE p_size END AS BIGINT) AS search_demand FROM part)"""


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    keyword = F.when(k % 19 == 0, " ").otherwise(F.concat(pick(MARKED, F.floor(k / 4)), F.lit(" "), pick(TOPICS, F.floor(k / 9)), F.lit(" "), F.floor(k / 40).cast("string")))
    return once(dealt(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        F.format_string("p%06d", k).alias("page_id"),
        F.concat(F.lit("/p/"), k).alias("url"),
        F.when(k % 3 == 0, keyword).otherwise(F.col("c_name")).alias("title"),
        F.when(k % 4 == 0, F.concat(keyword, F.lit(" ما"))).otherwise("").alias("h1"),
        keyword.alias("target_keyword"),
        F.when(k % 17 == 0, k % 3).cast("long").alias("priority"),
        pick(ROLE, F.floor(k / 2)).alias("page_role"),
        (k * 37 % 900).alias("word_count"),
        (k % 6).alias("inbound_internal_links"),
    ))


_KEYWORD = f"CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE {sql_pick(MARKED, 'c_custkey // 4')} || ' ' || {sql_pick(TOPICS, 'c_custkey // 9')} || ' ' || (c_custkey // 40) END"
PAGES = f"""pg AS (SELECT 'p' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS page_id, '/p/' || c_custkey AS url, CASE WHEN c_custkey % 3 = 0 THEN {_KEYWORD} ELSE c_name END AS title,
 CASE WHEN c_custkey % 4 = 0 THEN {_KEYWORD} || ' ما' ELSE '' END AS h1, {_KEYWORD} AS target_keyword, CAST(CASE WHEN c_custkey % 17 = 0 THEN c_custkey % 3 END AS BIGINT) AS priority,
 {sql_pick(ROLE, 'c_custkey // 2')} AS page_role, c_custkey * 37 % 900 AS word_count, c_custkey % 6 AS inbound_internal_links FROM customer)"""


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return once(dealt(spark, sf_dir, "customer", "c_custkey").select(k.alias("ordinal"), pick(SENTENCES, k * 7 + F.floor(k / 16)).alias("text"), pick(KINDS, F.floor(k / 3)).alias("kind"), pick(URLS, F.floor(k / 5)).alias("source_url")))


SENTENCE_ROWS = f"se AS (SELECT c_custkey AS ordinal, {sql_pick(SENTENCES, 'c_custkey * 7 + c_custkey // 16')} AS text, {sql_pick(KINDS, 'c_custkey // 3')} AS kind, {sql_pick(URLS, 'c_custkey // 5')} AS source_url FROM customer)"


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with gold and predicted labels, and a model's tokens that now and then differ."""
    k = F.col("o_orderkey")
    places = F.sequence(F.lit(0), (k % 6).cast("int"))
    tokens = F.transform(places, lambda i: pick(TOKENS, k + i * 3))
    model = F.transform(tokens, lambda t, i: F.when((k % 7 == 0) & (i == 0), F.concat(t, F.lit("."))).when(k % 11 == 0, F.regexp_replace(t, "\u200c", "")).when((k % 13 == 0) & (i == 0), F.concat(t, F.lit("9"))).otherwise(t))
    return once(dealt(spark, sf_dir, "orders", "o_orderkey").select(
        F.concat(F.lit("e"), k).alias("id"), tokens.alias("tokens"), model.alias("model"),
        F.transform(places, lambda i: ((k + i) % 3 == 0).cast("int")).alias("ezafe"), F.transform(places, lambda i: ((k + i * 2) % 4 == 0).cast("int")).alias("pred"),
        pick(KINDS, F.floor(k / 3)).alias("source_kind"), pick(("fa.wikipedia.org", "digikala.com", "isna.ir"), F.floor(k / 3)).alias("domain"),
        F.filter(F.array(F.when(k % 2 == 0, "zwnj").otherwise(""), F.when(k % 5 == 0, "latin_brand").otherwise("")), lambda s: s != "").alias("strata"),
    ))


SOURCES = ("digikala.com", "fa.wikipedia", "shop_mag", "fa.wikipedia.org", "", "nowhere", "isna.ir", "m.wikipedia.org")
SOURCE_KINDS = ("", "wiki", "news_portal", "", "magazine", "", "odd")


def sourced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, kinds and URLs of all sorts, and pages' sentences."""
    k = F.col("c_custkey")
    return once(dealt(spark, sf_dir, "customer", "c_custkey").select(k.alias("ordinal"), F.concat(F.lit("s"), k).alias("id"), pick(SENTENCES, k * 7 + F.floor(k / 16)).alias("text"), pick(SOURCES, k).alias("source"), pick(SOURCE_KINDS, F.floor(k / 8)).alias("source_kind"), pick(URLS, F.floor(k / 56)).alias("source_url")))


SOURCED_ROWS = f"so AS (SELECT c_custkey AS ordinal, 's' || c_custkey AS id, {sql_pick(SENTENCES, 'c_custkey * 7 + c_custkey // 16')} AS text, {sql_pick(SOURCES, 'c_custkey')} AS source, {sql_pick(SOURCE_KINDS, 'c_custkey // 8')} AS source_kind, {sql_pick(URLS, 'c_custkey // 56')} AS source_url FROM customer)"

TRUTHS = ("true", "1", '"yes"', "[0]", "false", "0", '""', "null", "[]")


def example_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of examples without spans, with values of all sorts for true and false, and with unknown keys."""
    rows = token_rows(spark, sf_dir).withColumn("k", F.substring("id", 2, 20).cast("long"))
    label = F.when(F.col("k") % 3 > 0, F.to_json("ezafe")).otherwise("null")
    value = F.concat(F.lit('{"id":"'), "id", F.lit('","text":"'), F.array_join("tokens", " "), F.lit('","tokens":'), F.to_json("tokens"), F.lit(',"ezafe":'), label, F.lit(',"verified":'), pick(TRUTHS, F.col("k")), F.lit(',"source":"'), "domain", F.lit('","dadmatools_version":"2.3","more":{"n":'), F.col("k").cast("string"), F.lit(',"s":["x",null]}}'))
    return rows.select(F.when(F.col("k") % 50 == 0, F.concat(F.lit("# "), value)).otherwise(value).alias("value"), F.col("k").alias("number"))


TOKEN_ROWS = f"""tr AS (SELECT 'e' || o_orderkey AS id, o_orderkey AS k, list_transform(range(0, o_orderkey % 6 + 1), lambda i: {sql_pick(TOKENS, 'o_orderkey + i * 3')}) AS tokens,
 list_transform(range(0, o_orderkey % 6 + 1), lambda i: CASE WHEN o_orderkey % 7 = 0 AND i = 0 THEN {sql_pick(TOKENS, 'o_orderkey + i * 3')} || '.' WHEN o_orderkey % 11 = 0 THEN replace({sql_pick(TOKENS, 'o_orderkey + i * 3')}, '\u200c', '') WHEN o_orderkey % 13 = 0 AND i = 0 THEN {sql_pick(TOKENS, 'o_orderkey + i * 3')} || '9' ELSE {sql_pick(TOKENS, 'o_orderkey + i * 3')} END) AS model,
 list_transform(range(0, o_orderkey % 6 + 1), lambda i: CAST((o_orderkey + i) % 3 = 0 AS INT)) AS ezafe, list_transform(range(0, o_orderkey % 6 + 1), lambda i: CAST((o_orderkey + i * 2) % 4 = 0 AS INT)) AS pred,
 {sql_pick(KINDS, 'o_orderkey // 3')} AS source_kind, {sql_pick(('fa.wikipedia.org', 'digikala.com', 'isna.ir'), 'o_orderkey // 3')} AS domain,
 list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'zwnj' ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN 'latin_brand' ELSE '' END], lambda s: s <> '') AS strata FROM orders)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("call_id"), F.col("ts").alias("at"), (F.col("user_id") % 50).alias("tenant_id"), F.col("event_type").alias("provider"), F.when(e % 7 == 0, "signup").alias("fallback_from"), F.round(F.coalesce("value", F.lit(0.0)), 2).cast("decimal(18,2)").alias("cost_usd"))


CALLS = "ca AS (SELECT event_id AS call_id, ts AS moment, user_id % 50 AS tenant_id, event_type AS provider, CASE WHEN event_id % 7 = 0 THEN 'signup' END AS fallback_from, CAST(round(coalesce(value, 0), 2) AS DECIMAL(18,2)) AS cost_usd FROM events)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("job_id"), (F.col("user_id") % 150).alias("site_id"), F.col("ts").alias("at"), (e % 3000).alias("approval_id"), F.concat(F.lit("key"), F.when(e % 29 == 0, e - 1).otherwise(e)).alias("idempotency_key"), F.when(e % 31 > 0, F.col("props")).alias("snapshot_before"))


JOBS = "jo AS (SELECT event_id AS job_id, user_id % 150 AS site_id, ts AS moment, event_id % 3000 AS approval_id, 'key' || CASE WHEN event_id % 29 = 0 THEN event_id - 1 ELSE event_id END AS idempotency_key, CASE WHEN event_id % 31 > 0 THEN props END AS snapshot_before FROM events)"


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("approval_id"), F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"), F.when(k % 5 > 0, "ann").alias("reviewer"), F.when(k % 7 > 0, F.col("o_orderdate")).alias("reviewed_at"))


APPROVALS = "ap AS (SELECT o_orderkey AS approval_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN o_orderkey % 5 > 0 THEN 'ann' END AS reviewer, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS reviewed_at FROM orders)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), (F.col("s_suppkey") % 3 + 1).alias("max_posts_per_day"))


SITES = "si AS (SELECT s_suppkey AS site_id, s_suppkey % 3 + 1 AS max_posts_per_day FROM supplier)"
