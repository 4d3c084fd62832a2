"""Right-to-left typography: rules, their findings, and catalogues of checks and tools.

A finding has three values: found, not found (no row) and unknown (skipped), which never counts as a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charclass import ARABIC, SPACE, WORD

# Fixed values.
CRITICAL_FIELDS = ("title", "meta_description", "h1", "slug")
CHECKS = (("fa.title.arabic_chars", "critical"), ("fa.title.zwnj", "high"), ("fa.html.lang_dir", "high"), ("fa.url.slug", "high"), ("fa.content.mt_quality", "high"), ("fa.date.jalali_schema_mismatch", "medium"), ("fa.schema.locale", "medium"), ("fa.font.rendering", "medium"), ("fa.digits.mixed", "low"), ("fa.text.missing_ezafe_kasreh", "low"))
READ_TOOLS = ("keywords.normalize", "keywords.cluster", "audit.run", "audit.persian_checks", "content.brief", "content.quality_gate", "publish.dry_run", "geo.brand_visibility")
WRITE_TOOLS, GATED_TOOLS = ("content.draft", "approvals.submit"), ("publish.apply", "publish.rollback")

VERB = "ن?می"
SPACED = rf"(?<![{WORD}{ARABIC}]){VERB} +[{ARABIC}]"
GLUED = rf"(?<![{WORD}{ARABIC}]){VERB}(?![\u200c ])[{ARABIC}]{{2,}}"


def findings(text: Column, field: Column) -> Column:
    """array<struct<code, severity, sample>> in the order of the rules; the sample is the first match."""
    persian = text.rlike(f"[{ARABIC}]")

    def rule(test: Column, code: str, severity: Column | str, sample: Column | str = "") -> Column:
        severity, sample = (F.lit(x) if isinstance(x, str) else x for x in (severity, sample))
        return F.when(test, F.struct(F.lit(code).alias("code"), severity.alias("severity"), sample.alias("sample")))

    letters = "[يكى]"
    spaced = F.regexp_extract(text, SPACED, 0)
    return F.array_compact(F.array(
        rule(text.rlike(letters), "arabic_yeh_kaf", F.when(field.isin(*CRITICAL_FIELDS), "critical").otherwise("high"), F.regexp_extract(text, letters, 0)),
        rule(text.rlike(SPACED) | text.rlike(GLUED), "zwnj_issue", "medium", F.when(spaced != "", spaced).otherwise(F.regexp_extract(text, GLUED, 0))),
        rule(persian & text.rlike("[۰-۹]") & text.rlike("[0-9]"), "mixed_digits", "medium"),
        rule(text.rlike(f"[{ARABIC}][A-Za-z]|[A-Za-z][{ARABIC}]"), "bidi_no_space", "low"),
        rule(persian & text.rlike(f"[{SPACE}][،؟!.]"), "punct_spacing", "low"),
        rule((field == "slug") & persian & ~text.contains("%"), "unencoded_persian_slug", "high"),
    ))


def audit(texts: DataFrame, key: str = "id") -> DataFrame:
    """A row for each finding of ``texts`` (key, field, text), with its place in the order of rules."""
    found = texts.select(key, "field", F.posexplode(findings(F.coalesce("text", F.lit("")), F.col("field"))).alias("place", "finding"))
    return found.select(key, "field", "place", "finding.code", "finding.severity", "finding.sample")


def checks(spark: SparkSession, severity: str | None = None) -> DataFrame:
    rows = spark.createDataFrame(list(CHECKS), "id string, severity string")
    return rows if severity is None else rows.where(F.col("severity") == severity)


def tools(spark: SparkSession) -> DataFrame:
    """name, read_only, destructive, needs_approval, idempotent. Destructive tools need approval."""
    rows = [(n, True, False, False) for n in READ_TOOLS] + [(n, False, False, False) for n in WRITE_TOOLS] + [(n, False, True, True) for n in GATED_TOOLS]
    return spark.createDataFrame(rows, "name string, read_only boolean, destructive boolean, needs_approval boolean").withColumn("idempotent", F.lit(True))


def described(tools_: DataFrame) -> DataFrame:
    """name, annotations (readOnlyHint, destructiveHint, idempotent) and requires_approval_id of each tool."""
    hints = F.struct(F.col("read_only").alias("readOnlyHint"), F.col("destructive").alias("destructiveHint"), F.lit(True).alias("idempotent"))
    return tools_.select("name", hints.alias("annotations"), F.col("needs_approval").alias("requires_approval_id"))
