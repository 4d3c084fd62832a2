"""Readers and writers of keyword files, labelled examples and worksheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.charclass import SPACE
from ..functions.text import once
from ..operators import labels

EXAMPLE = "id string, text string, tokens array<string>, char_spans array<array<int>>, ezafe array<int>, note string, verified boolean, ambiguous boolean, strata array<string>, source string, source_kind string, source_url string, license string, collected_at string, page_title string, revision_id string, labeled_by string, labeled_at string, tokenizer_source string, dadmatools_version string, tokens_minted_at string"
FIELDS = tuple(f.split()[0] for f in EXAMPLE.split(", "))
WORKSHEET = ("id", "token_index", "token", "labelable", "ezafe", "ambiguous")
REQUIRED = ("id", "token_index", "token", "ezafe")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 1 in its file), ordinal (from 0 over all files, in order of their names), value of each line of text files.

    Lines are counted by blocks of files: only a row a block meets in one place, and no line is shuffled for its number.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("n").over(before.orderBy("file", "block")), F.lit(0))).withColumn("_own", F.coalesce(F.sum("n").over(own), F.lit(0))).drop("n")
    nth = F.col("at") - F.col("first")
    return lines.join(blocks, ["file", "block"]).select("file", "block", (F.col("_own") + nth + 1).alias("number"), (F.col("_before") + nth).alias("ordinal"), "value")


def keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, keyword_id, text of a keyword file: ``text``, or ``id<TAB>text``; # starts a comment. Lines without an id are
    numbered k001, k002, ... by themselves."""
    lines = numbered_lines(spark, path).withColumnRenamed("value", "line")
    lines = lines.where(~F.ltrim("line").startswith("#")).where((X.squeeze(F.col("line")) != "") | F.col("line").contains("\t"))
    bare = ~F.col("line").contains("\t")
    # numbers run on over blocks: each block's lines are counted by themselves, then blocks
    blocks = lines.groupBy("file", "block").agg(F.count_if(bare).alias("n"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    so_far = Window.partitionBy("file", "block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("_nth", F.sum(bare.cast("long")).over(so_far)).join(blocks, ["file", "block"])
    pair = F.split("line", "\t", 2)
    return lines.select("ordinal", F.when(bare, F.format_string("k%03d", F.col("_before") + F.col("_nth"))).otherwise(X.squeeze(pair[0])).alias("keyword_id"), F.when(bare, X.squeeze(F.col("line"))).otherwise(X.squeeze(F.get(pair, 1))).alias("text"))


def _truth(field: Column) -> Column:
    """What counts as true of a JSON value: true, numbers but 0, texts and lists that aren't empty."""
    kind, text = F.schema_of_variant(field), field.cast("string")
    return F.coalesce(F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}")).when(kind != "VOID", text.cast("double") != 0), F.lit(False))


def problem() -> Column:
    """Why a decoded row is no example, or null."""
    n, spans = F.size("tokens"), F.col("char_spans")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    start, end = (lambda i: F.get(spans, i)["start"]), (lambda i: F.get(spans, i)["end"])
    whole = F.forall(places, lambda i: F.coalesce((start(i) >= 0) & (start(i) < end(i)) & (end(i) <= F.length("text")), F.lit(False)))
    same = F.forall(places, lambda i: F.substring(F.col("text"), start(i) + 1, end(i) - start(i)) == F.get("tokens", i))
    return (
        F.when(F.col("id").isNull() | F.col("text").isNull() | F.col("tokens").isNull(), "id, text or tokens missing")
        .when(n == 0, "tokens must be non-empty")
        .when(spans.isNull(), "tokens not found in the text")
        .when(F.size(spans) != n, "as many char_spans as tokens are needed")
        .when(~whole, "bad char_span")
        .when(~same, "char_span text differs from its token")
        .when(F.col("ezafe").isNotNull() & (F.size("ezafe") != n), "as many labels as tokens are needed")
        .when(F.exists(F.coalesce("ezafe", F.array().cast("array<int>")), lambda v: ~F.coalesce(v.isin(0, 1), F.lit(False))), "labels must be 0 or 1")
        .when(F.col("source_kind").isNull(), "source_kind can't be resolved")
    )


def decode(lines: DataFrame) -> DataFrame:
    """Examples of JSON lines (value, number and other columns): FIELDS and ``extra``, the unknown keys as a JSON object.

    Blank lines and those that start with # are left out. Missing spans are found from the tokens, kinds of sources are resolved. The
    first rule that a line breaks ends the job, with the line's number.
    """
    # lines may be made by what is costly, as those of encode() are: each is made once
    lines = once(lines.select("value", "number")).where(F.col("value").rlike(f"^[{SPACE}]*[^#{SPACE}]"))
    rows = once(lines.select("value", "number", F.try_parse_json("value").alias("_v")))
    is_object = F.col("_v").isNotNull() & F.col("value").rlike(r"^[ \t\r\n]*\{")

    def get(name: str, kind: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", kind)

    def field(name: str) -> Column:
        return F.coalesce(get(name, "string"), F.lit(""))

    given = F.transform(get("char_spans", "array<array<int>>"), lambda s: F.struct(s[0].alias("start"), s[1].alias("end")))
    special = {"id": get("id", "string"), "text": get("text", "string"), "tokens": get("tokens", "array<string>"), "char_spans": given, "ezafe": get("ezafe", "array<int>"), "verified": get("verified", "variant"), "ambiguous": get("ambiguous", "variant"), "strata": F.coalesce(get("strata", "array<string>"), F.array().cast("array<string>"))}
    extra = F.to_json(F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, _: ~k.isin(*FIELDS)))
    rows = once(rows.select("_v", "number", is_object.alias("_object"), *(special.get(n, field(n)).alias(n) for n in FIELDS), extra.alias("extra")))
    told = {"char_spans": F.coalesce("char_spans", labels.spans(F.col("text"), F.col("tokens"))), "verified": _truth(F.col("verified")), "ambiguous": _truth(F.col("ambiguous")), "source_kind": X.source_kind(F.col("source"), F.col("source_kind"), F.col("source_url"))}
    rows = once(rows.withColumns(told))
    unread = F.col("ezafe").isNull() & F.coalesce(F.schema_of_variant(get("ezafe", "variant")) != "VOID", F.lit(False))
    wrong = F.when(~F.col("_object"), "not a JSON object").when(unread, "labels must be 0 or 1").otherwise(problem())
    said = F.concat(F.lit("line "), F.col("number").cast("string"), F.lit(": not an example: "), F.coalesce("id", F.lit("")), F.lit(" "), wrong)
    return rows.withColumn("_ok", F.when(wrong.isNotNull(), F.raise_error(said)).otherwise(True)).where("_ok").select(*FIELDS, "extra")


def labelled_only(rows: DataFrame) -> DataFrame:
    return rows.where("verified AND ezafe IS NOT NULL AND NOT coalesce(ambiguous, false)")


def examples(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """Examples of JSON-lines files; with ``labelled`` those with labels that are verified and not ambiguous.

    A missing path, a file without examples and, with ``labelled``, one without labels are errors at once; a line that is no example is
    one when it is read.
    """
    rows = decode(numbered_lines(spark, path))
    if rows.limit(1).count() == 0:
        raise ValueError(f"{path} has no examples")
    if not labelled:
        return rows
    rows = labelled_only(rows)
    if rows.limit(1).count() == 0:
        raise ValueError(f"{path} has no verified, unambiguous labelled examples")
    return rows


def encode(rows: DataFrame) -> DataFrame:
    """A JSON object a row (value): FIELDS in their order, null labels included, then the keys of ``extra``, which win over a field's."""
    spans = F.transform("char_spans", lambda s: F.array(s["start"], s["end"]))
    kinds = dict(f.split(" ", 1) for f in EXAMPLE.split(", "))
    fields = [spans.alias(n) if n == "char_spans" else F.col(n).alias(n) if n in rows.columns else F.lit(None).cast(kinds[n]).alias(n) for n in FIELDS]
    known = F.from_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), "map<string,variant>")
    extra = F.coalesce(F.from_json(F.col("extra") if "extra" in rows.columns else F.lit("{}"), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    # both maps are read once a row: named in a lambda, extra would be read again for each field
    both = once(rows.select(known.alias("_known"), extra.alias("_extra"))).select("_known", "_extra", F.map_keys("_extra").alias("_own"))
    return both.select(F.to_json(F.map_concat(F.map_filter("_known", lambda k, _: ~F.array_contains("_own", k)), "_extra"), {"ignoreNullFields": "false"}).alias("value"))


def write_examples(rows: DataFrame, path: str) -> None:
    """JSON lines, in the order of ``rows``; characters beyond ASCII stay as they are."""
    encode(rows).write.mode("overwrite").text(path)


def worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a worksheet, all text; the byte-order mark of the first header is Spark's to drop."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"the worksheet has no {', '.join(missing)}")
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in WORKSHEET))


def write_worksheet(rows: DataFrame, path: str) -> int:
    """CSV with a byte-order mark before the first header, for spreadsheets; rows in order of ordinal and place. Returns their number,
    sentence headers included."""
    ordered = rows.orderBy("ordinal", "place").select(F.col("id").alias("﻿id"), *WORKSHEET[1:])
    ordered.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return rows.count()


def write_report(report: DataFrame, path: str) -> None:
    """The one JSON object of a report (operators.report) as a text file."""
    report.coalesce(1).write.mode("overwrite").text(path)
