"""Documents as bilingual text, one row a document; writing the rows is left to DataFrameWriter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.sources import store

# Labels of the formats.
PAGE, SOURCE, TARGET, UNTRANSLATED = "## 第 {} 页", "**原文**：", "**译文**：", "未翻译"
SKIPPED = ("header", "footer", "page_num")


def _flat(c: Column) -> Column:
    return T.clean_text(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))


def paragraphs_of(rows: DataFrame) -> DataFrame:
    """(doc_id, items) of paragraphs (doc_id, ord, page, kind, text, target, reason), in order."""
    item = F.struct("ord", "page", "kind", _flat(F.col("text")).alias("source"), _flat(F.col("target")).alias("target"), "reason")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def _paged(items: Column, heading: Column, block) -> Column:
    """Blocks of items joined by blank lines, a heading (text with {}) before the first of each page."""
    def one(x: Column, k: Column) -> Column:
        fresh = (k == 0) | (x["page"] != F.get(items, k - 1)["page"])
        return F.concat(F.when(fresh, F.concat(F.replace(heading, F.lit("{}"), (x["page"] + 1).cast("string")), F.lit("\n\n"))).otherwise(""), block(x))

    return F.concat(F.array_join(F.transform(items, one), "\n\n"), F.lit("\n"))


def markdown(rows: DataFrame, bilingual: bool = True) -> DataFrame:
    """(doc_id, markdown): without headers, footers, page numbers and blanks; code without a target is fenced."""
    shown = F.filter("items", lambda x: ~F.coalesce(x["kind"].isin(*SKIPPED), F.lit(False)) & ((x["source"] != "") | (x["target"] != "")))

    def block(x: Column) -> Column:
        target = F.when(x["target"] != "", x["target"]).otherwise(F.concat(F.lit("（"), F.coalesce(x["reason"], F.lit(UNTRANSLATED)), F.lit("）")))
        both = F.concat(F.lit(SOURCE), x["source"], F.lit("\n\n" + TARGET), target)
        plain = both if bilingual else F.when(x["target"] != "", x["target"]).otherwise(x["source"])
        return F.when((x["kind"] == "code") & (x["target"] == ""), F.concat(F.lit("```\n"), x["source"], F.lit("\n```"))).otherwise(plain)

    kept = paragraphs_of(rows).select("doc_id", shown.alias("items"))
    return kept.select("doc_id", _paged(F.col("items"), F.lit(PAGE), block).alias("markdown"))


def plain_text(rows: DataFrame) -> DataFrame:
    """(doc_id, text): the targets alone, by page; code has none."""
    shown = F.filter("items", lambda x: ~F.coalesce(x["kind"].isin(*SKIPPED, "code"), F.lit(False)) & (x["target"] != ""))
    kept = paragraphs_of(rows).select("doc_id", shown.alias("items"))
    return kept.select("doc_id", _paged(F.col("items"), F.lit("===== 第 {} 页 ====="), lambda x: x["target"]).alias("text"))


def segments(rows: DataFrame) -> DataFrame:
    """One row a paragraph, for DataFrameWriter.json: doc_id, id, page (from 1), kind, source, target ('' for none), reason, and where rows have them bbox (two decimals) and error."""
    flat = rows.select("doc_id", F.col("ord").alias("id"), (F.col("page") + 1).alias("page"), "kind", _flat(F.col("text")).alias("source"), _flat(F.col("target")).alias("target"), F.coalesce("reason", F.lit("")).alias("skip_reason"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("error",) if c in rows.columns), *(F.transform(c, lambda v: F.round(v, 2)).alias(c) for c in ("bbox",) if c in rows.columns))
    return flat.withColumn("translatable", F.col("skip_reason").isin("", "translatable"))


#: Settings that a file of segments names, and counts of a run (see sources.store.run_statistics).
SETTINGS = ("provider", "model", "target_lang", "mode")


COUNTS = ("paragraphs", "translated", "failed", "skipped", "tokens", "cache_hits", "retries", "numeric_mismatched")


def flat_type(flat: DataFrame) -> str:
    """The type of an array of segments."""
    return "array<struct<" + ",".join(f"{c}:{t}" for c, t in sorted(flat.dtypes, key=lambda x: x[0] != "id") if c != "doc_id") + ">>"


def segment_documents(rows: DataFrame, documents: DataFrame, generated: str) -> DataFrame:
    """(doc_id, document): a JSON text a document, with a header, the run's counts and all segments in order.

    rows: as for segments(), with tokens, cached, retries and numbers_missing where known; documents: doc_id, filename and
    the SETTINGS where known. A document without rows has no segments and counts of 0."""
    flat = segments(rows)
    parts = F.array_sort(F.collect_list(F.struct("id", *(c for c in flat.columns if c not in ("doc_id", "id")))))
    listed = flat.groupBy("doc_id").agg(parts.alias("segments"))
    known = {"tokens": "bigint", "cached": "boolean", "retries": "int", "numbers_missing": "int"}
    there = rows.withColumns({c: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)) if c in rows.columns else F.lit(0).cast(t) for c, t in known.items()})
    judged = there.withColumn("translatable", F.coalesce("reason", F.lit("")).isin("", "translatable"))
    counts = store.run_statistics(judged, "doc_id").select("doc_id", F.struct(*(c for c in COUNTS)).alias("stats"))
    setting = F.struct(*(F.col(c).cast("string").alias(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in SETTINGS))
    none = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in COUNTS))
    whole = documents.join(listed, "doc_id", "left").join(counts, "doc_id", "left")
    body = F.struct("filename", F.lit(generated).alias("generated"), setting.alias("config"), F.coalesce("stats", none).alias("stats"), F.coalesce("segments", F.array().cast(flat_type(flat))).alias("segments"))
    return whole.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def write_lines(documents: DataFrame, path: str) -> None:
    """Documents (doc_id, document) as JSON lines, one a document with its doc_id first, in as many files as there are tasks.

    For a corpus: a file for each document costs more in names and commits than in bytes."""
    key = F.to_json(F.struct("doc_id"), {"ignoreNullFields": "false"})
    documents.select(F.concat(F.left(key, F.length(key) - 1), F.lit(","), F.substring("document", 2, 2**31 - 1)).alias("value")).write.text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """A folder doc_id=... with one file for each document (doc_id, document). Existing documents are replaced, others stay."""
    spark = documents.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        documents.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("doc_id").text(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
