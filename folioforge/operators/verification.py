"""Whether a file's output holds what it should: every translation, and every original that was to stay.

Texts are compared as letters and digits in compatibility form. A text is looked for on its page; if nothing was read from
that page, in the whole file. Needles and texts meet by (file, page) in one shuffle; the needles of a page are searched
together in one walk over its text, so work is linear in both, and a task holds one page, or one file that has such a page.

Defined cases: null and blank targets are kept originals unless they were recognised (they have no text to find); needles
shorter than the least lengths are counted and never missing; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.structure import skeleton
from folioforge.sources.tables import materialise

# Least letters of a translation and of a kept original, samples and their characters.
LEAST_TARGET, LEAST_KEPT, SAMPLES, SAMPLE_CHARS = 2, 4, 3, 24
#: Needles up to which each is looked for by itself.
FEW = 8


def holds(text: str, needles: set[str]) -> set[str]:
    """Those needles that stand in the text."""
    if len(needles) <= FEW:
        return {n for n in needles if n in text}
    import ahocorasick

    a = ahocorasick.Automaton()
    for n in needles:
        a.add_word(n, n)
    a.make_automaton()
    return {n for _, n in a.iter(text)}


def found(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needles (file_id, page, id, needle; not empty) with `found`. texts: (file_id, page, hay)."""
    read = texts.where(F.coalesce(F.length("hay"), F.lit(0)) > 0)
    pages = read.select("file_id", F.col("page").alias("unit")).distinct()
    placed = needles.withColumn("unit", F.col("page")).join(pages.withColumn("_there", F.lit(True)), ["file_id", "unit"], "left")
    placed = placed.withColumn("unit", F.when(F.col("_there"), F.col("unit"))).drop("_there")  # null: the whole file
    files = placed.where("unit is null").select("file_id").distinct()
    of_text = lambda df, unit: df.select("file_id", unit.cast("int").alias("unit"), F.lit(0).alias("kind"), F.col("page").cast("long").alias("at"), F.col("hay").alias("body"), F.lit(None).cast("int").alias("page"))
    rows = of_text(read, F.col("page")).unionByName(of_text(read.join(files, "file_id", "left_semi"), F.lit(None)))
    rows = rows.unionByName(placed.select("file_id", F.col("unit").cast("int").alias("unit"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("at"), F.col("needle").alias("body"), F.col("page").cast("int").alias("page")))

    def answers(file, unit, hay: list[str], asked: list[tuple]) -> pa.RecordBatch:
        there = holds("".join(hay), {n for _, _, n in asked})
        return pa.RecordBatch.from_arrays([pa.array([file] * len(asked), pa.string()), pa.array([p for p, _, _ in asked], pa.int32()), pa.array([i for _, i, _ in asked], pa.int64()), pa.array([n in there for _, _, n in asked], pa.bool_())], names=["file_id", "page", "id", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hay, asked = None, [], []
        for b in batches:
            for file, unit, kind, at, body, page in zip(*(b.column(c).to_pylist() for c in ("file_id", "unit", "kind", "at", "body", "page")), strict=True):
                if now != (file, unit):
                    if asked:
                        yield answers(*now, hay, asked)
                    now, hay, asked = (file, unit), [], []
                if kind:
                    asked.append((page, at, body))
                else:
                    hay.append(body)
        if asked:
            yield answers(*now, hay, asked)

    return rows.repartition("file_id", "unit").sortWithinPartitions("file_id", "unit", "kind", "at").mapInArrow(run, "file_id string, page int, id long, found boolean")


def verified(paragraphs: DataFrame, pages: DataFrame, least: int = LEAST_TARGET) -> DataFrame:
    """(doc_id, checked, missing): targets (doc_id, ord, target) not found in the text of their page (doc_id, text).

    Targets with fewer letters and digits than `least` are counted as checked and never missing."""
    rows = paragraphs.where("target != ''").select(F.col("doc_id").cast("string").alias("file_id"), "doc_id", F.lit(0).alias("page"), F.col("ord").cast("long").alias("id"), skeleton(F.col("target")).alias("needle"))
    rows = materialise(rows, "needles")  # skeletons are read several times, and made once
    texts = materialise(pages.select(F.col("doc_id").cast("string").alias("file_id"), F.lit(0).alias("page"), skeleton(F.col("text")).alias("hay")), "texts")
    got = found(rows.where(F.length("needle") >= least).drop("doc_id"), texts)
    lost = got.where("NOT found").groupBy(F.col("file_id").alias("_f")).agg(F.count("*").cast("int").alias("missing"))
    counts = rows.groupBy("doc_id", "file_id").agg(F.count("*").cast("int").alias("checked"))
    return counts.join(lost, F.col("file_id") == F.col("_f"), "left").select("doc_id", "checked", F.coalesce("missing", F.lit(0)).alias("missing"))


def verified_files(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(file_id, checked, missing, samples, kept_checked, lost_original, lost_samples) of each file with paragraphs to find.

    paragraphs: file_id, page, id, text, target, translatable, from_ocr; pages: file_id, page, text (what was read back).
    samples are the first characters of the sources of the first few that are missing."""
    flat = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(" "))
    rows = paragraphs.where("translatable").withColumn("_set", F.coalesce(F.col("target"), F.lit("")) != "").where(F.col("_set") | ~F.coalesce("from_ocr", F.lit(False)))
    rows = rows.select(F.col("file_id").cast("string").alias("file_id"), F.col("page").cast("int").alias("page"), F.col("id").cast("long").alias("id"), F.col("_set").alias("is_target"), F.left(flat("text"), F.lit(SAMPLE_CHARS)).alias("sample"), skeleton(F.when(F.col("_set"), flat("target")).otherwise(flat("text"))).alias("needle"))
    asked = F.length("needle") >= F.when(F.col("is_target"), LEAST_TARGET).otherwise(LEAST_KEPT)
    rows = materialise(rows, "needles")  # skeletons are read several times, and made once
    texts = materialise(pages.select(F.col("file_id").cast("string").alias("file_id"), F.col("page").cast("int").alias("page"), skeleton(F.col("text")).alias("hay")), "texts")
    got = found(rows.where(asked).select("file_id", "page", "id", "needle"), texts)
    judged = rows.join(got, ["file_id", "page", "id"], "left").withColumn("_lost", F.coalesce(~F.col("found"), F.lit(False)))

    def first(hit: Column) -> Column:
        """The samples of the first hits: small arrays that partial aggregation keeps small."""
        return F.transform(F.slice(F.array_sort(F.collect_list(F.when(hit, F.struct("page", "id", "sample")))), 1, SAMPLES), lambda s: s["sample"])

    # only lost rows are collected; of a file's, the first few by page
    place = Window.partitionBy("file_id", "is_target").orderBy("page", "id")
    lost = judged.where("_lost").withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= SAMPLES)
    samples = lost.groupBy("file_id").agg(first(F.col("is_target")).alias("samples"), first(~F.col("is_target")).alias("lost_samples"))
    kept = ~F.col("is_target")
    counts = judged.groupBy("file_id").agg(F.count_if("is_target").alias("checked"), F.count_if(F.col("is_target") & F.col("_lost")).alias("missing"), F.count_if(kept).alias("kept_checked"), F.count_if(kept & F.col("_lost")).alias("lost_original"))
    none = F.array().cast("array<string>")
    return counts.join(samples, "file_id", "left").select("file_id", "checked", "missing", F.coalesce("samples", none).alias("samples"), "kept_checked", "lost_original", F.coalesce("lost_samples", none).alias("lost_samples"))

