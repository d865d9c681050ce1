"""Recognised text: order and merging of boxes, decoding of step-wise results, confidence, and joining to parsed paragraphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.layout import Page, by_page

# Share of the typical height that makes a row of boxes, and its least; merging of boxes.
ROW_SHARE, ROW_LEAST, NO_HEIGHT = 0.7, 6.0, 10.0
MERGE_ROW, MERGE_OVERLAP, MERGE_GAP = 12.0, 0.75, 1.6


def sorted_boxes(rows: DataFrame) -> DataFrame:
    """rows (doc_id, ord, x0, y0, x1, y1) with `place`, from 0 on each page: rows of boxes from the top, each from the left.

    Boxes are in one row whose centres round to the same multiple of a share of the page's middle height."""
    middle = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("y1") - F.col("y0"))).alias("h"))
    typical = F.get("h", F.floor(F.size("h") / 2).cast("int"))
    step = middle.select("doc_id", F.greatest(F.lit(ROW_LEAST), F.when(typical == 0, NO_HEIGHT).otherwise(typical) * ROW_SHARE).alias("_s"))
    order = Window.partitionBy("doc_id").orderBy(F.bround((F.col("y0") + F.col("y1")) / 2 / F.col("_s"), 0), "x0", "ord")
    return rows.join(step, "doc_id").withColumn("place", F.row_number().over(order) - 1).drop("_s")


def merged_boxes(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, x0, y0, x1, y1, score): boxes of one line as one, under the ord of its first piece.

    A piece joins the first line so far with which it shares most of its height and to which it is near; lines grow."""

    def run(page: Page) -> tuple[np.ndarray, Page]:
        box = np.stack([page[c].astype(float) for c in ("x0", "y0", "x1", "y1", "score")], 1)
        order = np.lexsort((page["ord"], box[:, 0], np.rint((box[:, 1] + box[:, 3]) / 2 / MERGE_ROW)))
        lines, heads = np.empty_like(box), []
        for k in order.tolist():
            b, n = box[k], len(heads)
            e = lines[:n]
            tall, mine = e[:, 3] - e[:, 1], b[3] - b[1]
            shared = np.minimum(e[:, 3], b[3]) - np.maximum(e[:, 1], b[1])
            gap = np.maximum(e[:, 0], b[0]) - np.minimum(e[:, 2], b[2])
            fits = (shared >= MERGE_OVERLAP * np.maximum(1.0, np.minimum(tall, mine))) & (gap <= np.maximum(0.0, MERGE_GAP * np.maximum(tall, mine)))
            if fits.any():
                at = int(fits.argmax())
                lines[at] = [*np.minimum(e[at, :2], b[:2]), *np.maximum(e[at, 2:], b[2:])]
            else:
                lines[n] = b
                heads.append(k)
        return np.array(heads, np.int64), {c: lines[: len(heads), j] for j, c in enumerate(("x0", "y0", "x1", "y1", "score"))}

    return by_page(run, rows.select("doc_id", "ord", "x0", "y0", "x1", "y1", "score"), ["ord"], ["ord"], "doc_id long, ord int, x0 double, y0 double, x1 double, y1 double, score double")


def decoded(steps: DataFrame, signs: DataFrame) -> DataFrame:
    """(line_id, text, confidence) of steps (line_id, step, sign, score): repeats in a row count once, sign 0 is a blank.

    signs: sign, char; signs that it does not have are left out. A line without any is empty with confidence 0."""
    before = F.lag("sign", 1, 0).over(Window.partitionBy("line_id").orderBy("step"))
    kept = steps.withColumn("_new", (F.col("sign") != 0) & (F.col("sign") != before)).join(signs, "sign", "left")
    read = F.col("_new") & F.col("char").isNotNull()
    chars = F.array_sort(F.collect_list(F.when(read, F.struct("step", "char"))))
    return kept.groupBy("line_id").agg(F.array_join(F.transform(chars, lambda x: x["char"]), "").alias("text"), F.coalesce(F.avg(F.when(read, F.col("score"))), F.lit(0.0)).alias("confidence"))


def confidence(lines: DataFrame) -> DataFrame:
    """(doc_id, paragraph, confidence): the mean of a paragraph's lines (doc_id, paragraph, confidence)."""
    return lines.groupBy("doc_id", "paragraph").agg(F.avg("confidence").alias("confidence"))


def appended(parsed: DataFrame, recognised: DataFrame, file: str = "file_id") -> DataFrame:
    """Paragraphs of both (with the columns of both), numbered anew in `id` from 0 by page, height and left edge in each file."""
    both = parsed.withColumn("from_ocr", F.lit(False)).unionByName(recognised.withColumn("from_ocr", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(file).orderBy("page", F.bround("y0", 1), "x0", "from_ocr", "id")
    return both.withColumn("id", F.row_number().over(order) - 1)


def simplified_share(glyphs: Column, sample: str) -> Column:
    """The share of the sample's characters among a font's characters (a string)."""
    return F.size(F.filter(F.split(F.lit(sample), ""), lambda c: (c != "") & F.contains(glyphs, c))) / float(len(sample))
