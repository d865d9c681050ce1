"""Boxes in the cells and rows of tables on their page, and the room above and below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least side of a cell.
CELL_SIDE = 2.0


def table_cells(found: DataFrame) -> DataFrame:
    """(doc_id, ord, x0, y0, x1, y1): cells as a table finder reports them, of two points or more a side, those on one rounded box once (the first)."""
    sides = (F.col("x1") - F.col("x0") >= CELL_SIDE) & (F.col("y1") - F.col("y0") >= CELL_SIDE)
    box = [F.bround(F.col(c), 0).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]
    return found.where(sides).groupBy("doc_id", *box).agg(F.min(F.struct("ord", "x0", "y0", "x1", "y1")).alias("x")).select("doc_id", "x.*")


def constrained(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows (doc_id, ord, box) with `limit`: struct(kind, x0, y0, x1, y1) of the first cell of the page that holds the box's
    centre (edges included), else of the flattest row band that does, else null.

    regions: doc_id, kind (cell or row), ord, x0, y0, x1, y1. Joined on the page, so work is rows times regions of one page."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    prefer = F.when(F.col("kind") == "row", F.col("y1") - F.col("y0")).otherwise(0.0)
    there = regions.where("kind in ('cell', 'row')").select("doc_id", F.struct((F.col("kind") != "cell").alias("row"), prefer.alias("height"), F.col("ord"), "kind", "x0", "y0", "x1", "y1").alias("r"))
    inside = F.col("cx").between(F.col("r.x0"), F.col("r.x1")) & F.col("cy").between(F.col("r.y0"), F.col("r.y1"))
    held = rows.select("doc_id", "ord", cx.alias("cx"), cy.alias("cy")).join(there, "doc_id").where(inside)
    best = held.groupBy("doc_id", "ord").agg(F.min("r").alias("r"))
    return rows.join(best, ["doc_id", "ord"], "left").withColumn("limit", F.when(F.col("r").isNotNull(), F.struct("r.kind", "r.x0", "r.y0", "r.x1", "r.y1"))).drop("r")


def shared_area(rows: DataFrame, regions: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(doc_id, ord) of boxes of which a region of their page covers at least this share."""
    zero = F.lit(0.0)
    area = F.greatest(zero, F.col("x1") - F.col("x0")) * F.greatest(zero, F.col("y1") - F.col("y0"))
    r = regions.select("doc_id", *(F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    wide = F.greatest(zero, F.least("x1", "rx1") - F.greatest("x0", "rx0"))
    high = F.greatest(zero, F.least("y1", "ry1") - F.greatest("y0", "ry0"))
    return rows.withColumn("_a", area).where("_a > 0").join(r, "doc_id").where(wide * high >= F.col("_a") * ratio).select("doc_id", "ord").distinct()


def room(rows: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """rows with `above` and `below`: from a box to the nearest edge of a box of its page and column (or to top, bottom).

    Which boxes are above or below is told by their centres."""
    placed = rows.withColumn("_c", F.col("y0") + F.col("y1"))
    ranked = placed.withColumn("_k", F.dense_rank().over(Window.partitionBy("doc_id", "column").orderBy("_c")))
    by = Window.partitionBy("doc_id", "column").orderBy("_k")
    lower, upper = by.rangeBetween(1, Window.unboundedFollowing), by.rangeBetween(Window.unboundedPreceding, -1)
    below = F.least(bottom, F.coalesce(F.min("y0").over(lower), bottom)) - F.col("y1")
    above = F.col("y0") - F.greatest(top, F.coalesce(F.max("y1").over(upper), top))
    return ranked.withColumns({"below": F.greatest(F.lit(0.0), below), "above": F.greatest(F.lit(0.0), above)}).drop("_c", "_k")
