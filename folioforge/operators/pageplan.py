"""Pages as one plan: spans become lines, lines paragraphs, paragraphs get their order, columns, style, kind and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import style as S
from folioforge.functions import text as T
from folioforge.operators import corpus, layout, regions, structure
from folioforge.sources import spans as source
from folioforge.sources.tables import materialise

#: Least side of a paragraph's box; the least gap between clusters of lines, and its share of the page's width.
LEAST_SIDE, GAP, GAP_SHARE = 0.5, 15.0, 0.015


def page_key() -> Column:
    """A text that names a page (columns file_id and page); two pages never share one."""
    return F.concat(F.col("page").cast("string"), F.lit(":"), F.col("file_id"))


def line_groups(lines: DataFrame) -> DataFrame:
    """lines with `para` (a struct that names their paragraph): blocks parted at wide gaps, then where the style changes."""
    block = ("file_id", "page", "block")
    split = corpus.clusters(lines.withColumn("ord", F.col("line")), F.greatest(F.lit(GAP), F.col("width") * GAP_SHARE), block)
    runs = structure.style_runs(split, (*block, "cluster"))
    return runs.withColumn("para", F.struct("file_id", "page", "block", "cluster", "run")).drop("ord")


def _regions(found: DataFrame) -> DataFrame:
    """(file_id, page, limits, tables): the cells and rows of each page in arrays, as regions.constrained() prefers them, and its tables."""
    box = ("x0", "y0", "x1", "y1")
    cells = regions.table_cells(found.where("kind = 'cell'").select(F.struct("file_id", "page").alias("doc_id"), "ord", *box))
    each = cells.select("doc_id.file_id", "doc_id.page", F.lit("cell").alias("kind"), "ord", *box).unionByName(found.where("kind in ('row', 'table')").select("file_id", "page", "kind", "ord", *box))
    prefer = F.when(F.col("kind") == "row", F.col("y1") - F.col("y0")).otherwise(0.0)
    limit = F.struct((F.col("kind") != "cell").alias("row"), prefer.alias("height"), "ord", "kind", *box)
    return each.groupBy("file_id", "page").agg(F.collect_list(F.when(F.col("kind") != "table", limit)).alias("_limits"), F.collect_list(F.when(F.col("kind") == "table", F.struct(*box))).alias("_tables"))


def _limited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with limit and in_table, by the regions of their page."""
    zero, cx, cy = F.lit(0.0), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    area = F.greatest(zero, F.col("x1") - F.col("x0")) * F.greatest(zero, F.col("y1") - F.col("y0"))
    shared = lambda r: F.greatest(zero, F.least("x1", r["x1"]) - F.greatest("x0", r["x0"])) * F.greatest(zero, F.least("y1", r["y1"]) - F.greatest("y0", r["y0"]))
    held = F.array_min(F.filter("_limits", lambda r: cx.between(r["x0"], r["x1"]) & cy.between(r["y0"], r["y1"])))
    inside = (area > 0) & F.exists("_tables", lambda r: shared(r) >= area * 0.5)
    out = rows.join(_regions(found), ["file_id", "page"], "left").withColumns({"_r": held, "in_table": F.coalesce(inside, F.lit(False))})
    return out.withColumn("limit", F.when(F.col("_r").isNotNull(), F.struct("_r.kind", "_r.x0", "_r.y0", "_r.x1", "_r.y1"))).drop("_r", "_limits", "_tables")


def paragraphs(spans: DataFrame, pages: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row a paragraph, with id in reading order from 0 in each file: page, box, text, column, columns, size, color, font, bold,
    align, rotation, first baseline, pitch, and with regions (file_id, page, kind table, cell or row, ord, box) in_table and limit.

    Spans are shuffled by page once; lines, groups, paragraphs and their regions need no other shuffle, and what the order of a
    page needs goes with its boxes. A page's boxes are ordered in one task, as any page's must be. Texts are kept as lines."""
    grouped = line_groups(source.lines(spans, pages))
    weight = F.greatest(F.lit(1), F.length(T.clean_text(F.col("text"))))
    parts = ("y0", "line", "text", "dir_x", "dir_y", "x0", "x1", "y1", "font", "size", "color", "bold", "origin_y")
    members = F.array_sort(F.collect_list(F.struct(*parts, weight.alias("w"))))
    whole = grouped.groupBy("file_id", "page", "block", "cluster", "run").agg(members.alias("m"), F.max("width").alias("page_width"), F.max("height").alias("height"))
    of = lambda c: F.transform("m", lambda v: v[c])
    total = lambda keep: F.aggregate(F.filter("m", keep), F.lit(0), lambda acc, v: acc + v["w"].cast("int"))

    def lead(c: str) -> Column:
        """The value that most characters have, of equals the one that comes first."""
        values = F.array_distinct(of(c))
        ranked = F.transform(values, lambda v, k: F.struct(total(lambda x: x[c].eqNullSafe(v)).alias("w"), (-k).alias("k"), v.alias("v")))
        return F.array_max(ranked)["v"]

    at = F.array_sort(F.filter(of("origin_y"), lambda v: v.isNotNull() & (v != 0)))
    gaps = F.array_sort(F.filter(F.zip_with(F.slice(at, F.lit(2), F.greatest(F.lit(0), F.size(at) - 1)), F.slice(at, F.lit(1), F.greatest(F.lit(0), F.size(at) - 1)), lambda u, v: u - v), lambda g: g > 0.5))
    half = F.floor(F.size("gaps") / 2).cast("int")
    pitch = F.when(F.size("gaps") > 0, F.when(F.size("gaps") % 2 == 1, F.get("gaps", half)).otherwise((F.get("gaps", half - 1) + F.get("gaps", half)) / 2))
    rows = whole.select(
        "file_id", "page", "block", "cluster", "run", "page_width", "height", of("text").alias("lines"),
        F.array_min(of("x0")).alias("x0"), F.array_min(of("y0")).alias("y0"), F.array_max(of("x1")).alias("x1"), F.array_max(of("y1")).alias("y1"),
        (total(lambda v: v["bold"]) >= total(lambda v: F.lit(True)) * 0.5).alias("bold"), *(lead(c).alias(c) for c in ("font", "size", "color")),
        layout.aligned(F.col("m")).alias("align"), S.rotation(F.transform("m", lambda v: F.struct(v["dir_x"].alias("dx"), v["dir_y"].alias("dy")))).alias("rotation"),
        F.get(of("x0"), 0).alias("first_x0"), F.element_at(of("x1"), -1).alias("last_x1"), F.get(F.filter(of("origin_y"), lambda v: v != 0), 0).alias("first"), gaps.alias("gaps"),
    )
    rows = rows.where((F.col("x1") - F.col("x0") > LEAST_SIDE) & (F.col("y1") - F.col("y0") > LEAST_SIDE)).withColumn("pitch", pitch).drop("gaps")
    # paragraphs get a number on their page, in the order of blocks, for the operators on pages
    on_page = Window.partitionBy("file_id", "page").orderBy("block", "cluster", "run")
    placed = (rows if found is None else _limited(rows, found)).withColumn("ord", (F.row_number().over(on_page) - 1).cast("int")).drop("block", "cluster", "run").withColumn("doc_id", page_key())
    out = materialise(layout.ordered(placed), "parsed")
    in_file = Window.partitionBy("file_id").orderBy("page", "reading_ord")
    return out.withColumns({"id": F.row_number().over(in_file) - 1, "text": F.array_join("lines", "\n")}).drop("doc_id", "ord")


#: What the merging of paragraphs looks at.
MERGED = ("column", "kind", "size", "color", "bold", "x0", "y0", "x1", "y1", "first_x0", "last_x1")


def merged(rows: DataFrame) -> DataFrame:
    """Paragraphs of a file with those that go on in the next one as one: lines, text and box of all, the largest size.

    rows: as paragraphs() gives them, with kind. Ids are given anew."""
    placed = rows.withColumns({"ord": F.col("id").cast("int"), "doc_id": page_key(), **{f"_{c}": F.col(c) for c in MERGED}})
    carried = tuple(c for c in rows.columns if c not in (*MERGED, "text", "id")) + tuple(f"_{c}" for c in MERGED)
    led = layout.merged_paragraphs(placed.select("doc_id", "ord", *MERGED, *carried), "string", carried)
    # what was given stays as it was, null too; by file, as ids need it in the end
    joined = led.repartition("file_id").select("lead", F.col("ord").cast("long").alias("id"), *(F.col(f"_{c}").alias(c) for c in MERGED), *(c for c in carried if not c.startswith("_")))
    parts = F.array_sort(F.collect_list(F.struct("id", "lines")))
    first = [c for c in rows.columns if c not in ("file_id", "page", "id", "x0", "y0", "x1", "y1", "size", "lines", "text", "last_x1")]
    out = joined.groupBy("file_id", "page", "lead").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"),
        F.flatten(F.transform(parts, lambda p: p["lines"])).alias("lines"), F.max_by("last_x1", "id").alias("last_x1"), *(F.min_by(c, "id").alias(c) for c in first),
    )
    by_file = Window.partitionBy("file_id").orderBy("page", "lead")
    return out.withColumns({"id": F.row_number().over(by_file) - 1, "text": F.array_join("lines", "\n")}).drop("lead")


def kinds(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with `kind`, by the file's body size, its repeated keys (file_id, key) and the place on the page."""
    times = F.greatest(F.lit(1), F.floor(F.least(F.lit(400), F.greatest(F.lit(1), F.length("text"))) / 40)).cast("int")
    # by file while rows still lie by file: keys pass Python, after which Spark would shuffle again
    sized = rows.withColumn("_t", times).withColumn("body", F.expr("percentile(size, 0.5, _t)").over(Window.partitionBy("file_id"))).drop("_t")
    keyed = sized.withColumn("key", T.match_key(F.col("text")))
    found = materialise(repeated.select("file_id", "key", F.lit(True).alias("_r")), "repeated")
    marked = keyed.join(F.broadcast(found) if found.count() <= corpus.BROADCAST_ROWS else found, ["file_id", "key"], "left")
    n_lines = F.size(F.filter("lines", lambda x: T.clean_text(x) != ""))
    in_table = F.col("in_table") if "in_table" in rows.columns else F.lit(False)
    kind = structure.kind(F.col("text"), F.col("size"), n_lines, F.col("y0"), F.col("y1"), F.col("height"), F.coalesce("body", F.lit(10.0)), F.coalesce("_r", F.lit(False)), in_table)
    return marked.withColumn("kind", kind).drop("body", "_r", "key")


def repeated_keys(rows: DataFrame, zone_share: float = 0.25, body_share: float = 0.6) -> DataFrame:
    """(file_id, key): texts outside of tables that stand on enough pages of a file, fewer if ever in a header or footer zone."""
    outside = rows.where(~F.col("in_table")) if "in_table" in rows.columns else rows
    keyed = outside.withColumn("key", T.match_key(F.col("text"))).where(F.length("key").between(2, 300))
    zone = structure.zone(F.col("y0"), F.col("y1"), F.col("height")).isNotNull()
    seen = keyed.groupBy("file_id", "key").agg(F.countDistinct("page").alias("n"), F.bool_or(zone).alias("zone"))
    total = rows.groupBy("file_id").agg((F.max("page") + 1).alias("pages"))
    need = F.when(F.col("zone"), F.greatest(F.lit(2), F.floor(F.col("pages") * zone_share))).otherwise(F.greatest(F.lit(3), F.floor(F.col("pages") * body_share)))
    return seen.join(total, "file_id").where(F.col("n") >= need).select("file_id", "key")
