"""What the boxes of a page are: zones and kinds, runs of style, paragraphs of recognised lines, tables, neighbours.

`doc_id` names a page (or block), which bounds every group here; null geometry joins nothing and empty tables give
empty tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

# Shares of a page's height and of sizes, and counts, that tell what a paragraph is.
HEADER, FOOTER, HALF, TITLE, TITLE_LINES, TITLE_CHARS = 0.08, 0.90, 0.5, 1.18, 3, 120
RUNS, HEADING_LINES, HEADING_WIDTH = (2, 4), 3, 0.72
SCAN_CHARS, SCAN_IMAGE = 40, 0.35
PITCH, HEIGHT_PITCH, ONE_LINE_PITCH, OVERLAP, SHORT, HEIGHT_CHANGE, SHIFT = 1.35, 1.25, 1.4, 0.45, 0.68, 0.35, 0.9
RULE, RULE_SHARE, STRAIGHT, RULES = 30.0, 0.06, 2.0, 3


def zone(y0: Column, y1: Column, page_height: Column) -> Column:
    """header, footer or null: whether a box lies wholly in the upper or lower edge of its page."""
    return F.when(y1 <= page_height * HEADER, "header").when(y0 >= page_height * FOOTER, "footer")


def kind(text: Column, size: Column, n_lines: Column, y0: Column, y1: Column, page_height: Column, body_size: Column, repeated: Column, in_table: Column) -> Column:
    """text, title, header, footer or page_num. A place at the edge alone makes no header: its text must be repeated.

    Text in tables is never a header, as column titles are repeated too. Null flags are false."""
    at = zone(y0, y1, page_height)
    title = (body_size > 0) & (size >= body_size * TITLE) & (n_lines <= TITLE_LINES) & (F.length(T.clean_text(text)) <= TITLE_CHARS)
    running = F.coalesce(at, F.when(y1 <= page_height * HALF, "header").otherwise("footer"))
    outside = ~F.coalesce(in_table, F.lit(False))
    return F.when(outside & at.isNotNull() & T.is_page_number(text), "page_num").when(outside & repeated, running).when(title, "title").otherwise("text")


def needs_recognition(chars: Column, image_share: Column) -> Column:
    """struct(needed, why): a page with hardly any text is a scan if images cover enough of it; nulls count as 0."""
    chars, share = F.coalesce(chars, F.lit(0)), F.coalesce(image_share, F.lit(0.0))
    why = F.when(chars >= SCAN_CHARS, "text").when(share >= SCAN_IMAGE, "scan").when(chars == 0, "blank").otherwise("few images")
    return F.struct((why == "scan").alias("needed"), why.alias("why"))


def style_runs(rows: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows (doc_id, ord, x0, y0, x1, bold, font, size: the lines of blocks) with `run`, from 0 in each block.

    A block is parted where the style changes if that gives two to four runs, neighbours differ in weight or size, and one
    of each two looks like a heading: few lines, none of them wide. Else all its lines are run 0. by: columns that name the
    block; all steps are windows over it, so rows that lie together by some of them are not shuffled."""
    block = Window.partitionBy(*by)
    order = block.orderBy("y0", "ord")
    style = F.struct("bold", "font", "size")
    fresh = F.coalesce((~style.eqNullSafe(F.lag(style).over(order)) & F.lag(F.lit(1)).over(order).isNotNull()).cast("int"), F.lit(0))
    marked = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of_run = Window.partitionBy(*by, "_run")
    wide = F.col("x1") - F.col("x0")
    runs = marked.withColumns({"_n": F.count("*").over(of_run), "_wide": F.max(wide).over(of_run), "_widest": F.max(wide).over(block)})
    heading = (F.col("_n") <= HEADING_LINES) & (F.col("_wide") <= F.when(F.col("_widest") == 0, 1.0).otherwise(F.col("_widest")) * HEADING_WIDTH)
    judged = runs.withColumn("_heading", heading)
    before = {c: F.lag(c).over(order) for c in ("bold", "size", "_heading")}  # a run's first line against the last of the run before
    changed = ~F.col("bold").eqNullSafe(before["bold"]) | ~F.col("size").eqNullSafe(before["size"])
    judged = judged.withColumn("_good", (F.col("_fresh") == 0) | (changed & (F.col("_heading") | before["_heading"])))
    parted = (F.max("_run").over(block) + 1).between(*RUNS) & F.bool_and("_good").over(block)
    return judged.withColumn("run", F.when(parted, F.col("_run")).otherwise(0)).drop("_fresh", "_run", "_n", "_wide", "_widest", "_heading", "_good")


def _ranked(values: Column, share: float, back: int = 0) -> Column:
    """The value at a share of a sorted array: an element, never a mean of two."""
    n = F.size(values)
    return F.get(values, F.greatest(F.lit(0), F.least(n - 1, F.floor(n * F.lit(share)).cast("int") - back)))


def recognised_paragraphs(rows: DataFrame) -> DataFrame:
    """rows (doc_id, ord, x0, y0, x1, y1: recognised lines in order) with `paragraph`, from 0 on each page.

    A paragraph ends where the pitch grows or turns back, the next line lies aside, its height is unusual, its left edge
    shifts, or the line before is short of the usual width. The usual pitch is a low one, as one within paragraphs."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    high, wide = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")), F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))
    middle = (F.col("y0") + F.col("y1")) / 2
    lined = rows.withColumns({"_pitch": middle - F.lag(middle).over(order), "_high": high, "_wide": wide, "_px0": F.lag("x0").over(order), "_px1": F.lag("x1").over(order)})
    sorted_of = lambda c: F.array_sort(F.collect_list(c))  # noqa: E731  of one page, once
    usual = lined.groupBy("doc_id").agg(sorted_of(F.col("_high")).alias("hs"), sorted_of(F.col("_wide")).alias("ws"), sorted_of(F.when(F.col("_pitch") > 1, F.col("_pitch"))).alias("ps"))
    usual = usual.select(F.col("doc_id").alias("_page"), _ranked(F.col("hs"), 0.5).alias("_h"), _ranked(F.col("ws"), 0.85).alias("_w"), _ranked(F.col("ps"), 0.25, 1).alias("_p"))
    framed = lined.join(usual, F.col("doc_id").eqNullSafe(F.col("_page")))
    base = F.greatest(F.coalesce(F.col("_p"), F.col("_h") * ONE_LINE_PITCH) * PITCH, F.col("_h") * HEIGHT_PITCH)
    before = F.col("_px1") - F.col("_px0")
    shared = F.least("_px1", "x1") - F.greatest("_px0", "x0")
    goes_on = (
        (F.col("_pitch") > 0)
        & (F.col("_pitch") <= base)
        & (shared / F.greatest(F.lit(1.0), F.least(before, F.col("x1") - F.col("x0"))) >= OVERLAP)
        & (F.abs(F.col("y1") - F.col("y0") - F.col("_h")) <= F.col("_h") * HEIGHT_CHANGE)
        & (before >= F.col("_w") * SHORT)
        & (F.abs(F.col("x0") - F.col("_px0")) <= F.col("_h") * SHIFT)
    )
    fresh = framed.withColumn("_fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    number = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return fresh.withColumn("paragraph", number).select(*rows.columns, "paragraph")


def rules(drawings: DataFrame, page_width: float) -> DataFrame:
    """(doc_id, across, x0, y0, x1, y1): long straight lines ('l') and edges of long rectangles ('re') of drawings."""
    least = max(RULE, RULE_SHARE * page_width)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    left, right, top, bottom = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    line, rect = F.col("kind") == "l", F.col("kind") == "re"
    flat = line & (bottom - top < STRAIGHT) & (right - left >= least)
    steep = line & ~flat & (right - left < STRAIGHT) & (bottom - top >= least)
    wide, tall = rect & (x1 - x0 >= least), rect & (y1 - y0 >= least)

    def edge(hit: Column, across: bool, a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.when(hit, F.struct(F.lit(across).alias("across"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))

    edges = F.array(edge(flat, True, left, y0, right, y0), edge(steep, False, x0, top, x0, bottom), edge(wide, True, x0, y0, x1, y0), edge(wide, True, x0, y1, x1, y1), edge(tall, False, x0, y0, x0, y1), edge(tall, False, x1, y0, x1, y1))
    return drawings.select("doc_id", F.explode(F.array_compact(edges)).alias("e")).select("doc_id", "e.*")


def table_regions(rules: DataFrame) -> DataFrame:
    """(doc_id, x0, y0, x1, y1): the box around the rules of pages with at least three."""
    box = rules.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return box.where(F.col("n") >= RULES).drop("n")


def baselines(rows: DataFrame) -> DataFrame:
    """(doc_id, first, pitch) of the baselines (doc_id, ord, y) of upright paragraphs; pitch is null without two lines."""
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("doc_id").orderBy("y"))
    gaps = rows.where("y is not null and y != 0").withColumn("gap", gap)
    return gaps.groupBy("doc_id").agg(F.min_by("y", "ord").alias("first"), F.median(F.when(F.col("gap") > 0.5, F.col("gap"))).alias("pitch"))


def _neighbours(rows: DataFrame, hit: Column, tolerance: float) -> DataFrame:
    """rows with `_near`: the other boxes of the page that hold `hit` and lie on the box by more than a tolerance on both axes, in order."""
    box = ("ord", "x0", "y0", "x1", "y1")
    others = rows.where(hit).select(F.col("doc_id").alias("_p"), F.struct(*box).alias("b"))
    wide, high = F.least(F.col("b.x1"), F.col("x1")) - F.greatest(F.col("b.x0"), F.col("x0")), F.least(F.col("b.y1"), F.col("y1")) - F.greatest(F.col("b.y0"), F.col("y0"))
    met = rows.select("doc_id", *box).join(others, F.col("doc_id").eqNullSafe(F.col("_p"))).where((F.col("b.ord") != F.col("ord")) & (wide > tolerance) & (high > tolerance))
    near = met.groupBy(F.col("doc_id").alias("_p"), F.col("ord").alias("_o")).agg(F.array_sort(F.collect_set("b")).alias("_near"))
    return rows.join(near, F.col("doc_id").eqNullSafe(F.col("_p")) & (F.col("ord") == F.col("_o")), "left").drop("_p", "_o")


def overlaps_any(rows: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """rows (doc_id, ord, x0, y0, x1, y1, text) with `overlaps`: whether another box with text lies on it on both axes."""
    return _neighbours(rows, T.clean_text(F.col("text")) != "", tolerance).withColumn("overlaps", F.col("_near").isNotNull()).drop("_near")


def erase_box(rows: DataFrame) -> DataFrame:
    """rows (doc_id, ord, x0, y0, x1, y1, text, target) with `erase`: the box drawn in from neighbours that keep their text.

    Neighbours are taken in order, each on the axis on which less is lost; a box that would vanish stays whole."""
    whole = F.struct("x0", "y0", "x1", "y1")

    def draw_in(r: Column, b: Column) -> Column:
        wide, high = F.least(r["x1"], b["x1"]) - F.greatest(r["x0"], b["x0"]), F.least(r["y1"], b["y1"]) - F.greatest(r["y0"], b["y0"])
        hit = (b["ord"] != F.col("ord")) & (wide > 0.3) & (high > 0.3)
        upright, lower, righter = wide >= high, b["y0"] > r["y0"], b["x0"] > r["x0"]
        return F.struct(
            F.when(hit & ~upright & ~righter, F.greatest(r["x0"], b["x1"])).otherwise(r["x0"]).alias("x0"),
            F.when(hit & upright & ~lower, F.greatest(r["y0"], b["y1"])).otherwise(r["y0"]).alias("y0"),
            F.when(hit & ~upright & righter, F.least(r["x1"], b["x0"])).otherwise(r["x1"]).alias("x1"),
            F.when(hit & upright & lower, F.least(r["y1"], b["y0"])).otherwise(r["y1"]).alias("y1"),
        )

    keeps = (T.clean_text(F.col("text")) != "") & (F.coalesce(F.col("target"), F.lit("")) == "")
    drawn = _neighbours(rows, keeps, 0.3).withColumn("_e", F.coalesce(F.aggregate("_near", whole, draw_in), whole)).drop("_near")
    gone = (F.col("_e.x1") - F.col("_e.x0") < 1) | (F.col("_e.y1") - F.col("_e.y0") < 1)
    return drawn.withColumn("erase", F.when(gone, whole).otherwise(F.col("_e"))).drop("_e")


def room_in_constraint(room: Column, extent: Column, available: Column) -> Column:
    """The height that may be used: at most the room in the cell or row, which only counts if it exceeds the box's own."""
    return F.when(room > F.greatest(F.lit(4.0), extent), F.least(available, room)).otherwise(available)


def skeleton(c: Column) -> Column:
    """Letters and digits alone, in compatibility form: what must be found again whatever symbols were replaced."""
    return F.regexp_replace(T.compatible(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


# What is translated, and what a document holds

#: Reasons by kind for paragraphs at the edge of pages; kinds of those that are not text.
EDGE = {"header": "header", "footer": "footer", "page_num": "page_num"}


def marked(rows: DataFrame, target: str = "zh", skip_edges: bool = True, skip_other: bool = True) -> DataFrame:
    """rows (text, kind) with kind, translatable and skip_reason ('' for none), the first reason that holds: blank text (kind
    empty), headers, footers and page numbers, code and what is not text (kind code), text in the target language.

    Null kinds are text. The two flags let the edges, or all but blanks and edges, be translated as well."""
    flat = T.clean_text(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(" ")))
    kind = F.coalesce("kind", F.lit("text"))
    reason = F.when(F.col("_t") == "", "empty")
    if skip_edges:
        for k, why in EDGE.items():
            reason = reason.when(kind == k, why)
    if skip_other:
        reason = T.why_not(F.col("_t"), target, reason)
    out = rows.withColumn("_t", flat).withColumn("skip_reason", F.coalesce(reason, F.lit(""))).drop("_t")
    changed = F.when(F.col("skip_reason") == "empty", "empty").when(F.col("skip_reason").isin("code", "not_translatable"), "code").when(kind == "empty", "text").otherwise(kind)
    return out.withColumns({"translatable": F.col("skip_reason") == "", "kind": changed})


def in_pages(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """marked rows (file_id, page) of which those on no wanted page (file_id, page) are left alone, with that as their reason.

    A file that is not named in `wanted` is wanted whole."""
    named = wanted.select("file_id", F.lit(True).alias("_named")).distinct()
    there = wanted.select("file_id", "page", F.lit(True).alias("_there")).distinct()
    out = rows.join(named, "file_id", "left").join(there, ["file_id", "page"], "left")
    gone = F.col("translatable") & F.col("_named").isNotNull() & F.col("_there").isNull()
    return out.withColumns({"skip_reason": F.when(gone, "page_range").otherwise(F.col("skip_reason")), "translatable": F.col("translatable") & ~gone}).drop("_named", "_there")


def document_statistics(rows: DataFrame, pages: DataFrame, warnings: DataFrame) -> DataFrame:
    """(file_id, pages, paragraphs, translatable, characters, kinds, columns, body_size, from_ocr, ocr_pages, warnings) of each
    file with pages; kinds is a map from kind to count, body_size the median of the sizes of translatable paragraphs.

    rows: marked paragraphs (file_id, page, kind, text, size, columns, translatable, from_ocr); warnings: file_id, page, warning."""
    sent, ocr = F.col("translatable"), F.coalesce("from_ocr", F.lit(False))
    by_kind = rows.groupBy("file_id", "kind").agg(F.count("*").alias("n")).groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    counts = rows.groupBy("file_id").agg(
        F.count("*").alias("paragraphs"), F.count_if(sent).alias("translatable"), F.sum(F.when(sent, F.length(T.clean_text(F.col("text")))).otherwise(0)).cast("bigint").alias("characters"),
        F.max("columns").alias("columns"), F.round(F.expr("percentile(case when translatable then size end, 0.5)"), 1).alias("body_size"), F.count_if(ocr).alias("from_ocr"), F.countDistinct(F.when(ocr, F.col("page"))).alias("ocr_pages"),
    )
    told = warnings.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "warning"))), lambda w: w["warning"]).alias("warnings"))
    total = pages.groupBy("file_id").agg(F.count("*").alias("pages"))
    out = total.join(counts, "file_id", "left").join(by_kind, "file_id", "left").join(told, "file_id", "left")
    zero = lambda c, v=0: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("file_id", "pages", zero("paragraphs"), zero("translatable"), zero("characters"), F.coalesce("kinds", F.create_map().cast("map<string,bigint>")).alias("kinds"), zero("columns", 1), zero("body_size", 0.0), zero("from_ocr"), zero("ocr_pages"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
