"""The plan of a page: where and in which size each translation is set, alone or below its source, and what is erased."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from folioforge.functions import text as T
from folioforge.operators import frames, regions, setting, structure
from folioforge.sources.tables import materialise

# Least margin of a page in points and its share of the height, the gap between source and translation in
# ems, least room of a line and of a column, the part of an upright box's height that lines may take.
MARGIN, MARGIN_SHARE = 12.0, 0.02
DUAL_GAP, LEAST_ROOM, LEAST_HEIGHT, UPRIGHT_SHARE = 0.30, 8.0, 4.0, 0.98
#: The height of a face above the baseline in ems (a metric of the face, so an input), and the most tracking in ems.
ASCENT, TRACKING = 0.88, 0.08
#: What rows may have besides, and what stands for it: the first baseline, the alignment, the origins of the source's lines
#: and their direction.
MORE = {"first": "double", "align": "string", "starts": "array<struct<x:double,y:double>>", "dir_x": "double", "dir_y": "double"}


def limits(rows: DataFrame) -> DataFrame:
    """rows with `turn` (0, 90, 180, 270), `line_room` (length of a line), `free` (blank space where the text goes on) and
    `height_room` (height that lines may take, within the limit of its cell or row), and whether that limit `clamped` it.

    rows: doc_id, ord, column, x0, y0, x1, y1, rotation, height (of the page), limit (struct of regions.constrained)."""
    margin = F.greatest(F.lit(MARGIN), F.col("height") * MARGIN_SHARE)
    placed = regions.room(rows, margin, F.col("height") - margin)
    turn = F.pmod(F.bround(F.coalesce("rotation", F.lit(0.0)) / 90.0, 0) * 90, F.lit(360)).cast("int")
    placed = placed.withColumn("turn", turn)
    upright, flipped = F.col("turn").isin(90, 270), F.col("turn") == 180
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    free = F.when(upright, 0.0).when(flipped, F.col("above")).otherwise(F.col("below"))
    most = F.when(upright, F.greatest(F.lit(LEAST_HEIGHT), wide)).otherwise(high + free)
    box_room = F.when(upright, F.col("limit.x1") - F.col("x0")).when(flipped, F.col("y1") - F.col("limit.y0")).otherwise(F.col("limit.y1") - F.col("y0"))
    within = structure.room_in_constraint(F.coalesce(box_room, F.lit(0.0)), F.when(upright, wide).otherwise(high), most)
    room = F.when(upright, F.greatest(F.lit(LEAST_ROOM), high) * UPRIGHT_SHARE).otherwise(F.greatest(F.lit(LEAST_ROOM), wide))
    return placed.withColumns({"line_room": room, "free": free, "height_room": within, "clamped": within < most, "_most": most}).drop("above", "below")


_KINDS = {"number": ST.DoubleType(), "numbers": ST.ArrayType(ST.DoubleType()), "texts": ST.ArrayType(ST.StringType()), "flag": ST.BooleanType()}
#: What a paragraph's two settings are.
SIZED = {
    "mono_size": "number", "mono_lines": "texts", "mono_widths": "numbers", "mono_tracking": "numbers", "mono_step": "number", "mono_needs": "number", "fits": "flag",
    "dual_size": "number", "dual_lines": "texts", "dual_widths": "numbers", "dual_needs": "number", "source_lines": "texts", "source_ems": "numbers",
}


def _both(text: str | None, target: str, size: float, room: float, height: float, most: float, pitch: float | None, align: str | None, first: float | None, turn: int, smallest: float, spacing: float, scale: float, gap: float, track: float, dual: bool) -> tuple:
    """The values of SIZED for one paragraph: the translation alone, and with `dual` below its source (nulls where that does not fit)."""
    largest = max(smallest, size * scale)
    pitch = pitch or 0.0
    whole = cache(lambda: setting.Setting(target))  # measured once for both, and only if asked for
    size, lines, ems, fits = setting.measured_fit(target, room, height, largest, smallest, spacing, pitch, whole=whole)
    one = size * spacing
    step = min(max(pitch, one), 1.8 * one) if pitch > 0 else one
    tracks = setting.tracking(lines, size, room, align or "left", track if turn == 0 and first is not None else 0.0, ems=ems)
    widths = [size * w + t * max(0, len(x) - 1) for x, w, t in zip(lines, ems, tracks, strict=True)]
    mono = (size, lines, widths, tracks, step, one + (len(lines) - 1) * step, fits)
    if not dual:
        return *mono, None, None, None, None, None, None
    source = [s for s in (x.strip() for x in (text or "").split("\n")) if s] or [""]
    source_ems = [setting.measured(x) for x in source]
    # source and translation share one size: the source's lines and the gap take a fixed part of each size's height
    taken = len(source) + gap / spacing
    def needs(s: float, stop: float = math.inf) -> float:
        return (taken + max(1, whole().count(room / s, stop))) * s * spacing

    enough = lambda s: (most + setting.SPARE) / (s * spacing) - taken + 2  # noqa: E731  as many lines are too high
    found = setting.largest_size(smallest, largest, lambda s: needs(s, enough(s)) <= most + setting.SPARE)
    if found is None:
        return *mono, None, None, None, None, source, source_ems
    both, both_ems = whole().set(whole().lines(room / found))
    return *mono, found, both, [found * w for w in both_ems], needs(found), source, source_ems


def _sized(rows: DataFrame, smallest: float, spacing: float, scale: float, gap: float, track: float, dual: bool) -> DataFrame:
    """rows with the columns of SIZED. All other columns pass through the batch as they are."""
    columns = ["text", "target", "size", "line_room", "height_room", "_most", "pitch", "align", "first", "turn"]
    schema = ST.StructType([*rows.schema.fields, *(ST.StructField(n, _KINDS[k]) for n, k in SIZED.items())])
    arrow = {"number": pa.float64(), "numbers": pa.list_(pa.float64()), "texts": pa.list_(pa.string()), "flag": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_both(*r, smallest, spacing, scale, gap, track, dual) for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            made = zip(*got, strict=True) if got else ([] for _ in SIZED)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, arrow[k]) for k, v in zip(SIZED.values(), made, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def plan(rows: DataFrame, dual: bool = False, smallest: float = 5.0, spacing: float = 1.05, scale: float = 1.0, dual_gap: float = 1.0, ascent: float = ASCENT, track: float = TRACKING) -> DataFrame:
    """One row a paragraph with a translation: doc_id, ord, mode (mono, dual or fallback), turn, size, lines, source_lines,
    box, target_y0 (where the translation starts), erase (struct), clamped (cell, row or null), overflow, step (between
    baselines), tracking (a number a line), widths, source_widths, align, skip (what stands before the translation) and frame.

    Upright text alone begins on the source's first baseline, with lines at the source's pitch; turned text has the frame of
    its source's lines. Both keep the source's place whatever their size.

    rows: doc_id, ord, column, x0, y0, x1, y1, text, target, size, rotation, height, pitch, limit. Paragraphs without a
    translation are not set but keep their place free. With `dual` source and translation are set below each other in one
    size; where they do not fit, or would lie on another paragraph, the translation is set alone (fallback). A text that
    does not even fit alone in the smallest size overflows and is kept whole."""
    clean = lambda c: T.clean_text(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in MORE.items() if c not in rows.columns})
    placed = structure.erase_box(limits(rows))
    set_ = placed.withColumn("target", clean("target")).where("target != ''").withColumn("size", F.coalesce("size", F.lit(10.0)))
    sized = _sized(set_, smallest, spacing, scale, DUAL_GAP * dual_gap, track, dual)
    high = F.col("y1") - F.col("y0")
    flipped = F.col("turn") == 180

    def spread(needs: Column) -> tuple[Column, Column]:
        tall = F.greatest(high, needs)
        return F.when(flipped, F.col("y1") - tall).otherwise(F.col("y0")), F.when(flipped, F.col("y1")).otherwise(F.col("y0") + tall)

    mode = F.lit("mono")
    if dual:
        sized = materialise(sized, "sized")  # read twice below, set once
        top, bottom = spread(F.col("dual_needs"))
        wide = sized.where("dual_needs is not null").select("doc_id", "ord", "x0", "x1", top.alias("y0"), bottom.alias("y1"))
        others = rows.where(T.clean_text(F.col("text")) != "").select("doc_id", *(F.col(c).alias(f"o_{c}") for c in ("ord", "x0", "y0", "x1", "y1")))
        across = (F.least("x1", "o_x1") - F.greatest("x0", "o_x0") > 1.0) & (F.least("y1", "o_y1") - F.greatest("y0", "o_y0") > 1.0)
        hit = wide.join(others, "doc_id").where((F.col("ord") != F.col("o_ord")) & across).select("doc_id", "ord").distinct().withColumn("_hit", F.lit(True))
        sized = sized.join(hit, ["doc_id", "ord"], "left")
        mode = F.when(F.col("dual_needs").isNotNull() & F.col("_hit").isNull(), "dual").otherwise("fallback")
    sized = sized.withColumn("mode", mode)
    both, alone = F.col("mode") == "dual", F.col("mode") == "mono"
    needs = F.when(both, F.col("dual_needs")).when(alone, F.col("mono_needs")).otherwise(F.least("mono_needs", "height_room"))
    top, bottom = spread(needs)
    size = F.when(both, F.col("dual_size")).otherwise(F.col("mono_size"))
    # text alone is anchored to the baseline of its source, and turned text alone keeps its box
    anchored, upright = alone & (F.col("turn") == 0) & F.col("first").isNotNull(), F.col("turn").isin(90, 270)
    first = F.when(anchored, F.col("first"))
    top, bottom = (F.when(anchored, first - size * ascent).when(alone & upright, F.col("y0")).otherwise(top), F.when(anchored, first - size * ascent + F.greatest(high, needs)).when(alone & upright, F.col("y1")).otherwise(bottom))
    skip = F.size("source_lines") * size * spacing + size * DUAL_GAP * dual_gap
    turned = frames.frame(F.col("starts"), F.col("dir_x"), F.col("dir_y"), F.col("x1") - F.col("x0"), high)
    return sized.withColumns({"_top": top, "_bottom": bottom, "_size": size, "_skip": skip}).select(
        "doc_id", "ord", "mode", "turn", F.col("_size").alias("size"), F.when(both, F.col("dual_lines")).otherwise(F.col("mono_lines")).alias("lines"),
        F.when(both, F.col("source_lines")).alias("source_lines"), "x0", F.col("_top").alias("y0"), "x1", F.col("_bottom").alias("y1"),
        F.when(both & ~flipped, F.col("y0") + F.col("_skip")).when(both, F.col("y1") - F.col("_skip")).alias("target_y0"), "erase",
        F.when(F.col("clamped"), F.col("limit.kind")).alias("clamped"), (~both & ~F.col("fits")).alias("overflow"),
        F.when(both, F.col("_size") * spacing).otherwise(F.col("mono_step")).alias("step"),
        F.when(alone, F.col("mono_tracking")).otherwise(F.transform(F.when(both, F.col("dual_lines")).otherwise(F.col("mono_lines")), lambda x: F.lit(0.0))).alias("tracking"),
        F.when(both, F.col("dual_widths")).when(alone, F.col("mono_widths")).otherwise(F.zip_with(F.col("mono_widths"), F.zip_with("mono_lines", "mono_tracking", lambda x, t: t * F.greatest(F.lit(0), F.length(x) - 1)), lambda w, t: w - t)).alias("widths"),
        F.when(both, F.transform("source_ems", lambda w: w * F.col("_size"))).alias("source_widths"), "align", F.when(both, F.col("_skip")).otherwise(0.0).alias("skip"),
        F.coalesce(F.when(upright, turned), frames.box_frame(F.col("turn"), first, F.col("_top"), F.col("_bottom"), F.col("_size") * ascent)).alias("frame"),
    )


def placed_lines(plans: DataFrame) -> DataFrame:
    """(doc_id, ord, part source or target, line, text, x, y, width, ax, ay, sx, sy, size) of each line of a plan that is not blank:
    where its baseline begins, along which axis it runs and along which the lines stack."""
    keys = ["doc_id", "ord"]
    more = {"part": F.lit("target"), "size": F.col("size")}
    target = frames.line_rows(plans, keys, F.col("frame"), F.col("lines"), F.col("widths"), F.col("step"), F.col("align"), F.col("skip"), more)
    source = frames.line_rows(plans.where("mode = 'dual'"), keys, F.col("frame"), F.col("source_lines"), F.col("source_widths"), F.col("step"), F.col("align"), 0.0, more | {"part": F.lit("source")})
    return target.unionByName(source)


def summary(plans: DataFrame) -> DataFrame:
    """(doc_id, placed, fallback_mono, overflow, clamped_cell, clamped_row) of each page that has a translation."""
    count = lambda c, n: F.count_if(c).alias(n)
    return plans.groupBy("doc_id").agg(F.count("*").alias("placed"), count(F.col("mode") == "fallback", "fallback_mono"), count(F.col("overflow"), "overflow"), count(F.col("clamped") == "cell", "clamped_cell"), count(F.col("clamped") == "row", "clamped_row"))


def pages_to_set(rows: DataFrame) -> DataFrame:
    """(doc_id) of pages on which any paragraph has a translation."""
    return rows.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("target"), F.lit("")) != "").alias("any")).where("any").select("doc_id")
