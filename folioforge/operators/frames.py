"""Where the lines of a paragraph stand on the page: an origin, the direction of the text, and the direction in which lines
stack. Frames are read from the lines of the source, so turned text keeps its sides; all of it is Column expressions.

Defined cases: a paragraph without an origin or without a direction has no frame; then a right angle gives one from the
box. Null angles are upright text; blank lines keep their place and have no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least length of a direction, the least distance of two origins, the least room along the text.
SHORTEST, APART, LEAST_RUN = 1e-6, 0.01, 8.0


def frame(starts: Column, dx: Column, dy: Column, wide: Column, high: Column) -> Column:
    """struct(ox, oy, ax, ay, sx, sy, run) or null: the first origin, unit vectors along the text and across its lines, and
    the room along the text in a box. starts: array of struct(x, y), the origins of the lines in order, where they have one."""
    norm = F.hypot(dx, dy)
    ax, ay = dx / norm, dy / norm
    first, second = F.get(starts, F.lit(0)), F.get(starts, F.lit(1))
    vx, vy = second["x"] - first["x"], second["y"] - first["y"]
    turned = F.coalesce((F.abs(vx) + F.abs(vy) > APART) & (vx * -ay + vy * ax < 0), F.lit(False))
    side = F.when(turned, -1.0).otherwise(1.0)
    run = F.greatest(F.lit(LEAST_RUN), F.abs(high * ay) + F.abs(wide * ax))
    got = F.struct(first["x"].alias("ox"), first["y"].alias("oy"), ax.alias("ax"), ay.alias("ay"), (-ay * side).alias("sx"), (ax * side).alias("sy"), run.alias("run"))
    return F.when(first.isNotNull() & (norm >= SHORTEST), got)


def box_frame(turn: Column, first: Column, top: Column, bottom: Column, ascent: Column) -> Column:
    """The frame of text in the box x0..x1, top..bottom at a right angle. Upright text begins on the baseline `first` of its
    source if that is known; text on its head is upright text turned around the middle of the box."""
    x0, x1 = F.col("x0"), F.col("x1")
    wide, high = x1 - x0, bottom - top

    def of(ox: Column, oy: Column, ax: float, ay: float, run: Column) -> Column:
        return F.struct(ox.alias("ox"), oy.alias("oy"), F.lit(ax).alias("ax"), F.lit(ay).alias("ay"), F.lit(-ay).alias("sx"), F.lit(ax).alias("sy"), run.alias("run"))

    upright = of(x0, F.coalesce(first, top + ascent), 1.0, 0.0, wide)
    return F.when(turn == 180, of(x1, bottom - ascent, -1.0, 0.0, wide)).when(turn == 90, of(x1 - ascent, top, 0.0, 1.0, high)).when(turn == 270, of(x0 + ascent, bottom, 0.0, -1.0, high)).otherwise(upright)


def line_rows(rows: DataFrame, keys: list[str], frame: Column, lines: Column, widths: Column, step: Column, align: Column, skip: Column | float = 0.0, more: dict[str, Column] | None = None) -> DataFrame:
    """One row a line that is not blank: the keys, line (from 0), text, x and y of its baseline's start, width, ax, ay, sx, sy.

    widths and step are in points; `skip` is what stands before the first line. Centred and right-aligned lines begin
    further along the text."""
    item = F.posexplode(F.arrays_zip(lines.alias("text"), widths.alias("width")))
    out = rows.withColumns({"_f": frame, "_step": step, "_skip": skip if isinstance(skip, Column) else F.lit(skip), "_align": F.coalesce(align, F.lit("left")), **(more or {})})
    out = out.select("*", item.alias("line", "_l")).where(F.trim("_l.text") != "")
    free = F.col("_f.run") - F.col("_l.width")
    along = F.when(F.col("_align") == "center", F.greatest(F.lit(0.0), free / 2)).when(F.col("_align") == "right", free).otherwise(0.0)
    down = F.col("_skip") + F.col("line") * F.col("_step")
    at = lambda c: F.col(f"_f.o{c}") + F.col(f"_f.a{c}") * along + F.col(f"_f.s{c}") * down
    return out.select(*keys, "line", F.col("_l.text").alias("text"), at("x").alias("x"), at("y").alias("y"), F.col("_l.width").alias("width"), *(F.col(f"_f.{c}").alias(c) for c in ("ax", "ay", "sx", "sy")), *(more or {}))
