"""Styles of fonts and colours as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of font names, in lower case, that tell their class.
MONO = ("mono", "courier", "consolas", "menlo", "monaco", "typewriter")
SERIF = (
    "song", "sung", "simsun", "nsimsun", "sun-ext", "serif", "times", "georgia", "garamond", "minion", "sabon", "baskerville", "caslon", "didot",
    "bodoni", "book", "ming", "sungti", "songti", "fangsong", "kai", "kaiti", "stsong", "宋", "明朝", "仿宋", "楷", "楷体", "思源宋",
    "source han serif", "noto serif", "sourcehanserif",
)
BOLD = ("bold", "black", "heavy", "semibold", "demibold", "extrabold", "ultrabold")
ITALIC = ("italic", "oblique")
BOLD_FLAG, ITALIC_FLAG = 16, 2
# Code points that need a Han face, the space between scripts in ems, and points after which there is none.
WIDE_RANGES = (
    (0x2E80, 0x2EFF), (0x3000, 0x303F), (0x3040, 0x30FF), (0x3130, 0x318F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x20000, 0x2FA1F),
)
SCRIPT_SPACE = 0.25
NO_SPACE_AFTER = "。，、：；！？）》」』】"
RED, GREEN, BLUE, BRIGHT = 0.299, 0.587, 0.114, 0.55


def any_part(parts: tuple[str, ...]) -> str:
    return "|".join(parts)


def font_style(name: Column, flags: Column) -> Column:
    """struct(serif, bold, mono, italic) of a font's name, without the mark of a subset before '+', and its flags.

    Names without a hint, and null, are sans; null flags are none."""
    low = F.lower(F.coalesce(name, F.lit("")))
    plain = F.regexp_replace(low, r"^[^+]*\+", "")
    bits = F.coalesce(flags, F.lit(0))
    return F.struct(
        plain.rlike(any_part(SERIF)).alias("serif"),
        (plain.rlike(any_part(BOLD)) | (bits.bitwiseAND(BOLD_FLAG) != 0)).alias("bold"),
        plain.rlike(any_part(MONO)).alias("mono"),
        (plain.rlike(any_part(ITALIC)) | (bits.bitwiseAND(ITALIC_FLAG) != 0)).alias("italic"),
    )


def rgb(color: Column) -> Column:
    """struct(r, g, b) from 0 to 1 of a colour 0xRRGGBB; null is black."""
    c = F.coalesce(color, F.lit(0))
    return F.struct(*((F.shiftright(c, k).bitwiseAND(255) / 255.0).alias(n) for k, n in ((16, "r"), (8, "g"), (0, "b"))))


def readable_on(background: Column) -> Column:
    """The colour, black (0) or white, of text that can be read on a background 0xRRGGBB; black on null."""
    c = rgb(background)
    light = RED * c["r"] + GREEN * c["g"] + BLUE * c["b"]
    return F.when(background.isNull() | (light > BRIGHT), 0x000000).otherwise(0xFFFFFF)


def rotation(directions: Column) -> Column:
    """Degrees of a paragraph by the first of its lines' directions (dx, dy) that is not zero: 0, 180 or about +-90."""
    first = F.get(F.filter(directions, lambda d: (F.abs(d["dx"]) >= 1e-6) | (F.abs(d["dy"]) >= 1e-6)), F.lit(0))
    dx, dy = first["dx"], first["dy"]
    upright = F.round(F.degrees(F.atan2(dy, dx)), 2)
    return F.when(F.abs(dy) > F.abs(dx), upright).when(dx < 0, 180.0).otherwise(0.0)


def leading(natural: Column, pitch: Column) -> Column:
    """Distance of lines: that of the source's lines, at least the natural one and at most 1.8 times it; null is natural."""
    return F.when(pitch > 0, F.least(F.greatest(pitch, natural), natural * 1.8)).otherwise(natural)
