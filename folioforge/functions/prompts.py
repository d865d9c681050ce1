"""What a request to a model says besides its items: glossary, background and rules; progress of a task; names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T

# Entries of a glossary and characters of the background that a request holds; stages and their shares.
GLOSSARY_ENTRIES, HINT_PARAGRAPHS, HINT_CHARS = 200, 3, 600
NAME_CHARS, EXTENSION_CHARS = 120, 8
RESERVED = "CON PRN AUX NUL COM1 COM2 COM3 COM4 COM5 COM6 COM7 COM8 COM9 LPT1 LPT2 LPT3 LPT4 LPT5 LPT6 LPT7 LPT8 LPT9".split()
UNITS = ("B", "KB", "MB", "GB")


def glossary(rows: DataFrame) -> DataFrame:
    """(glossary_id, src, dst, place) of lines (glossary_id, ord, line): of a source written twice the last target, at the first place."""
    entry = T.glossary_entry(F.col("line"))
    read = rows.select("glossary_id", "ord", entry.alias("e")).where("e is not null")
    return read.groupBy("glossary_id", F.col("e.src").alias("src")).agg(F.max_by("e.dst", "ord").alias("dst"), F.min("ord").alias("place"))


def glossary_block(entries: DataFrame, most: int = GLOSSARY_ENTRIES) -> DataFrame:
    """(glossary_id, block): the first entries as lines of a request."""
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("place", "src", "dst"))), 1, most)
    return entries.groupBy("glossary_id").agg(F.array_join(F.transform(ordered, lambda e: F.concat(F.lit("- "), e["src"], F.lit(" → "), e["dst"])), "\n").alias("block"))


def context_hint(paragraphs: DataFrame, by: str) -> DataFrame:
    """(by, hint): the first paragraphs of a text (columns by, ord, text) as background, cut at a length."""
    text = T.clean_text(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    first = paragraphs.where(F.col("ord") < HINT_PARAGRAPHS).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))).alias("p"))
    said = F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != "")
    return first.select(by, F.left(F.array_join(said, "\n"), F.lit(HINT_CHARS)).alias("hint"))


def system_prompt(target: Column, rules: Column, protocol: Column, source: Column | None = None, glossary_block: Column | None = None, hint: Column | None = None) -> Column:
    """The instruction of a request: task, source language if it is known, rules, glossary, background, form of the reply."""
    none = F.lit(None).cast("string")
    given = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n{head}\n"), c))
    source, block, hint = (none if c is None else c for c in (source, glossary_block, hint))
    parts = [
        F.concat(F.lit("You translate a document into "), target, F.lit(".")),
        F.when((F.coalesce(source, F.lit("")) != "") & (source != "auto"), F.concat(F.lit("It is written in "), source, F.lit("."))),
        given("Rules:", F.trim(rules)), given("Glossary (always use these):", block),
        given("Background (do not translate):", F.left(hint, F.lit(HINT_CHARS))), F.concat(F.lit("\n"), protocol),
    ]
    return F.concat_ws("\n", *parts)


def progress(stage_from: Column, stage_to: Column, done: Column, total: Column, finished: Column) -> Column:
    """Per cent of a task: its stage's share of the way, by the parts done."""
    ratio = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / total))).otherwise(0.0)
    return F.when(finished, 100.0).otherwise(F.round(F.least(F.lit(100.0), stage_from + (stage_to - stage_from) * ratio), 1))


def seconds_left(elapsed: Column, percent: Column) -> Column:
    """The estimate of what is left: null in the first second and without progress, 0 at the end."""
    return F.when(percent >= 100, 0.0).when((percent > 0) & (elapsed > 1), elapsed * (100.0 - percent) / percent)


def safe_name(c: Column, fallback: str = "file") -> Column:
    """A file name without folders, characters that systems forbid, reserved names and more than 120 characters."""
    s = F.regexp_extract(F.replace(T.compatible(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/")), r"(?s)([^/]*)$", 1)
    s = F.regexp_replace(s, r'[<>:"|?*\x00-\x1f]', "_")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")
    s = F.when(F.upper(F.substring_index(s, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    ext = F.substring_index(s, ".", -1)
    kept = F.when(F.contains(s, F.lit(".")) & (F.length(ext) <= EXTENSION_CHARS), F.concat(F.left(s, F.least(F.lit(NAME_CHARS) - F.length(ext), F.length(s) - F.length(ext)) - 1), F.lit("."), ext)).otherwise(F.left(s, F.lit(NAME_CHARS)))
    return F.when(s == "", fallback).when(F.length(s) > NAME_CHARS, kept).otherwise(s)


def stem_of(c: Column) -> Column:
    """The safe name of a file without its extension."""
    base = F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")), r"(?s)([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?s)(?<=.)\.[^.]*$", "")
    return safe_name(F.when(stem == "", "document").otherwise(stem))


def human_size(c: Column) -> Column:
    """Bytes as a readable number with a unit; null is '-'."""
    c = c.cast("double")
    out = F.when(c < 1024, F.format_string("%.0f B", c))
    for k, unit in enumerate(UNITS[1:], 1):
        size = F.format_string(f"%.1f {unit}", F.bround(c / 1024**k, 1))
        out = out.otherwise(size) if k == len(UNITS) - 1 else out.when(c < 1024 ** (k + 1), size)
    return F.coalesce(F.when(c.isNotNull(), out), F.lit("-"))
