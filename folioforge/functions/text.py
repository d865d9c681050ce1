"""Text scalars as Column expressions; all of them stay in the JVM but the compatibility form of texts that are not Latin."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns that decide what a paragraph is. Character classes are spelt out so that every engine reads
# them alike.
PAGE_NUMBER = (
    r"^\s*[-–—\[\(]?\s*[0-9]{1,4}\s*[-–—\]\)]?\s*$",
    r"(?i)^\s*(page|p\.?)\s*[0-9]{1,4}\s*(of\s*[0-9]{1,4})?\s*$",
    r"^\s*第?\s*[0-9]{1,4}\s*页?\s*(/\s*共?\s*[0-9]{1,4}\s*页?)?\s*$",
    r"^\s*[0-9]{1,4}\s*/\s*[0-9]{1,4}\s*$",
)
URL_ONLY = r"(?i)^(https?://|www\.)\S+$"
EMAIL_ONLY = r"^[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+$"
NUMBER_ONLY = r"""^[\s\p{Nd}.,:%/\\()\[\]{}+\-_=*#&|<>~^°'"`–—]+$"""
CODE_START = r"(?i)^\s*(#include|import\s+[\p{L}\p{N}_]|from\s+[\p{L}\p{N}_]+\s+import|def\s+[\p{L}\p{N}_]+\s*\(|class\s+[\p{L}\p{N}_]+|function\s+[\p{L}\p{N}_]+\s*\(|public\s+|private\s+|SELECT\s|INSERT\s+INTO|</?[\p{L}\p{N}_]+[^>]*>|\{|\}|=>)\s*"
CODE_SYMBOLS = "{}[]();=<>"
CODE_DENSITY = 0.18
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
HAN_TARGETS = ("zh", "zh-TW", "ja", "ko")
GLOSSARY_SEPARATORS = ("=>", "=", "→", ":", "：", "\t", ",")


#: White space of Unicode, as a class and as characters.
BLANKS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ASCII_BLANKS = " \t\n\x0b\x0c\r"
WIDE_BLANKS = rf"[\x{{85}}-\x{{3000}}&&{BLANKS}]"
BLANK_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
#: Characters that no compatibility form changes, and that do not join with one before them.
STABLE = r"\x00-\x9f\x{c0}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{180}-\x{1c3}\x{1cd}-\x{1f0}\x{1f4}-\x{24f}\x{4e00}-\x{9fff}"
#: All others; ASCII fails the first test.
UNSTABLE = rf"[\x{{80}}-\x{{10ffff}}&&[^{STABLE}]]"


@F.pandas_udf(StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def compatible(c: Column) -> Column:
    """A text in Unicode's compatibility form NFKC. Texts without characters that it may change do not leave the JVM."""
    asked = bound(c, lambda s: F.when(~is_ascii(s) & s.rlike(UNSTABLE), s))
    return F.coalesce(_nfkc(asked), c)


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c) with c computed once, however often fn uses it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def without(c: Column, chars: str) -> Column:
    """A text without these few characters. Replacing searches bytes; translate() looks each character up and is far slower."""
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def clean_text(c: Column) -> Column:
    """No zero-width characters, line feeds only, runs of blanks as one space, ends stripped; null becomes empty."""
    c = without(F.coalesce(c, F.lit("")), ZERO_WIDTH)
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    runs = lambda s: s.contains("  ") | s.contains("\t") | s.contains("\u3000")  # noqa: E731  searches, which most texts fail
    return F.btrim(bound(c, lambda s: F.when(runs(s), F.regexp_replace(s, "[ \t\u3000]{2,}", " ")).otherwise(s)), F.lit(BLANK_CHARS))


def join_lines(lines: Column) -> Column:
    """An array of lines as running text: hyphens at line ends undone, breaks after Han dropped, others as spaces."""
    c = F.array_join(lines, "\n")
    c = F.regexp_replace(c, r"(?<=[A-Za-z])[-‐‑]\s*\n\s*(?=[a-z])", "")
    c = F.regexp_replace(c, r"(?<=[　-〿㐀-䶿一-鿿＀-￯])\n", "")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", " ")
    return F.regexp_replace(F.regexp_replace(c, "[ \t　]{2,}", " "), r"(?U)^\s+|\s+$", "")


def _squeezed(c: Column) -> Column:
    """A text without white space: that of ASCII by search, the rest by a pattern, for texts that may have it."""
    return bound(without(c, ASCII_BLANKS), lambda s: F.when(is_ascii(s), s).otherwise(F.regexp_replace(s, f"{WIDE_BLANKS}+", "")))


def bare(c: Column) -> Column:
    """A text without white space and zero-width characters."""
    return _squeezed(without(F.coalesce(c, F.lit("")), ZERO_WIDTH))


def has_key(c: Column) -> Column:
    """Whether the match key is not empty, without computing it: a filter of the key itself would compute it twice."""
    return c.rlike(f"[^{BLANKS[1:-1]}{ZERO_WIDTH}]")


def match_key(c: Column) -> Column:
    """Lower case and compatibility form without white space. Only a form that changed may have white space again, so texts of
    ASCII alone pass no pattern."""
    return key_of_bare(bare(c))


def key_of_bare(c: Column) -> Column:
    """The match key of what bare() made. It uses c twice: a column of its own is computed once."""
    other = _nfkc(bound(c, lambda s: F.when(~is_ascii(s) & s.rlike(UNSTABLE), s)))
    return F.lower(F.coalesce(F.regexp_replace(other, f"{BLANKS}+", ""), c))


def is_page_number(c: Column) -> Column:
    return bound(clean_text(c), _page_number)


def _page_number(s: Column) -> Column:
    hit = F.lit(False)
    for p in PAGE_NUMBER:
        hit = hit | s.rlike(p)
    return (s != "") & (F.length(s) <= 24) & hit


def symbol_count(c: Column, symbols: str) -> Column:
    """How many of these characters a text has."""
    return F.length(c) - F.length(F.regexp_replace(c, "[" + "".join(f"\\x{{{ord(x):x}}}" for x in symbols) + "]", ""))


def is_translatable(c: Column, min_chars: int = 2) -> Column:
    return bound(clean_text(c), lambda s: _translatable(s, min_chars))


def _translatable(s: Column, min_chars: int = 2) -> Column:
    bare = ~(s.rlike(URL_ONLY) | s.rlike(EMAIL_ONLY) | s.rlike(NUMBER_ONLY))
    two = s.rlike(r"[\p{L}\p{N}_][^\p{L}\p{N}_]*[\p{L}\p{N}_]")  # found at once, where counting them would read the whole text
    return (F.length(s) >= min_chars) & s.rlike(r"\p{L}") & bare & two


def looks_like_code(c: Column) -> Column:
    return bound(clean_text(c), _code)


def _code(s: Column) -> Column:
    return (s != "") & (s.rlike(CODE_START) | ((F.length(s) > 8) & (symbol_count(s, CODE_SYMBOLS) / F.greatest(F.length(s), F.lit(1)) > CODE_DENSITY)))


def has_target_language(c: Column, target: str) -> Column:
    return bound(clean_text(c), lambda s: _in_language(s, target))


def _in_language(s: Column, target: str) -> Column:
    if target not in HAN_TARGETS:
        return F.lit(False)
    han, latin = (F.length(s) - F.length(F.regexp_replace(s, p, "")) for p in ("[一-鿿]", "[A-Za-z]"))
    return s.rlike("[一-鿿]") & (han >= latin)


def why_not(clean: Column, target: str, reason: Column) -> Column:
    """`reason` (a chain of conditions), and then the reasons that lie in a text that is clean already."""
    return reason.when(_code(clean), "code").when(~_translatable(clean), "not_translatable").when(_in_language(clean, target), "already_target")


def skip_reason(c: Column, target: str = "zh") -> Column:
    """Why a paragraph is left alone, or `translatable`; the first reason holds. The text is cleaned once."""

    def reason(s: Column) -> Column:
        return why_not(s, target, F.when(s == "", "empty").when(_page_number(s), "page_num")).otherwise("translatable")

    return bound(clean_text(c), reason)


def estimate_tokens(c: Column) -> Column:
    wide = F.length(c) - F.length(F.regexp_replace(c, "[　-鿿＀-￯]", ""))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(F.floor(wide * F.lit(1.05) + (F.length(c) - wide) / F.lit(3.6)).cast("int") + 1)


# Numbers


def _canonical(c: Column) -> Column:
    """A number without leading or trailing zeros; more than 15 digits stay as they are."""
    whole = F.regexp_replace(c, "^0+(?=[0-9])", "")
    point = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", F.try_to_number(c, F.lit("999999999999999D999999999999999")).cast("double")), "0+$", ""), r"\.$", "")
    return F.when(F.length(F.translate(c, ".", "")) > 15, c).when(c.contains("."), point).otherwise(whole)


def number_candidates(token: Column) -> Column:
    """The readings of a number: with two kinds of separator the last is the decimal point; with one kind the first is,
    and if three digits follow each it may also part thousands."""
    comma, dot = token.contains(","), token.contains(".")
    last_comma = F.length(F.substring_index(token, ",", -1)) < F.length(F.substring_index(token, ".", -1))
    two = F.when(last_comma, F.translate(F.translate(token, ".", ""), ",", ".")).otherwise(F.translate(token, ",", ""))
    one = F.translate(token, ",", ".")
    head = F.substring_index(one, ".", 1)
    decimal = F.concat(head, F.lit("."), F.translate(F.substring(one, F.length(head) + 2, F.length(one)), ".", ""))
    thousands = F.when(one.rlike(r"^[0-9]+(\.[0-9]{3})+$"), F.translate(one, ".", ""))
    forms = F.when(comma & dot, F.array(two)).when(comma | dot, F.array(decimal, thousands)).otherwise(F.array(token))
    return F.array_distinct(F.transform(F.filter(forms, lambda f: f.isNotNull()), _canonical))


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))


# Numerals, and the counters that may follow them.
HAN_DIGITS, HAN_UNITS, HAN_BIG = "零一二三四五六七八九", "十百千", "万亿"
HAN_NUMERAL = "[〇零一二两三四五六七八九十百千万亿]"
#: The same class for searches in the JVM: all characters out of these ranges fail one test instead of eighteen.
NUMERAL_SEARCH = rf"[\x{{3007}}\x{{4e00}}-\x{{9fff}}&&{HAN_NUMERAL}]"
HAN_COUNTERS = "条类款项级种章节次组号个只头尾匹株枚份名位岁龄年月日周天期届米厘尺丈升毫升克斤吨度倍层批台套件张片块根支颗粒本册篇段页"


def _han_value(run: Column) -> Column:
    """The number that a run of numerals writes, as text without leading zeros."""
    s = F.translate(run, "〇两", "零二")
    placed = F.regexp_replace(F.translate(s, HAN_DIGITS, "0123456789"), "^0+(?=[0-9])", "")

    def digit(c: Column) -> Column:
        return F.instr(F.lit(HAN_DIGITS), c) - 1

    def power(c: Column) -> Column:
        return F.pow(F.lit(10), F.instr(F.lit(HAN_UNITS), c)).cast("long")

    def section(part: Column) -> Column:
        low = F.translate(part, HAN_BIG, "")
        terms = F.regexp_extract_all(low, F.lit(f"[{HAN_DIGITS}]?[{HAN_UNITS}]"), F.lit(0))
        tens = F.aggregate(terms, F.lit(0).cast("long"), lambda acc, t: acc + F.greatest(F.lit(1), digit(F.substring(t, 1, 1))) * power(F.right(t, F.lit(1))))
        ones = F.when(low.rlike(f"[{HAN_DIGITS}]$"), digit(F.right(low, F.lit(1)))).otherwise(0)
        return (tens + ones) * F.when(part.endswith("万"), 10_000).when(part.endswith("亿"), 100_000_000).otherwise(1)

    parts = F.filter(F.regexp_extract_all(s, F.lit(f"[^{HAN_BIG}]*[{HAN_BIG}]?"), F.lit(0)), lambda p: p != "")
    summed = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + section(p))
    return F.when(s.rlike(f"^[{HAN_DIGITS}]+$"), placed).otherwise(summed.cast("string"))


def han_numerals(c: Column) -> Column:
    """Values of the numerals that stand by themselves: no other Han before them but the ordinal prefix, none after them
    but a counter. The pattern begins with the numeral and then looks back, so that a search passes over all else at once."""
    n = NUMERAL_SEARCH
    alone = rf"{n}(?<!{n}.)(?:(?<=第.)|(?<![一-鿿].)){n}*(?!{n})(?=[{HAN_COUNTERS}]|[^一-鿿]|$)"
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(alone), F.lit(0)), _han_value)
    return F.when(is_ascii(F.coalesce(c, F.lit(""))), F.array().cast("array<string>")).otherwise(found)


def _missing(source: Column, target: Column) -> Column:
    """Tokens and values that stand in both alike are set aside first; readings are made once, and only for what is left."""

    def unread(left: Column) -> Column:
        known = F.concat(F.flatten(F.transform(number_tokens(target), number_candidates)), han_numerals(target), F.array(F.lit("")))
        digits = lambda k: F.filter(left["tokens"], lambda t: ~F.arrays_overlap(number_candidates(t), k))
        return bound(known, lambda k: F.array_distinct(F.concat(digits(k), F.filter(left["values"], lambda v: ~F.array_contains(k, v)))))

    left = F.struct(*(F.array_except(of(source), of(target)).alias(n) for n, of in (("tokens", number_tokens), ("values", han_numerals))))
    return bound(left, lambda x: F.when(F.size(x["tokens"]) + F.size(x["values"]) > 0, unread(x)).otherwise(F.array().cast("array<string>")))


def missing_numbers(source: Column, target: Column) -> Column:
    """Numbers of the source, in order and once each, none of whose readings is a reading in the target. None are missing
    if all are found once decimals that a space has split are joined again. Texts without a digit or numeral are not read."""
    none = F.array().cast("array<string>")
    joined = F.regexp_replace(source, r"([0-9][.,])\s+(?=[0-9])", "$1")
    again = lambda strict: F.when((F.size(strict) > 0) & (joined != source) & (F.size(_missing(joined, target)) == 0), none).otherwise(strict)
    return F.when(source.rlike("[0-9]") | (~is_ascii(source) & source.rlike(NUMERAL_SEARCH)), bound(_missing(source, target), again)).otherwise(none)


# Page ranges and glossaries


def page_range(spec: Column, total: Column) -> Column:
    """Sorted 0-based pages of "1-5, 8": ranges in any order, `all` or nothing means all pages, other text none."""
    everything = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(spec, F.lit("")), "(?U)^\\s+|\\s+$", "")), "[,，;；\\s]+"), lambda p: p != "")
    span = r"^([0-9]{1,9})(?:[-~至]([0-9]{1,9}))?$"

    def pages(p: Column) -> Column:
        a = F.regexp_extract(p, span, 1).cast("int")
        b = F.coalesce(F.nullif(F.regexp_extract(p, span, 2), F.lit("")).cast("int"), a)
        lo, hi = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), total)
        return F.when(p.rlike(span), F.when(lo <= hi, F.sequence(lo - 1, hi - 1))).otherwise(F.array().cast("array<int>"))

    some = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.coalesce(pages(p), F.array().cast("array<int>"))))))
    return F.when((F.size(parts) == 0) | F.array_contains(parts, "all"), everything).otherwise(some)


def format_pages(pages: Column) -> Column:
    """Sorted, distinct 0-based pages as "1-5,8", no pages as "-"."""
    first = F.filter(pages, lambda p, i: (i == 0) | (F.get(pages, i - 1) != p - 1))
    last = F.filter(pages, lambda p, i: (i == F.size(pages) - 1) | (F.get(pages, i + 1) != p + 1))
    runs = F.zip_with(first, last, lambda a, b: F.when(a == b, (a + 1).cast("string")).otherwise(F.concat_ws("-", a + 1, b + 1)))
    return F.when(F.size(pages) == 0, "-").otherwise(F.array_join(runs, ","))


def glossary_entry(line: Column) -> Column:
    """(src, dst) of a glossary line, null for blanks, comments and lines without both sides."""
    s = clean_text(line)
    out = F.lit(None).cast("struct<src:string,dst:string>")
    for sep in reversed(GLOSSARY_SEPARATORS):
        at = F.instr(s, sep)
        pair = F.struct(clean_text(F.substring(s, F.lit(1), at - 1)).alias("src"), clean_text(F.substring(s, at + len(sep), F.length(s))).alias("dst"))
        out = F.when(at > 0, pair).otherwise(out)
    return F.when((s != "") & ~s.startswith("#") & (out["src"] != "") & (out["dst"] != ""), out)
