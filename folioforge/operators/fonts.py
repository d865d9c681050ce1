"""Choice of fonts for styles, the fonts used, symbols that a font lacks, and space between scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.style import NO_SPACE_AFTER, SCRIPT_SPACE, WIDE_RANGES

# Preferred families, the least share of simplified characters, symbols and what stands for them.
NOT_PREFERRED = 500
PREFERRED_SANS = (
    "microsoft yahei", "微软雅黑", "msyh",
    "dengxian", "等线",
    "source han sans", "noto sans sc", "思源黑体", "sourcesans",
    "pingfang sc", "harmonyos sans", "alibaba puhuiti",
    "wenquanyi micro hei", "hiragino sans", "heiti sc", "stxihei",
    "microsoft jhenghei", "simhei", "黑体",
)
PREFERRED_SERIF = (
    "source han serif", "noto serif sc", "思源宋体", "sourceserif",
    "songti sc", "simsun", "宋体", "stsong", "fangsong", "仿宋",
    "kaiti", "楷体", "mingliu", "pmingliu",
)
LEAST_COVERAGE = 0.9
SYMBOL_FONT_CODES = {
    0xF0A7: "•", 0xF0B7: "•", 0xF075: "•", 0xF06C: "●", 0xF0A8: "▪",
    0xF0D8: "➢", 0xF0E8: "➢", 0xF0AE: "→", 0xF0AC: "←", 0xF0AD: "↔",
    0xF0FC: "✓", 0xF0FE: "☑", 0xF0A1: "✱", 0xF0E0: "✉", 0xF0B0: "°",
    0xF0B1: "±", 0xF0B3: "≥", 0xF0A3: "≤", 0xF0BB: "≈", 0xF02D: "-",
    0xF020: " ", 0xF02A: "*", 0xF0B4: "×", 0xF0B8: "÷", 0xF0E9: "○",
}
EQUIVALENTS = {
    "≤": ["<="], "≥": [">="], "≠": ["!="], "≈": ["~="], "×": ["x"], "÷": ["/"],
    "²": ["^2"], "³": ["^3"], "¹": ["^1"], "⁰": ["^0"], "⁻": ["^-"], "⁺": ["^+"],
    "₀": ["_0"], "₁": ["_1"], "₂": ["_2"], "₃": ["_3"], "₄": ["_4"],
    "∑": ["Σ", "sum"], "∏": ["Π", "prod"], "∫": ["int"], "√": ["sqrt"], "∞": ["inf"],
    "±": ["+/-"], "∓": ["-/+"], "⋅": ["·"], "·": ["⋅"], "∘": ["o"], "∂": ["d"],
    "∇": ["grad"], "Δ": ["Delta"], "δ": ["delta"], "π": ["pi"], "μ": ["u"],
    "Ω": ["Ohm"], "°": ["deg"], "′": ["'"], "″": ['"'], "‰": ["0/00"], "‱": ["0/000"],
    "←": ["<-"], "→": ["->"], "↔": ["<->"], "⇒": ["=>"], "⇔": ["<=>"],
    "∈": ["in"], "∉": ["not in"], "⊂": ["subset"], "⊆": ["subseteq"],
    "∪": ["union"], "∩": ["intersect"], "∀": ["forall"], "∃": ["exists"],
    "∠": ["angle"], "⊥": ["perp"], "∥": ["parallel"], "∅": ["Ø", "dia", "empty"],
    "ⁿ": ["^n"], "∛": ["cbrt"], "½": ["1/2"], "¼": ["1/4"], "¾": ["3/4"],
    "↗": ["up-right"], "↘": ["down-right"],
}
WIDE_SCRIPT = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in WIDE_RANGES) + "]"


def preference(name: Column, families: tuple[str, ...]) -> Column:
    """The place of the first preferred family that a name holds, 500 for none."""
    out = F.lit(NOT_PREFERRED)
    for k in reversed(range(len(families))):
        out = F.when(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(families[k])), k).otherwise(out)
    return out


def ranked(styles: DataFrame, faces: DataFrame, sans: tuple[str, ...] = PREFERRED_SANS, serif: tuple[str, ...] = PREFERRED_SERIF, ascii_safe: bool = False) -> DataFrame:
    """(style_id, name, faux_bold): the best face for each style (style_id, bold, light, serif).

    faces: name, coverage, variable, subset_safe, cjk_ok, bold, light, serif, space_ok, builtin, ascii_ok. Faces are compared
    by eleven keys in this order: enough simplified characters, not variable, safe to subset, (for upright columns: true
    ASCII,) true Han, weight, lightness, serifs, true spaces, preference, not built in, name. The best face is a minimum
    over the faces, which are as many as fonts are installed: a broadcast of counted size."""
    f = faces.select(*(F.col(c).alias(f"f_{c}") for c in faces.columns))
    differs = lambda c: (F.col(c) != F.col(f"f_{c}")).cast("int")
    lacks = lambda c: (~F.col(f"f_{c}")).cast("int")
    liked = F.when(F.col("serif"), preference(F.col("f_name"), serif)).otherwise(preference(F.col("f_name"), sans))
    keys = [(F.col("f_coverage") < LEAST_COVERAGE).cast("int"), F.col("f_variable").cast("int"), lacks("subset_safe")] + ([lacks("ascii_ok")] if ascii_safe else [])
    keys += [lacks("cjk_ok"), differs("bold"), differs("light"), differs("serif"), lacks("space_ok"), liked, F.col("f_builtin").cast("int"), F.col("f_name")]
    if faces.count() > 100_000:
        raise ValueError("more than 100,000 font faces")
    best = styles.crossJoin(F.broadcast(f)).groupBy("style_id", "bold").agg(F.min(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col("f_bold").alias("has_bold"))).alias("x"))
    return best.select("style_id", F.col(f"x.k{len(keys) - 1}").alias("name"), (F.col("bold") & ~F.col("x.has_bold")).alias("faux_bold"))


def used(blocks: DataFrame, most: int = 6) -> DataFrame:
    """(font, n): the fonts (column font, a name or a path, of which the stem counts) that most blocks use; of equals the first by name."""
    stem = F.regexp_replace(F.regexp_extract("font", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    name = F.when(F.col("font").rlike(r"[/\\]"), stem).otherwise(F.col("font"))
    return blocks.where("font != ''").groupBy(name.alias("font")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "font").limit(most)


def drawable(text: Column, glyphs: Column, spell_out: bool = False) -> Column:
    """A text in characters of a font (a string of all it has): symbol codes as the symbols they stand for, with `spell_out`
    symbols as the first equivalent that can be drawn; unknown private codes are left out, all else stays."""
    codes = F.create_map(*(F.lit(x) for k, v in SYMBOL_FONT_CODES.items() for x in (chr(k), v)))
    forms = F.create_map(*(x for k, v in EQUIVALENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    has = lambda c: F.contains(glyphs, c)
    whole = lambda s: F.forall(F.filter(F.split(s, ""), lambda c: c != ""), has)

    def one(c: Column) -> Column:
        symbol = F.element_at(codes, c)
        out = F.when(has(c), c).when(symbol.isNotNull() & has(symbol), symbol)
        if spell_out:
            form = F.get(F.filter(F.coalesce(F.element_at(forms, c), F.array().cast("array<string>")), whole), 0)
            out = out.when(form.isNotNull(), form)
        return out.when(c.rlike(r"[\x{e000}-\x{f8ff}]"), "").otherwise(c)

    return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def script_space(before: Column, after: Column) -> Column:
    """The space, in ems, between two characters: where the script changes, but not after Han punctuation or at white space."""
    blank = (F.coalesce(before, F.lit("")) == "") | (F.coalesce(after, F.lit("")) == "") | before.rlike(r"(?U)^\s") | after.rlike(r"(?U)^\s")
    return F.when(~blank & ~before.isin(*NO_SPACE_AFTER) & (before.rlike(WIDE_SCRIPT) != after.rlike(WIDE_SCRIPT)), SCRIPT_SPACE).otherwise(0.0)


#: Han characters, and those of them that are not white space (and no punctuation that takes no space), as one test that all
#: characters of other scripts fail at once; then a Han character before one of another script, and one after.
_LESS = lambda less: "".join(rf"\x{{{ord(c):x}}}" for c in less)
HAN_SEARCH = rf"[\x{{2e80}}-\x{{2fa1f}}&&{WIDE_SCRIPT}]"
_OTHER = f"[^{WIDE_SCRIPT[1:-1]}{T.BLANKS[1:-1]}]"
LEAVES_HAN = rf"[\x{{2e80}}-\x{{2fa1f}}&&{WIDE_SCRIPT}&&[^{_LESS(T.BLANK_CHARS + NO_SPACE_AFTER)}]](?={_OTHER})"
ENTERS_HAN = rf"(?s)[\x{{2e80}}-\x{{2fa1f}}&&{WIDE_SCRIPT}&&[^{_LESS(T.BLANK_CHARS)}]](?<={_OTHER}.)"


def script_gaps(text: Column) -> Column:
    """How many places of a text get a space between scripts: a search for Han characters, not a test of each two characters.

    Looking back counts code units, so texts with characters of two of them are tested character by character."""
    chars = F.split(text, "")
    size = F.greatest(F.lit(0), F.size(chars) - 1)
    each = F.size(F.filter(F.zip_with(F.slice(chars, F.lit(1), size), F.slice(chars, F.lit(2), size), script_space), lambda g: g > 0))
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    found = F.when(text.rlike(r"[\x{10000}-\x{10ffff}]"), each).otherwise(count(LEAVES_HAN) + count(ENTERS_HAN))
    return F.when(~T.is_ascii(text) & text.rlike(HAN_SEARCH), found).otherwise(0)


# A face for each symbol, and lines as runs of faces

# Families that are taken first for single symbols.
PREFERRED_SYMBOLS = (
    "ms gothic", "yu gothic", "malgun gothic",
    "microsoft jhenghei", "microsoft yahei", "dengxian",
    "simsun", "simhei", "heiti", "songti", "kaiti",
    "source han", "noto sans", "思源", "黑体", "宋体",
)
HAN_ADVANCE = r"[\x{1100}-\x{11ff}\x{2e80}-\x{2eff}\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}]"
#: Code points of a block of the index.
BLOCK = 256


def characters(text: Column) -> Column:
    """The distinct characters of a text."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""))


def covering(codes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(code, name): the faces that have each code point, by an index of coverage (name, first, last) in blocks.

    codes has distinct code points, at most as many as Unicode has; a range of any length meets only its own blocks."""
    blocks = coverage.select("name", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))).alias("block"))
    placed = codes.select("code", F.floor(F.col("code") / BLOCK).alias("block"))
    return placed.join(blocks, "block").where(F.col("code").between(F.col("first"), F.col("last"))).select("code", "name").distinct()


def symbol_faces(codes: DataFrame, faces: DataFrame, coverage: DataFrame, liked: tuple[str, ...] = PREFERRED_SYMBOLS) -> DataFrame:
    """(code, name): for each code point the first face that has it, none for those that no face has.

    faces: name, subset_safe, variable, light, cjk_ok, ascii_ok, compared in this order, then by preference and name: single
    symbols ask for no weight, but a light one would stand out."""
    lacks = lambda c: (~F.col(c)).cast("int")
    keys = F.struct(lacks("subset_safe").alias("k0"), F.col("variable").cast("int").alias("k1"), F.col("light").cast("int").alias("k2"), lacks("cjk_ok").alias("k3"), lacks("ascii_ok").alias("k4"), preference(F.col("name"), liked).alias("k5"), "name")
    ranked_ = faces.select("name", keys.alias("key"))
    return covering(codes, coverage).join(ranked_, "name").groupBy("code").agg(F.min("key")["name"].alias("name"))


def lacking(texts: DataFrame, coverage: DataFrame) -> DataFrame:
    """(code): the distinct code points of texts (column text) that no range of a base face's coverage (first, last) has."""
    codes = texts.select(F.explode(characters(F.col("text"))).alias("c")).distinct().select(F.ascii("c").alias("code"))
    return codes.join(covering(codes, coverage.select(F.lit("base").alias("name"), "first", "last")), "code", "left_anti")


def with_symbols(texts: DataFrame, keys: list[str], chosen: DataFrame) -> DataFrame:
    """texts with `symbols`, a map from those of its characters that have a face of their own (chosen: code, name) to it."""
    own = texts.select(*keys, F.explode(characters(F.col("text"))).alias("c")).withColumn("code", F.ascii("c"))
    found = own.join(chosen, "code").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("c", "name"))).alias("symbols"))
    return texts.join(found, keys, "left")


def line_width(text: Column) -> Column:
    """The width of a line in ems: one for Han, half for others, and the space between scripts."""
    search = rf"[\x{{1100}}-\x{{ffef}}&&{HAN_ADVANCE}]"  # other characters fail one test
    han = F.length(text) - F.length(F.regexp_replace(text, search, ""))
    return F.length(text) * 0.5 + F.when(T.is_ascii(text), 0.0).otherwise(han * 0.5) + script_gaps(text) * SCRIPT_SPACE


def units(text: Column, symbols: Column) -> Column:
    """A text in stretches of one script, each of the characters that are keys of the map (null for none) by itself."""
    wide = WIDE_SCRIPT[1:-1]
    own = F.array_join(F.transform(F.array_sort(F.map_keys(symbols)), lambda c: F.concat(F.lit("\\x{"), F.hex(F.ascii(c)), F.lit("}"))), "")
    some = F.concat(F.lit("["), own, F.lit(f"]|[{wide}&&[^"), own, F.lit(f"]]+|[^{wide}"), own, F.lit("]+"))
    return F.regexp_extract_all(text, F.when(F.size(symbols) > 0, some).otherwise(f"[{wide}]+|[^{wide}]+"), F.lit(0))


def face_runs(rows: DataFrame, keys: list[str], han: str = "han", latin: str = "latin") -> DataFrame:
    """(keys, run, face, text, x, width) of rows (keys, text, symbols): each line as runs of one face, x in ems from its start.

    Symbols have the face of the map, other characters that of their script. The space where the script changes belongs
    to no run, it moves the next one. Empty and null lines have no runs; keys name the rows."""
    made = lambda f, t, g: F.struct(f.alias("face"), t.alias("text"), g.alias("gap"))

    def cut(c: Column, f: Column, s: Column) -> Column:
        """Runs of the stretches c with the faces f, that begin at the places s."""
        ends = F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.array(F.size(c)))
        return F.zip_with(s, ends, lambda a, b: made(F.get(f, a), F.array_join(F.slice(c, a + 1, b - a), ""), F.when(a > 0, script_space(F.right(F.get(c, a - 1), F.lit(1)), F.left(F.get(c, a), F.lit(1)))).otherwise(0.0)))

    def all_runs(c: Column) -> Column:
        face = F.transform(c, lambda x: F.coalesce(F.element_at("symbols", x), F.when(x.rlike(WIDE_SCRIPT), han).otherwise(latin)))
        starts = lambda f: F.filter(F.transform(f, lambda x, i: F.when((i == 0) | (F.get(f, i - 1) != x), i)), lambda i: i.isNotNull())
        return T.bound(face, lambda f: T.bound(starts(f), lambda s: cut(c, f, s)))  # each is computed once a line

    plain = F.col("symbols").isNull() & ~F.col("text").rlike(WIDE_SCRIPT)
    run = F.when(plain, F.array(made(F.lit(latin), F.col("text"), F.lit(0.0)))).otherwise(T.bound(units(F.col("text"), F.col("symbols")), all_runs))
    out = rows.where("text != ''").select(*keys, F.posexplode(run).alias("run", "_r"))
    out = out.select(*keys, "run", "_r.*").withColumn("width", line_width(F.col("text")))
    before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("x", F.sum(F.col("gap") + F.col("width")).over(before) - F.col("width")).select(*keys, "run", "face", "text", "x", "width")
