"""Parsed pages, regions, recognised text, fonts, requests and stores, against plain versions and by properties."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioforge.functions import prompts as P
from folioforge.functions import text as T
from folioforge.operators import fonts, pageplan, placement, recognition, regions, setting
from folioforge.sources import spans as source
from folioforge.sources import store, tables

BOX = "doc_id long, ord int, x0 double, y0 double, x1 double, y1 double"


def merge_one_by_one(boxes):
    """Pieces of lines joined by plain search; boxes: (ord, x0, y0, x1, y1, score)."""
    lines = []
    for o, *b in sorted(boxes, key=lambda b: (round((b[2] + b[4]) / 2 / 12), b[1], b[0])):
        for line in lines:
            e = line[1]
            tall, mine = e[3] - e[1], b[3] - b[1]
            if min(e[3], b[3]) - max(e[1], b[1]) < 0.75 * max(1.0, min(tall, mine)):
                continue
            gap = max(b[0], e[0]) - min(b[2], e[2])
            if gap > 0 and gap > 1.6 * max(tall, mine):
                continue
            line[1] = [min(e[0], b[0]), min(e[1], b[1]), max(e[2], b[2]), max(e[3], b[3]), max(e[4], b[4])]
            break
        else:
            lines.append([o, b])
    return sorted((o, *b) for o, b in lines)


def test_merged_boxes(spark):
    rnd = random.Random(1)
    rows = []
    for d in range(30):
        for o in range(rnd.randrange(25)):
            x, y = rnd.uniform(0, 300), rnd.choice([10, 12, 30, 33, 60]) + rnd.uniform(0, 3)
            rows.append((d, o, x, y, x + rnd.uniform(5, 60), y + rnd.uniform(8, 14), rnd.random()))
    got = recognition.merged_boxes(spark.createDataFrame(rows, BOX + ", score double")).collect()
    for d in {r[0] for r in rows}:
        want = merge_one_by_one([r[1:] for r in rows if r[0] == d])
        assert sorted(tuple(r)[1:] for r in got if r["doc_id"] == d) == want
    assert recognition.merged_boxes(spark.createDataFrame([], BOX + ", score double")).count() == 0


def test_decoding_drops_blanks_and_repeats(spark):
    steps = [(1, k, s, 0.5) for k, s in enumerate([0, 1, 1, 0, 1, 2, 2, 9, 0])] + [(2, 0, 0, 0.9)]
    got = recognition.decoded(spark.createDataFrame(steps, "line_id long, step int, sign int, score double"), spark.createDataFrame([(1, "a"), (2, "b")], "sign int, char string"))
    assert {r["line_id"]: (r["text"], r["confidence"]) for r in got.collect()} == {1: ("aab", 0.5), 2: ("", 0.0)}


def sample(spark):
    """Two columns over three pages: a header on each, a bold title, paragraphs left and right, a page number; a heading in a block of body text."""
    rows = []

    def line(page, block, k, text, x0, y0, size=9.5, font="Sans", flags=0):
        rows.append(("f", page, block, k, 0, text, x0, y0, x0 + len(text) * size * 0.5, y0 + size, font, size, flags, 0))

    for p in range(3):
        line(p, 0, 0, "Annual Report of the Works", 200.0, 32.0, 8.0)
        line(p, 1, 0, f"Chapter {'one two three'.split()[p]}", 60.0, 80.0, 15.0, "Sans-Bold", 16)
        for c, x in enumerate((60.0, 320.0)):
            for b in range(2):
                for k in range(4):
                    line(p, 2 + 2 * c + b, k, f"line {k} of block {b} in column {c} of page {p}", x, 120.0 + b * 120 + k * 12)
        line(p, 6, 0, f"Page {p + 1}", 290.0, 800.0, 9.0)
        line(p, 7, 0, "Remark", 60.0, 500.0, 9.5, "Sans-Bold", 16)
        for k in range(3):
            line(p, 7, k + 1, "a remark goes on and on over the whole width", 60.0, 512.0 + 12 * k)
        line(p, 8, 0, "   ", 60.0, 600.0)
        rows.append(("f", p, 9, 0, 0, "", 0.0, 0.0, 1.0, 1.0, "Sans", 9.0, 0, 0))
    spans = spark.createDataFrame(rows, "file_id string, page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, flags int, color int")
    pages = spark.createDataFrame([("f", p, 595.0, 842.0) for p in range(3)], "file_id string, page int, width double, height double")
    return source.conform(spans, source.SPANS), source.conform(pages, source.PAGES)


def test_pages_as_one_plan(spark):
    spans, pages = sample(spark)
    found = spark.createDataFrame([("f", 0, "cell", 0, 55.0, 110.0, 300.0, 200.0), ("f", 0, "row", 0, 0.0, 100.0, 595.0, 230.0), ("f", 0, "row", 1, 0.0, 110.0, 595.0, 200.0), ("f", 1, "table", 0, 50.0, 100.0, 310.0, 300.0)], "file_id string, page int, kind string, ord int, x0 double, y0 double, x1 double, y1 double")
    parsed = pageplan.paragraphs(spans, pages, found)
    rows = pageplan.kinds(parsed, pageplan.repeated_keys(parsed)).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(27))
    first = [r for r in rows if r["page"] == 0]
    assert [r["kind"] for r in first].count("header") == 1 and [r["kind"] for r in first].count("page_num") == 1
    title = next(r for r in first if r["text"] == "Chapter one")
    assert title["kind"] == "title" and title["bold"] and title["size"] == 15.0 and title["font"] == "Sans-Bold"
    remark = next(r for r in first if r["text"] == "Remark")
    assert remark["bold"] and not next(r for r in first if r["text"].startswith("a remark"))["bold"]
    order = [(r["text"].split()[4], r["text"].split()[7]) for r in first if r["text"].startswith("line 0")]
    assert order == [("0", "0"), ("1", "0"), ("0", "1"), ("1", "1")]
    body = next(r for r in first if r["text"].startswith("line 0 of block 0 in column 0"))
    assert body["limit"]["kind"] == "cell" and body["lines"][3].startswith("line 3") and body["pitch"] is None
    assert next(r for r in first if r["text"].startswith("line 0 of block 0 in column 1"))["limit"]["y1"] == 200.0
    assert {r["in_table"] for r in rows if r["page"] == 1 and "column 0" in r["text"]} == {True}
    joined = pageplan.merged(spark.createDataFrame(rows, pageplan.kinds(parsed, pageplan.repeated_keys(parsed)).schema)).collect()
    text = lambda rs: sorted(w for r in rs for w in " ".join(r["lines"]).split())
    assert text(joined) == text(rows) and len(joined) <= len(rows)


def test_no_text_is_lost_between_spans_and_paragraphs(spark):
    spans, pages = sample(spark)
    words = sorted(w for r in spans.collect() for w in r["text"].split())
    assert sorted(w for r in pageplan.paragraphs(spans, pages).collect() for w in r["text"].split()) == words


def test_pages_are_shuffled_once(spark):
    """From spans to groups of lines texts are shuffled by page, and not again by line, block or run."""
    spans = source.conform(spark.createDataFrame([("a", 0, 0, k, 0, f"word {k}", 10.0, 20.0 * k) for k in range(4)], "file_id string, page int, block int, line int, span int, text string, x0 double, y0 double"), source.SPANS)
    pages = source.conform(spark.createDataFrame([("a", 0)], "file_id string, page int"), source.PAGES)
    groups = pageplan.line_groups(source.lines(spans, pages))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        exchanges = [x for x in groups.select("*", "para.run")._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(exchanges) <= 2 and groups.count() == 4


def test_empty_and_missing_spans(spark):
    spans, pages = sample(spark)
    assert pageplan.paragraphs(spans.limit(0), pages).count() == 0
    bare = source.conform(spark.createDataFrame([("x", None)], "text string, page int"), source.SPANS).first()
    assert (bare["page"], bare["size"], bare["dir_x"], bare["origin_y"], bare["file_id"]) == (0, 10.0, 1.0, None, "")


def test_spans_from_json(spark, tmp_path):
    spans, _ = sample(spark)
    spans.write.json(str(tmp_path / "s"))
    assert source.read_spans(spark, str(tmp_path / "s"), "json").count() == spans.count()


PLACED = "doc_id long, ord int, column int, x0 double, y0 double, x1 double, y1 double, text string, target string, size double, rotation double, height double, pitch double, limit struct<kind:string,x0:double,y0:double,x1:double,y1:double>"


def placed(spark, rows, dual=False):
    out = placement.plan(spark.createDataFrame(rows, PLACED), dual).collect()
    return {r["ord"]: r for r in out}


def row(o, y0, y1, target, text="source text", x0=50.0, x1=250.0, rotation=0.0, limit=None, column=0):
    return (1, o, column, x0, y0, x1, y1, text, target, 10.0, rotation, 842.0, None, limit)


def test_translations_are_placed_alone(spark):
    got = placed(spark, [row(0, 100.0, 112.0, "short"), row(1, 300.0, 312.0, "word " * 80), row(2, 400.0, 412.0, None), row(3, 420.0, 432.0, "word " * 400, limit=("cell", 40.0, 415.0, 260.0, 440.0))])
    assert set(got) == {0, 1, 3}
    assert (got[0]["size"], got[0]["lines"], got[0]["mode"], got[0]["overflow"]) == (10.0, ["short"], "mono", False)
    assert got[1]["size"] < 10 and got[1]["y1"] <= 400.5 and not got[1]["overflow"]  # down to the next paragraph, which keeps its place
    assert got[3]["clamped"] == "cell" and got[3]["size"] == 5.0 and got[3]["overflow"]
    assert " ".join(got[3]["lines"]).split() == ["word"] * 400


def test_both_languages_or_the_translation_alone(spark):
    got = placed(spark, [row(0, 100.0, 112.0, "short"), row(1, 300.0, 312.0, "fine"), row(2, 308.0, 320.0, "x", x0=200.0, x1=300.0, column=1), row(3, 700.0, 712.0, "word " * 2000)], dual=True)
    assert got[0]["mode"] == "dual" and got[0]["source_lines"] == ["source text"] and got[0]["y0"] < got[0]["target_y0"] < got[0]["y1"]
    assert got[1]["mode"] == "fallback" and got[1]["source_lines"] is None  # would lie on paragraph 2
    assert got[3]["mode"] == "fallback" and got[3]["overflow"]
    count = placement.summary(placement.plan(spark.createDataFrame([row(0, 100.0, 112.0, "short"), row(3, 700.0, 712.0, "word " * 2000)], PLACED), True)).first()
    assert tuple(count) == (1, 2, 1, 1, 0, 0)


def test_upright_and_flipped_text(spark):
    got = placed(spark, [row(0, 100.0, 300.0, "ab cd ef gh", x0=50.0, x1=70.0, rotation=90.0), row(1, 500.0, 512.0, "word " * 60, rotation=180.0)])
    assert got[0]["turn"] == 90 and len(got[0]["lines"]) == 1 and got[0]["size"] == 10.0
    assert got[1]["turn"] == 180 and got[1]["y1"] == 512.0 and got[1]["y0"] < 500.0


def test_plans_of_nothing(spark):
    assert placed(spark, []) == {} and placed(spark, [row(0, 1.0, 2.0, " \n ")], True) == {}


@pytest.mark.parametrize("seed", range(3))
def test_fitting_against_every_size(seed):
    """The size found fits, and no larger one of the row does."""
    rnd = random.Random(seed)
    for _ in range(60):
        text = "".join(rnd.choice("ab 漢字。（」w ") for _ in range(rnd.randrange(1, 120)))
        wide, high, low, top = rnd.uniform(20, 200), rnd.uniform(8, 90), 4.0, rnd.uniform(4, 20)
        size, lines, fits = setting.fitted(text, wide, high, top, low)
        n = 1
        while top > low and (top - low) / n >= setting.FINE and n < 4096:
            n *= 2
        ok = [low + (top - low) * k / n for k in range(n + 1) if len(setting.wrapped(text, wide / (low + (top - low) * k / n))) * (low + (top - low) * k / n) * 1.05 <= high + 0.5]
        assert fits == bool(ok) and size == pytest.approx(max(ok, default=low)) and lines == setting.wrapped(text, wide / size)


def test_room_and_limits(spark):
    rows = [(1, 0, 0.0, 100.0, 50.0, 110.0), (1, 1, 0.0, 105.0, 50.0, 130.0), (1, 2, 0.0, 200.0, 50.0, 210.0), (2, 0, 0.0, 10.0, 50.0, 20.0)]
    got = regions.room(spark.createDataFrame(rows, BOX).withColumn("column", F.lit(0)), F.lit(20.0), F.lit(800.0))
    assert {(r["doc_id"], r["ord"]): (r["above"], r["below"]) for r in got.collect()} == {(1, 0): (80.0, 0.0), (1, 1): (0.0, 70.0), (1, 2): (70.0, 590.0), (2, 0): (0.0, 780.0)}


def test_symbols(spark):
    have = "abcdefghijklmnopqrstuvwxyzADO<=>^0123456789/ •"
    text = "a≤b  x ∅2 ½∉ 漢 ²"
    df = spark.createDataFrame([(text, have)], "t string, g string")
    assert df.select(fonts.drawable(F.col("t"), F.col("g"), True)).first()[0] == "a<=b • x dia2 1/2not in 漢 ^2"
    assert df.select(fonts.drawable(F.col("t"), F.col("g"))).first()[0] == "a≤b • x ∅2 ½∉ 漢 ²"
    assert df.select(fonts.drawable(F.col("t"), F.concat("g", F.lit("Ø")), True)).first()[0].count("Ø2") == 1


def test_space_between_scripts(spark):
    df = spark.createDataFrame([("漢a。b c漢 字", None)], "t string, n string")
    assert df.select(fonts.script_gaps(F.col("t")), fonts.script_gaps(F.lit("abc"))).first()[0:2] == (3, 0)


def test_compatibility_form(spark):
    rows = ["plain", "ﬁne ①Ａ", "é", "é", "x² y", None, "ｶﾞ", "한"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(T.compatible(F.col("t"))).collect()]
    assert got == [None if r is None else unicodedata.normalize("NFKC", r) for r in rows]


def test_names_and_sizes(spark):
    names = {"a/b\\c:d?.pdf": "c_d_.pdf", "": "file", " . ": "file", "con.txt": "_con.txt", "ａ　b.txt": "a b.txt", "x" * 200 + ".pdf": "x" * 116 + ".pdf", "y" * 200: "y" * 120, None: "file"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(P.safe_name(F.col("n"))).collect()] == list(names.values())
    assert [r[0] for r in spark.createDataFrame([("d/report.v1.pdf",), (".pdf",), ("",)], "n string").select(P.stem_of(F.col("n"))).collect()] == ["report.v1", "pdf", "document"]
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 5 * 1024**2: "5.0 MB", 3 * 1024**4: "3072.0 GB", None: "-"}
    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(P.human_size(F.col("n"))).collect()] == list(sizes.values())


def test_glossary_last_target_first_place(spark):
    rows = [(1, 0, "a = x"), (1, 1, "# no"), (1, 2, "b => y"), (1, 3, "a: z"), (1, 4, "junk"), (2, 0, None)]
    got = P.glossary(spark.createDataFrame(rows, "glossary_id long, ord int, line string"))
    assert P.glossary_block(got).collect()[0][1] == "- a → z\n- b → y" and got.count() == 2


def test_settings_file(tmp_path):
    at = str(tmp_path / "settings.json")
    assert store.load_settings(at, {"a": 1}) == {"a": 1}
    store.save_settings(at, {"a": None, "b": {"c": 2}})
    assert store.load_settings(at, {"a": 1, "b": {"c": 0, "d": 3}}) == {"a": 1, "b": {"c": 2, "d": 3}}
    (tmp_path / "settings.json").write_text("{broken")
    assert store.load_settings(at, {"a": 1}) == {"a": 1} and [p.name for p in tmp_path.iterdir()] == ["settings.json"]
    (tmp_path / "settings.json").write_text(json.dumps([1]))
    assert store.load_settings(at, {"a": 1}) == {"a": 1}


def test_running_tasks_are_never_evicted(spark):
    rows = [(k, "running" if k < 3 else "done", k) for k in range(10)]
    got = {r["task_id"] for r in store.kept_tasks(spark.createDataFrame(rows, "task_id int, status string, created_at int"), 5).collect()}
    assert got == {0, 1, 2, 8, 9} and store.kept_tasks(spark.createDataFrame(rows, "task_id int, status string, created_at int"), 2).count() == 3


def test_tables_are_written_and_released(spark):
    t = tables.materialise(spark.range(3), "t")
    assert t.count() == 3
    tables.release(t)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist|FAILED_READ"):
        spark.read.parquet(t.written_at).count()
