import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from folioforge.operators import corpus, exports, fonts, placement, setting, structure, verification
from folioforge.plans import translate
from folioforge.sources import providers
from folioforge.sources import spans as source
from folioforge.sources.cache import Cache
from folioforge.sources.jobs import Job
from folioforge.streaming import uploads

PLACED = """doc_id long, ord int, column int, x0 double, y0 double, x1 double, y1 double, text string, target string, size double, rotation double, height double, pitch double,
limit struct<kind:string,x0:double,y0:double,x1:double,y1:double>, first double, align string, starts array<struct<x:double,y:double>>, dir_x double, dir_y double"""


def lines_of(spark, rows, dual=False):
    plans = placement.plan(spark.createDataFrame(rows, PLACED), dual)
    out = {}
    for r in placement.placed_lines(plans).orderBy("ord", "part", "line").collect():
        out.setdefault(r["ord"], []).append(r)
    return out, {r["ord"]: r for r in plans.collect()}


def row(o, box, target, rotation=0.0, pitch=None, first=None, align="left", starts=None, direction=(1.0, 0.0), text="source"):
    return (1, o, o, *box, text, target, 10.0, rotation, 842.0, pitch, None, first, align, starts, *direction)


def test_upright_lines_keep_the_baselines_of_their_source(spark):
    got, plans = lines_of(spark, [row(0, (50.0, 100.0, 110.0, 140.0), "aaaa bbbb cccc dddd eeee", pitch=13.0, first=109.0), row(1, (50.0, 300.0, 110.0, 340.0), "aaaa bbbb cccc dddd")])
    ys = [r["y"] for r in got[0]]
    assert ys[0] == 109.0 and all(b - a == pytest.approx(13.0) for a, b in zip(ys, ys[1:], strict=False)) and len(ys) > 1
    assert plans[0]["y0"] == pytest.approx(109.0 - placement.ASCENT * plans[0]["size"])
    assert got[1][0]["y"] == pytest.approx(300.0 + placement.ASCENT * plans[1]["size"])  # none known: from the top of the box
    assert all((r["ax"], r["ay"], r["sx"], r["sy"]) == (1, 0, 0, 1) and r["x"] == 50.0 for r in got[0] + got[1])


def test_turned_lines_begin_at_the_origin_of_their_source_and_stack_to_its_side(spark):
    up, down = [{"x": 60.0, "y": 290.0}, {"x": 72.0, "y": 290.0}], [{"x": 68.0, "y": 100.0}, {"x": 80.0, "y": 100.0}]
    box = (50.0, 100.0, 90.0, 300.0)
    text = "word " * 14
    got, plans = lines_of(spark, [row(0, box, text, -90.0, starts=up, direction=(0.0, -3.0)), row(1, box, text, 90.0, starts=down, direction=(0.0, 1.0)), row(2, box, text, 90.0, direction=(0.0, 0.0))])
    assert {o: plans[o]["turn"] for o in plans} == {0: 270, 1: 90, 2: 90}
    assert [(r["x"] - 60.0, r["y"]) for r in got[0]] == [(pytest.approx(k * plans[0]["step"]), 290.0) for k in range(len(got[0]))]
    assert (got[0][0]["ax"], got[0][0]["ay"]) == (0, -1)
    # a source whose second line lies to the right stacks to the right, though its direction alone says left
    assert len(got[1]) > 1 and all(r["x"] >= 68.0 and r["sx"] == 1 for r in got[1])
    assert all(r["sx"] == -1 and r["x"] <= 90.0 for r in got[2])  # no source: the box
    for o in (0, 1, 2):
        assert all(r["width"] <= 200.0 for r in got[o]) and " ".join(r["text"] for r in got[o]).split() == ["word"] * 14
        assert plans[o]["y0"] == 100.0 and plans[o]["y1"] == 300.0


def test_text_on_its_head_is_turned_around_the_middle_of_its_box(spark):
    box = (50.0, 100.0, 150.0, 130.0)
    got, _ = lines_of(spark, [row(0, box, "aaaa bbbb"), row(1, box, "aaaa bbbb", 180.0, direction=(-1.0, 0.0))])
    a, b = got[0][0], got[1][0]
    assert (b["x"], b["y"]) == (pytest.approx(200.0 - a["x"]), pytest.approx(230.0 - a["y"])) and (b["ax"], b["sy"]) == (-1, -1)


def test_alignment_and_tracking(spark):
    box = (50.0, 100.0, 150.0, 112.0)
    got, plans = lines_of(spark, [row(0, box, "abcd", align="center"), row(1, box, "abcd", align="right"), row(2, (50.0, 100.0, 135.0, 130.0), "漢" * 12, first=110.0)])
    assert got[0][0]["x"] == pytest.approx(50 + (100 - 20) / 2) and got[1][0]["x"] == pytest.approx(130)
    assert plans[2]["size"] == 10.0 and plans[2]["tracking"] == [pytest.approx(5 / 7), 0.0] and got[2][0]["width"] == pytest.approx(85.0)


def test_both_languages_share_one_frame(spark):
    box = (50.0, 100.0, 150.0, 112.0)
    got, plans = lines_of(spark, [row(0, box, "target", text="one\ntwo")], dual=True)
    parts = {(r["part"], r["line"]): r["y"] for r in got[0]}
    assert plans[0]["mode"] == "dual" and parts["source", 0] < parts["source", 1] < parts["target", 0]
    assert parts["target", 0] - parts["source", 0] == pytest.approx(plans[0]["skip"])


def test_space_between_scripts_is_part_of_a_line():
    assert setting.measured("漢a") == 1.75 and setting.measured("。a") == 1.5 and setting.measured("漢 a") == 2.0 and setting.measured("") == 0.0
    assert setting.wrapped("漢a漢a", 3.5) == ["漢a漢", "a"] or setting.wrapped("漢a漢a", 3.5) == ["漢a", "漢a"]
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choices("漢字ab c。，（1", k=rnd.randrange(40)))
        room = rnd.uniform(2, 9)
        lines = setting.wrapped(text, room)
        assert "".join("".join(lines).split()) == "".join(text.split())
        for line in lines:
            bare = line.rstrip("".join(setting.NOT_FIRST) + " ")
            assert setting.measured(bare) <= room + 1e-6


def test_faces_of_symbols(spark):
    kinds = "name string, subset_safe boolean, variable boolean, light boolean, cjk_ok boolean, ascii_ok boolean"
    faces = spark.createDataFrame([("b plain", True, False, False, True, True), ("a light", True, False, True, True, True), ("simsun", True, False, False, True, True), ("unsafe", False, False, False, True, True)], kinds)
    coverage = spark.createDataFrame([("b plain", 0x2190, 0x21FF), ("a light", 0, 0x2FFF), ("simsun", 0x21FF, 0x2300), ("unsafe", 0, 0x10FFFF)], "name string, first int, last int")
    codes = spark.createDataFrame([(0x2192,), (0x21FF,), (0x41,), (0x1F600,)], "code int")
    assert dict(map(tuple, fonts.symbol_faces(codes, faces, coverage).collect())) == {0x2192: "b plain", 0x21FF: "simsun", 0x41: "a light", 0x1F600: "unsafe"}
    assert fonts.symbol_faces(codes.limit(0), faces, coverage).count() == 0 and fonts.symbol_faces(codes, faces.limit(0), coverage).count() == 0
    texts = spark.createDataFrame([(1, "a→b漢"), (2, None), (3, "")], "id int, text string")
    assert [r[0] for r in fonts.lacking(texts, spark.createDataFrame([(0, 255)], "first int, last int")).orderBy("code").collect()] == [0x2192, 0x6F22]


def test_runs_of_faces(spark):
    rows = spark.createDataFrame([(1, "a→b漢字。c x"), (2, "plain"), (3, ""), (4, None), (5, "漢→→")], "id int, text string")
    chosen = spark.createDataFrame([(0x2192, "Sym")], "code int, name string")
    got = fonts.face_runs(fonts.with_symbols(rows, ["id"], chosen), ["id"]).orderBy("id", "run").collect()
    assert [(r["id"], r["face"], r["text"], r["x"], r["width"]) for r in got] == [
        (1, "latin", "a", 0.0, 0.5), (1, "Sym", "→", 0.5, 0.5), (1, "latin", "b", 1.0, 0.5), (1, "han", "漢字。", 1.75, 3.0), (1, "latin", "c x", 4.75, 1.5),
        (2, "latin", "plain", 0.0, 2.5), (5, "han", "漢", 0.0, 1.0), (5, "Sym", "→→", 1.25, 1.0),
    ]
    for text, end in (("a→b漢字。c x", 6.25), ("漢→→", 2.25)):
        assert setting.measured(text) == end  # as lines are measured when they are broken


def test_lines_are_cut_by_script_and_symbol(spark):
    """Faces are looked up for stretches of a line and for single symbols, not for each character."""
    rows = spark.createDataFrame([("some words→→漢字]^x😀", {"→": "Sym", "]": "Sym", "^": "Sym", "字": "Sym"}), ("ab漢字。c", None), ("one", {}), ("", None)], "text string, symbols map<string, string>")
    got = [r[0] for r in rows.select(fonts.units(F.col("text"), F.col("symbols"))).collect()]
    assert got == [["some words", "→", "→", "漢", "字", "]", "^", "x😀"], ["ab", "漢字。", "c"], ["one"], []]


def test_files_are_verified(spark):
    rows = [("f", 0, 0, "one", "first text", True, False), ("f", 0, 1, "two", "not there", True, False), ("f", 1, 2, "three", "on blank page", True, False), ("f", 1, 3, "kept original", None, True, False), ("f", 1, 4, "lost original\nline", "", True, False), ("f", 1, 5, "recognised", None, True, True), ("f", 0, 6, "code", None, False, False), ("f", 0, 7, "dash", "—", True, False), ("g", 0, 0, "no page", "at all", True, False), (None, 0, 0, "x", "y", None, None)]
    kinds = "file_id string, page int, id long, text string, target string, translatable boolean, from_ocr boolean"
    pages = spark.createDataFrame([("f", 0, "First: First  text! kept"), ("f", 1, " \n"), ("f", 2, "on blank pa"), ("f", 3, "ge, kept original"), ("f", 0, None)][:4], "file_id string, page int, text string")
    pages = pages.withColumn("text", F.replace("text", F.lit("First  text"), F.lit("first  text")))
    got = {r["file_id"]: tuple(r)[1:] for r in verification.verified_files(spark.createDataFrame(rows, kinds), pages).collect()}
    assert got == {"f": (4, 1, ["two"], 2, 1, ["lost original line"]), "g": (1, 1, ["no page"], 0, 0, [])}
    assert verification.verified_files(spark.createDataFrame([], kinds), pages).count() == 0


def test_verification_is_linear(spark):
    rnd = random.Random(1)
    lines = ["".join(rnd.choices("abcdefghij", k=60)) for _ in range(20_000)]
    text = "".join(lines)
    asked = set(lines) | {x[1:] + "Z" for x in lines}
    began = time.time()
    assert verification.holds(text, asked) == set(lines) and time.time() - began < 20
    assert verification.holds("aXbX", {"X", "XbX", "bX", "q"}) == {"X", "XbX", "bX"} == verification.holds("aXbX", {"X", "XbX", "bX", *map(str, range(20))})


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value string")


def test_versions_of_a_cache(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "cache"))
    assert c.read().count() == 0 and c.version() == 0 and c.compact() == 0 and c.vacuum() == 0
    assert c.apply(table(spark, ("a", "1"), ("a", "2"), ("b", "1"), (None, "x"), ("blank", " "), ("none", None))) == 1
    assert dict(map(tuple, c.read().collect())) == {"a": "2", "b": "1"}
    assert c.apply(table(spark, ("c", "3"), ("b", "new")), table(spark, ("a", ""), ("c", ""), ("unknown", ""))) == 2
    want = {"b": "new", "c": "3"}
    assert dict(map(tuple, c.read().collect())) == want
    old = c.read()
    assert c.compact() == 2 and c.tables() == [(2, "base")] and dict(map(tuple, old.collect())) == want  # readers are not disturbed
    assert c.apply(drop=table(spark, ("b", ""))) == 3 and c.vacuum() == 2
    assert dict(map(tuple, c.read().collect())) == {"c": "3"} and c.compact() == 3 and c.compact() == 3
    assert c.apply(table(spark, ("z", "1")), version=3) == 3 and c.read().count() == 1  # a version that is there stays
    with pytest.raises(Exception, match="(?i)exist"):
        c._commit(table(spark, ("late", "1")), "base", 3)  # the second writer of a version
    assert c.read().count() == 1 and c.vacuum() == 2


def test_a_stopped_job_leaves_the_table_as_it_was(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "cache"))
    c.apply(table(spark, ("a", "1")))

    def slow(session):
        @F.udf("string")
        def wait(x):
            time.sleep(0.2)
            return str(x)

        return c.apply(session.range(0, 4000, 1, 400).select(F.col("id").cast("string").alias("key"), wait("id").alias("value")))

    job = Job(spark, "slow-job", slow)
    while job.progress()[0] == 0:
        time.sleep(0.1)
    time.sleep(1.0)
    jobs, done, known = job.progress()
    assert job.status == "running" and jobs >= 1 and 0 <= done < known
    job.cancel()
    assert job.wait() == "cancelled" and c.version() == 1 and c.read().count() == 1
    assert Job(spark, "quick", lambda s: s.range(3).count()).wait() == "done"
    assert spark.range(5).count() == 5  # other work of the session goes on
    broken = Job(spark, "broken", lambda s: s.table("no_such_table"))
    assert broken.wait() == "error" and broken.error is not None


def test_errors_are_kept_and_repeats_counted(spark, tmp_path):
    def make():
        def chat(message, hint):
            items = json.loads(message)
            if any("refuse" in x["t"] for x in items):
                raise PermissionError("status 401: no key")
            return json.dumps([{"i": x["i"], "t": x["t"].upper() if hint or "guard" not in x["t"] else "none"} for x in items])

        return chat

    providers.PROVIDERS["refusing"] = make
    try:
        rows = [(1, 0, "please refuse this"), (1, 1, "good words"), (1, 2, "guard 4 words"), (1, 3, "cached words 5"), (1, 4, "stale words 6"), (1, 5, "12")]
        df = spark.createDataFrame(rows, "doc_id long, ord int, line string")
        c = Cache(spark, str(tmp_path / "cache"))
        c.apply(table(spark, ("cachedwords5", "from cache 5"), ("stalewords6", "lost its number")))
        out, seen = translate.translate_with(df, c, "refusing")
        got = {r["ord"]: (r["target"], r["error"]) for r in out.collect()}
        assert got[0] == (None, "PermissionError: status 401: no key")
        assert got[1][0] == "GOOD WORDS" and got[2][0] == "GUARD 4 WORDS" and got[3][0] == "from cache 5" and got[4][0] == "STALE WORDS 6" and got[5] == (None, None)
        assert {k: seen[k] for k in ("texts", "cache_hits", "dropped", "translated", "failed", "numeric_mismatched")} == {"texts": 5, "cache_hits": 1, "dropped": 1, "translated": 4, "failed": 1, "numeric_mismatched": 2}
        assert seen["retries"] >= 4
        assert dict(map(tuple, c.read().collect())) == {"cachedwords5": "from cache 5", "stalewords6": "STALE WORDS 6", "goodwords": "GOOD WORDS", "guard4words": "GUARD 4 WORDS"}
        again, seen = translate.translate_with(df.where("ord > 0"), c, "refusing")
        assert seen["cache_hits"] == seen["texts"] == 4 and seen["retries"] == 0 and again.where("target is not null").count() == 4
        c.apply(table(spark, ("pleaserefusethis", "stale too")))
        none, seen = translate.translate_with(spark.createDataFrame([(1, 0, "please refuse this 7")], df.schema), Cache(spark, c.path), "refusing")
        assert seen["failed"] == 1 and none.first()["target"] is None
    finally:
        del providers.PROVIDERS["refusing"]


def test_patient_calls_are_counted():
    left = [TimeoutError(), ConnectionError()]

    def chat(message, hint):
        if left:
            raise left.pop()
        return json.dumps([{"i": x["i"], "t": "t"} for x in json.loads(message)])

    assert translate.asked(providers.patient(chat, pause=0), ["a", "b"]) == [("t", None, 2), ("t", None, 0)]
    assert translate.asked(lambda m, h: "[]", ["a"]) == [(None, translate.NO_ANSWER, 3)]


def test_bad_cached_values_are_dropped_for_good(spark, tmp_path):
    providers.PROVIDERS["mute"] = lambda: lambda message, hint: "[]"
    try:
        c = Cache(spark, str(tmp_path / "cache"))
        c.apply(table(spark, ("page4", "no number")))
        out, seen = translate.translate_with(spark.createDataFrame([(1, 0, "the page 4"), (1, 1, "page 4 x")], "doc_id long, ord int, line string"), c, "mute")
        assert seen["dropped"] == 0 and c.read().count() == 1
        c.apply(table(spark, ("thepage4", "no number")))
        out, seen = translate.translate_with(spark.createDataFrame([(1, 0, "the page 4")], "doc_id long, ord int, line string"), c, "mute")
        assert (seen["dropped"], seen["failed"], out.first()["error"]) == (1, 1, translate.NO_ANSWER) and "thepage4" not in dict(map(tuple, c.read().collect()))
    finally:
        del providers.PROVIDERS["mute"]


def test_keys_of_the_cache(spark):
    key = lambda **o: spark.range(1).select(corpus.cache_key(F.lit("a  text"), **o)).first()[0]
    assert key() == key(prompt=" ", glossary="") and key(prompt="p") == key(prompt=" p ")
    assert len({key(), key(prompt="p"), key(glossary="p"), key(prompt="p", glossary="g"), key(model="m"), key(target="ja")}) == 6


def upload(folder, name, body=b"x"):
    (folder / name).write_bytes(body)


def test_uploads_are_registered_once_across_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = {k: str(tmp_path / k) for k in ("registry", "refused", "checkpoint")}

    def run(keep=3):
        uploads.follow(uploads.files(spark, str(folder), 2), at["registry"], at["refused"], at["checkpoint"], keep, most=100, once=True).awaitTermination()
        return {r["name"] for r in uploads.registered(Cache(spark, at["registry"])).collect()}

    upload(folder, "a.pdf", b"aa")
    upload(folder, "b.PDF", b"bb")
    upload(folder, "notes.txt", b"cc")
    upload(folder, "large.pdf", b"d" * 101)
    assert run() == {"a.pdf", "b.PDF"}
    assert {(r["name"], r["reason"]) for r in spark.read.parquet(at["refused"]).collect()} == {("notes.txt", "not a PDF"), ("large.pdf", "too large")}
    version = Cache(spark, at["registry"]).version()
    assert run() == {"a.pdf", "b.PDF"} and Cache(spark, at["registry"]).version() == version  # nothing new: nothing done
    time.sleep(1.1)
    upload(folder, "copy.pdf", b"aa")  # the same file again
    upload(folder, "c.pdf", b"c1")
    time.sleep(1.1)
    upload(folder, "d.pdf", b"d1")
    got = run()
    assert len(got) == 3 and {"c.pdf", "d.pdf"} <= got and "copy.pdf" not in got


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("f3", "empty.pdf", 1, 0), ("f1", "a.pdf", 1, 5), ("f1", "b.pdf", 0, 5), (None, "c.pdf", 0, 5), ("f2", None, 0, 5)], "file_id string, name string, t int, size long")
    rows = rows.select("file_id", "name", F.timestamp_seconds("t").alias("uploaded_at"), "size")
    assert uploads.register(c, rows, 1) == 1 and uploads.register(c, rows.limit(0), 1) == 1
    assert [(r["file_id"], r["name"]) for r in uploads.registered(c).collect()] == [("f1", "b.pdf")]


def test_pages_that_cannot_be_read(spark, tmp_path):
    good = json.dumps({"width": 100.0, "spans": [{"text": "a", "line": 1}, {"text": "b", "size": 8.0}]})
    rows = [("f", 0, good), ("f", 1, good[:-4]), ("f", 2, None), ("f", 3, " "), ("f", 4, "{}"), ("f", 5, '{"spans": null, "more": 1}'), ("f", 6, "[1]"), ("f", 7, '{"width": "wide"}')]
    spans, pages, warnings = source.parsed(spark.createDataFrame(rows, "file_id string, page int, body string"))
    assert sorted((r["page"], r["text"], r["size"]) for r in spans.collect()) == [(0, "a", 10.0), (0, "b", 8.0)]
    assert {r["page"]: r["width"] for r in pages.collect()} == {0: 100.0} | {p: 595.0 for p in range(1, 8)}
    told = {r["page"]: r["warning"] for r in warnings.collect()}
    assert {1, 2, 3, 7} <= set(told) and {0, 4, 5}.isdisjoint(told) and told[1] == "page 2 could not be read"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('{"file_id": "f", "text": "t"}\n{broken\n')
    read, rejected = source.read_with_rejects(spark, str(tmp_path / "s"))
    assert [r["text"] for r in read.collect()] == ["t"] and [tuple(r) for r in rejected.collect()] == [("x.json", "{broken")]


def test_marks(spark):
    rows = [(0, " \n", "text"), (1, "Chapter", "header"), (2, "7", "page_num"), (3, "def f(x):", "title"), (4, "12 / 5", "text"), (5, "汉字文本内容", "text"), (6, "plain words", None), (7, "now text", "empty"), (8, None, "footer")]
    df = spark.createDataFrame(rows, "id int, text string, kind string")
    got = {r["id"]: (r["kind"], r["translatable"], r["skip_reason"]) for r in structure.marked(df).collect()}
    assert got == {0: ("empty", False, "empty"), 1: ("header", False, "header"), 2: ("page_num", False, "page_num"), 3: ("code", False, "code"), 4: ("code", False, "not_translatable"), 5: ("text", False, "already_target"), 6: ("text", True, ""), 7: ("text", True, ""), 8: ("empty", False, "empty")}
    free = {r["id"]: r["skip_reason"] for r in structure.marked(df, skip_edges=False, skip_other=False).collect()}
    assert free == {k: "" for k in range(9)} | {0: "empty", 8: "empty"}
    assert structure.marked(df, "de").where("id = 5").first()["translatable"]
    files = structure.marked(df).withColumns({"file_id": F.when(F.col("id") == 6, "a").otherwise("b"), "page": F.lit(1)})
    wanted = spark.createDataFrame([("a", 0), ("a", 0)], "file_id string, page int")
    assert {r["id"]: r["skip_reason"] for r in structure.in_pages(files, wanted).where("id in (6, 7)").collect()} == {6: "page_range", 7: ""}


def test_statistics_of_files_without_paragraphs(spark):
    pages = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "file_id string, page int")
    rows = spark.createDataFrame([("b", 0, "text", "words", 9.0, 2, True, None), ("b", 1, "code", "x", 20.0, 1, False, True)], "file_id string, page int, kind string, text string, size double, columns int, translatable boolean, from_ocr boolean")
    told = spark.createDataFrame([("a", 3, "late"), ("a", 1, "early")], "file_id string, page int, warning string")
    got = {r["file_id"]: tuple(r)[1:] for r in structure.document_statistics(rows, pages, told).collect()}
    assert got == {"a": (1, 0, 0, 0, {}, 1, 0.0, 0, 0, ["early", "late"]), "b": (2, 2, 1, 5, {"code": 1, "text": 1}, 2, 9.0, 1, 1, [])}


def test_files_of_segments(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, "text", "a\nb", "t", None, 5), (1, 1, 0, "code", "x", None, "code", 0), (2, 0, 3, "text", "c", None, "", 2)], "doc_id long, ord int, page int, kind string, text string, target string, reason string, tokens int")
    documents = spark.createDataFrame([(1, "one.pdf", "mock"), (2, None, None), (3, "none.pdf", "mock")], "doc_id long, filename string, provider string")
    at = str(tmp_path / "out")
    exports.write_documents(exports.segment_documents(rows, documents, "now"), at)
    got = {int(d.name.split("=")[1]): [json.loads(f.read_text()) for f in d.glob("part-*")] for d in (tmp_path / "out").glob("doc_id=*")}
    assert all(len(v) == 1 for v in got.values()) and set(got) == {1, 2, 3}
    one = got[1][0]
    assert (one["filename"], one["generated"], one["config"]) == ("one.pdf", "now", {"provider": "mock", "model": None, "target_lang": None, "mode": None})
    assert one["stats"] == {"paragraphs": 1, "translated": 1, "failed": 0, "skipped": 1, "tokens": 5, "cache_hits": 0, "retries": 0, "numeric_mismatched": 0}
    assert [(s["id"], s["page"], s["source"], s["target"], s["translatable"]) for s in one["segments"]] == [(0, 1, "a b", "t", True), (1, 1, "x", "", False)]
    assert got[3][0]["segments"] == [] and got[3][0]["stats"]["paragraphs"] == 0
    exports.write_documents(exports.segment_documents(rows.where("doc_id = 2"), documents.where("doc_id = 2"), "later"), at)
    assert json.loads(next((tmp_path / "out" / "doc_id=2").glob("part-*")).read_text())["generated"] == "later" and next((tmp_path / "out" / "doc_id=1").glob("part-*")).exists()


def test_angles_are_unit_vectors(spark):
    rows = [row(0, (0.0, 0.0, 10.0, 10.0), "t", 45.0, starts=[{"x": 1.0, "y": 2.0}], direction=(3.0, 4.0))]
    from folioforge.operators import frames

    got = spark.createDataFrame(rows, PLACED).select(frames.frame(F.col("starts"), F.col("dir_x"), F.col("dir_y"), F.lit(100.0), F.lit(50.0)).alias("f")).first()["f"]
    assert math.isclose(got["ax"], 0.6) and math.isclose(got["ay"], 0.8) and math.isclose(got["sx"], -0.8) and math.isclose(got["run"], 100 * 0.6 + 50 * 0.8)


def test_repeated_keys_join_alike_with_and_without_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("s", "key", 1), ("s", "", 2), ("s", None, 3), ("t", "key", 4), ("s", "key", 5)], "source string, key string, n int")
    repeated = spark.createDataFrame([("s", "key", 3)], "source string, key string, pages int")
    got = []
    for most in (10, 0):
        monkeypatch.setattr(corpus, "BROADCAST_ROWS", most)
        got.append(sorted((r["n"], r["repeated"]) for r in corpus.with_repeated(rows, repeated).collect()))
    assert got[0] == got[1] == [(1, True), (2, None), (3, None), (4, None), (5, True)]
