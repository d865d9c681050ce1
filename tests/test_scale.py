"""Work that must not grow faster than the input: what is computed once, searched at once, or shuffled as numbers."""

import glob
import random
import time

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import corpus, exports, fonts, placement, replies, setting, structure, verification
from folioforge.plans import catalog, delivery, documents, pages, structure as _, translate  # noqa: F401

CHARS = list("abTx1 .,_-\t\n\r{}") + [chr(x) for x in (0x85, 0xA0, 0x3000, 0x200B, 0xFEFF, 0x6F22, 0x3002, 0xFF0C, 0x1F600, 0x20000, 0xFB01, 0xAC00, 0xE9, 0x2028, 0x7B2C, 0x4E8C, 0x5341, 0x4E07, 0x3007, 0x5E74)]


def mixed(spark, n=3000):
    pick = random.Random(5)
    return spark.createDataFrame([("".join(pick.choice(CHARS) for _ in range(pick.randint(0, 12))),) for _ in range(n)], "t string")


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def python_inputs(plan):
    """Names of the columns that wait in a plan while Python workers run."""
    children = [plan.children().apply(k) for k in range(plan.children().size())]
    own = [a.name() for c in children for a in (c.output().apply(k) for k in range(c.output().size()))] if plan.nodeName() == "ArrowEvalPython" else []
    return own + [n for c in children for n in python_inputs(c)]


def test_documents_of_a_corpus_share_files(spark, tmp_path):
    """a folder and a file for each document took most of the time."""
    docs = spark.range(50).coalesce(2).select(F.col("id").alias("doc_id"), F.concat(F.lit('{"a":"x\\ny\\u2028","b":'), F.col("id").cast("string"), F.lit("}")).alias("document"))
    at = f"{tmp_path}/lines"
    exports.write_lines(docs, at)
    assert len(glob.glob(f"{at}/part-*")) == 2
    got = spark.read.schema("doc_id bigint, a string, b bigint").json(at).collect()
    assert sorted((r.doc_id, r.a, r.b) for r in got) == [(k, "x\ny ", k) for k in range(50)]


def test_segment_files_has_no_folder_a_document(spark, sf):
    catalog.QUERIES["segment_files"](spark, sf).collect()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    assert glob.glob(f"{shared}/folioforge/segments-*/part-*") and not glob.glob(f"{shared}/folioforge/segments-*/doc_id=*")


def test_hashes_of_keys_are_counted_first(spark, monkeypatch):
    """keys as long as lines were shuffled twice. Hashes that keys share change nothing."""
    pick = random.Random(2)
    lines = [f"line {k} " + "x" * (k * 40) for k in range(12)] + ["y", ""]
    rows = [(d, f"s{d % 2}", o, 6, pick.choice(lines)) for d in range(60) for o in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, ord int, n int, line string")
    written, real = [], corpus.materialise
    monkeypatch.setattr(corpus, "materialise", lambda x, name: written.append(x.columns) or real(x, name))
    want = {}
    for d, s, o, n, line in rows:
        if 2 <= len(key := line.replace(" ", "")) <= 300:
            want.setdefault((s, key), [set(), False])
            want[s, key][0].add(d)
            want[s, key][1] |= o in (0, n - 1)
    want = {(s, k, len(p)) for (s, k), (p, edge) in want.items() if len(p) >= (max(2, int(30 * 0.4)) if edge else max(3, int(30 * 0.6)))}
    got = lambda: {tuple(r) for r in corpus.repeated_keys(df, 0.4, 0.6).collect()}
    assert got() == want and want and written == [["source", "hash"]]
    monkeypatch.setattr(corpus.F, "xxhash64", lambda c: F.length(c) % 3)
    assert got() == want


def test_keys_are_cut_without_looking_characters_up(spark):
    """translate() and patterns with many classes ran over every text several times."""
    df = mixed(spark)
    assert "translate(" not in planned(df.select(T.match_key(F.col("t")), T.clean_text(F.col("t"))))
    old = F.regexp_replace(F.translate("t", T.ZERO_WIDTH, ""), f"{T.BLANKS}+", "")
    old = F.lower(F.regexp_replace(F.coalesce(T._nfkc(F.when(old.rlike(f"[^{T.STABLE}]"), old)), old), f"{T.BLANKS}+", ""))
    clean = F.translate(F.replace(F.translate("t", T.ZERO_WIDTH, ""), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    clean = F.btrim(F.regexp_replace(clean, "[ \t　]{2,}", " "), F.lit(T.BLANK_CHARS))
    assert df.where(~T.match_key(F.col("t")).eqNullSafe(old) | (T.clean_text(F.col("t")) != clean)).count() == 0


def test_gaps_are_searched_for(spark):
    """Each two characters of a line were tested. The search finds the same gaps."""
    df = mixed(spark).withColumn("gaps", fonts.script_gaps(F.col("t")))
    assert "regexp_extract_all" in planned(df)
    chars, size = F.split("t", ""), F.greatest(F.lit(0), F.size(F.split("t", "")) - 1)
    each = F.size(F.filter(F.zip_with(F.slice(chars, F.lit(1), size), F.slice(chars, F.lit(2), size), fonts.script_space), lambda g: g > 0))
    assert df.where(F.col("gaps") != each).count() == 0 and df.where("gaps > 1").count() > 100


def test_numerals_are_searched_for(spark):
    """the pattern looked back at every character before it looked at the character."""
    n = T.HAN_NUMERAL
    old = rf"(?<!{n})(?:(?<=第)|(?<![一-鿿])){n}+(?!{n})(?=[{T.HAN_COUNTERS}]|[^一-鿿]|$)"
    df = mixed(spark).select("t", T.han_numerals(F.col("t")).alias("new"), F.transform(F.regexp_extract_all("t", F.lit(old), F.lit(0)), T._han_value).alias("old"))
    assert df.where("new != old").count() == 0 and df.where("size(new) > 0").count() > 100
    assert T.NUMERAL_SEARCH in planned(df)


def test_reasons_are_computed_once(spark, sf):
    """each use of the expression computed it anew."""
    plan = planned(pages._paragraphs(spark, sf))
    assert plan.count("INSERT") == 1
    rows = spark.createDataFrame([("a  b", None)], "text string, kind string")
    assert planned(structure.marked(rows)).count("btrim(") <= 1 and structure.marked(rows.unionAll(rows)).count() == 2


def test_lines_are_counted_no_further_than_asked():
    """every size that was tried set the whole text, and ASCII was measured character by character."""
    pick = random.Random(4)
    for _ in range(300):
        text = "".join(pick.choice("abc de  f\t") for _ in range(pick.randint(0, 40)))
        fast, plain = setting.Setting(text), setting.Setting(text, lambda c: setting.usual_width(c))
        for room in (0.2, 1.0, 2.6, 9.0):
            lines = plain.lines(room)
            assert fast.lines(room) == lines and fast.set(lines) == plain.set(lines)
            assert [fast.count(room, k) for k in (1, 3, 1e9)] == [min(len(lines), k) for k in (1, 3, 1e9)]


def test_text_in_both_languages_is_set_once(spark, sf, monkeypatch):
    """rows were set again for each of two readers."""
    written, real = [], placement.materialise
    monkeypatch.setattr(placement, "materialise", lambda x, name: written.append(name) or real(x, name))
    catalog.QUERIES["placed_pages_dual"](spark, sf)
    assert written == ["sized"]


def test_skeletons_are_made_once(spark, sf, monkeypatch):
    """needles and texts were made again for each of their readers."""
    written, real = [], verification.materialise
    monkeypatch.setattr(verification, "materialise", lambda x, name: written.append(name) or real(x, name))
    for name in ("output_verification", "file_verification"):
        catalog.QUERIES[name](spark, sf)
    assert written == ["needles", "texts"] * 2


@pytest.mark.parametrize("name", ["repeated_lines", "paragraph_kinds"])
def test_lines_leave_the_text_behind(spark, sf, monkeypatch, name):
    """the count of lines was computed behind the generator, so the queues of Python workers held the whole text once a line."""
    seen, real = [], corpus.materialise
    monkeypatch.setattr(corpus, "materialise", lambda x, name: seen.append(x) or real(x, name))
    seen.append(catalog.QUERIES[name](spark, sf))
    queued = [n for df in seen for n in python_inputs(df._jdf.queryExecution().optimizedPlan())]
    assert "line" in queued and "text" not in queued


def test_lines_count_those_of_their_text(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, None), (4, "x\n")], "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    got = sorted((r.doc_id, r.ord, r.n, r.line) for r in corpus.lines(df).collect())
    assert got == [(1, 0, 3, "a"), (1, 1, 3, ""), (1, 2, 3, "b"), (2, 0, 1, ""), (4, 0, 2, "x"), (4, 1, 2, "")]


def test_numbers_are_read_once(spark):
    """the readings of a target were made anew for each number of its source, and for numbers that stand in both alike."""
    few = spark.createDataFrame([("1.50 5 7 第二十条 7", "1,5 7 第二十条"), ("三百人 8", "300 8"), ("no", "1"), ("1, 5", "1,5")], "s string, t string")
    assert [r.m for r in few.select(T.missing_numbers(F.col("s"), F.col("t")).alias("m")).collect()] == [["5"], [], [], []]
    digits = " ".join(str(k) for k in range(2000))
    many = spark.createDataFrame([(digits, digits.replace(" ", ", ").replace("1999", "x"))], "s string, t string")
    began = time.monotonic()
    assert many.select(T.missing_numbers(F.col("s"), F.col("t")).alias("m")).first().m == ["1999"]
    assert time.monotonic() - began < 20
    assert T.NUMERAL_SEARCH in planned(few.select(T.missing_numbers(F.col("s"), F.col("t")))).split("CASE WHEN")[1]


def test_reasons_and_keys_are_written_once(spark, monkeypatch):
    """reasons and keys were computed for the texts and again for the paragraphs, and answers without a fault were read,
    checked and written twice."""
    written, real = {}, translate.materialise
    monkeypatch.setattr(translate, "materialise", lambda x, name: written.setdefault(name, real(x, name)))
    df = spark.createDataFrame([(1, 0, "Hello  World 5"), (1, 1, "12"), (2, 0, "hello world 5")], "doc_id long, ord int, line string")
    out = translate.translate(df)
    assert sorted((r.doc_id, r.ord, r.target) for r in out.collect()) == [(1, 0, "hELLO wORLD 5"), (1, 1, None), (2, 0, "hELLO wORLD 5")]
    assert list(written) == ["judged", "asked", "answered"] and written["answered"].count() == 0 and written["asked"].count() == 1
    assert "INSERT" not in planned(out)


def test_replies_that_parse_are_read_once(monkeypatch):
    """every reply was searched for fences, arrays, objects and commas before it was parsed."""
    seen, real = [], replies.re.sub
    monkeypatch.setattr(replies.re, "sub", lambda *a, **k: seen.append(a) or real(*a, **k))
    assert replies.read_reply('[{"i": 1, "t": "a ,] b"}]') == {1: "a ,] b"} and not seen
    assert replies.read_reply('Here: [{"i": 1, "t": "a"},]') == {1: "a"} and seen
    assert replies.read_reply('```json\n{"1": "x"}\n```') == {1: "x"} and replies.read_reply(None) == {}
