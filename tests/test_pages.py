import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import corpus, exports, layout, replies
from folioforge.sources import store
from folioforge.streaming import arrivals

BOX = "doc_id long, ord int, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('[{"i": 1, "t": "a"}, {"i": 2, "t": " b "}]', {1: "a", 2: "b"}),
        ('Sure:\n```json\n[{"index": 3, "text": "c"},]\n```', {3: "c"}),
        ('{"1": "a", "2": {"t": "b"}}', {1: "a", 2: "b"}),
        ('{"translations": ["x", "y"]}', {1: "x", 2: "y"}),
        ('[{"i": 1, "t": "a"} {"i": 2, "t": "b\\n"}]', {1: "a", 2: "b"}),
        ('{"t": "a", "i": 7', {7: "a"}),
        ("1. one\n[2]、two\nthree", {1: "one", 2: "two"}),
        ('[{"i": "no", "t": "a"}, {"i": 1e999, "t": "b"}]', {1: "a", 2: "b"}),
        ('["\\ud800"]', {1: "?"}),
        ("9" * 5000 + ". x", {}),
        ("[]", {}),
        ("  ", {}),
        (None, {}),
    ],
)
def test_replies(reply, want):
    assert replies.read_reply(reply) == want


def test_replies_of_rows(spark):
    rows = spark.createDataFrame([(1, '["a", ""]'), (2, None), (None, "2. b")], "k long, r string")
    assert sorted((tuple(x) for x in replies.read_replies(rows, "k", "r").collect()), key=repr) == [(1, 1, "a"), (None, 2, "b")]
    assert replies.read_replies(rows.limit(0), "k", "r").count() == 0


def test_pieces_hold_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcd。.! \n") for _ in range(rng.randrange(400)))
        got = replies.long_pieces(text, 20)
        assert all(len(p) <= 20 for p in got)
        assert "".join("".join(got).split()) == "".join(text.split())
        assert "  " in text or "\n" in text or "".join(got) == text.strip()
    assert replies.long_pieces("x" * 1600) == ["x" * 1600]
    assert [len(p) for p in replies.long_pieces("x" * 1601)] == [1600, 1]
    assert replies.long_pieces(None) == [""]


def test_two_columns_are_read_one_after_the_other():
    box = np.array([[300, 50, 500, 70], [40, 50, 240, 70], [300, 80, 500, 100], [40, 80, 240, 100], [40, 10, 500, 30]], float)
    order, columns = layout.cut_order(box, 600)
    assert order == [4, 1, 3, 0, 2] and columns == 2
    assert layout.cut_order(box[:0], 600) == ([], 0)
    assert layout.cut_order(np.repeat(box[:1], 9, 0), 600) == (list(range(9)), 1)


def test_order_of_pages(spark):
    rows = spark.createDataFrame([(1, 0, 300.0, 50.0, 500.0, 70.0), (1, 1, 40.0, 50.0, 240.0, 70.0), (2, 0, 0.0, 0.0, 1.0, 1.0)], BOX)
    got = {(r.doc_id, r.ord): r.reading_ord for r in layout.reading_order(rows, 600).collect()}
    assert got == {(1, 0): 1, (1, 1): 0, (2, 0): 0}
    assert layout.reading_order(rows.limit(0), 600).count() == 0


def test_paragraphs_that_go_on(spark):
    def p(ord_, y0, x1, size=10.0, bold=False, kind="text", x0=40.0):
        return (1, ord_, 0, kind, size, 0, bold, x0, float(y0), x1, y0 + 10.0, x0, x1)

    rows = [p(0, 0, 240.0), p(1, 12, 100.0), p(2, 24, 240.0), p(3, 36, 240.0, bold=True), p(4, 48, 240.0), p(5, 80, 240.0), p(6, 92, 240.0, x0=70.0), p(7, 104, 240.0, size=12.0), p(8, 116, 240.0, kind="code")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, column int, kind string, size double, color int, bold boolean, x0 double, y0 double, x1 double, y1 double, first_x0 double, last_x1 double")
    got = {r.ord: r.lead for r in layout.merged_paragraphs(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}


def test_table_rows(spark):
    lines = [(1, 0.0, 60.0, 100.0), (1, 10.0, 61.5, 120.0), (1, 0.0, 100.0, 90.0), (1, 0.0, 103.0, 90.0), (2, 0.0, 1.0, 9.0), (2, 0.0, 30.0, 9.0)]
    got = layout.table_rows(spark.createDataFrame(lines, "doc_id long, x0 double, y double, x1 double")).collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 60.0, 120.0, 100.0)]


def test_room_below_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(d, k, float(rng.choice([0, 50])), y := float(rng.randrange(90)), 60.0, y + rng.randrange(1, 9)) for d in range(3) for k in range(40)]
    got = {(r.doc_id, r.ord): r.room for r in corpus.room_below(spark.createDataFrame(rows, BOX), 100.0).collect()}
    for d, k, x0, y0, _, y1 in rows:
        under = [b[3] for b in rows if b[0] == d and b[2] == x0 and b[3] + b[5] > y0 + y1]
        assert got[d, k] == max(0.0, min(under, default=100.0) - y1)


def test_numbers_split_by_a_space_and_written_out(spark):
    pairs = [("0,75 x 0, 5", "0.75 x 0.5", []), ("0, 5 and 7", "0.5", ["0", "5", "7"]), ("第五条", "Article 5", []), ("二十三种", "Kinds: 24", ["23"]), (None, "1", []), ("1", None, ["1"])]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a string, b string")
    got = {r.k: r.m for r in df.select("k", T.missing_numbers(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(pairs)}


def test_pages_as_text_and_back(spark):
    df = spark.createDataFrame([([],), ([0],), ([0, 1, 2, 7],)], "p array<int>").select(T.format_pages(F.col("p")).alias("s"))
    assert [r.s for r in df.collect()] == ["-", "1", "1-3,8"]


def test_exports(spark):
    rows = [(1, 0, 0, "header", "h", None, None), (1, 1, 0, "text", "a\nb", "A", None), (1, 2, 1, "code", "x=1", None, "code"), (1, 3, 1, "text", "c", None, None), (2, 0, 0, "text", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, page int, kind string, text string, target string, reason string")
    got = {r.doc_id: r.markdown for r in exports.markdown(df).collect()}
    assert got == {1: "## 第 1 页\n\n**原文**：a b\n\n**译文**：A\n\n## 第 2 页\n\n```\nx=1\n```\n\n**原文**：c\n\n**译文**：（未翻译）\n", 2: "\n"}
    assert {r.doc_id: r.text for r in exports.plain_text(df).collect()}[1] == "===== 第 1 页 =====\n\nA\n"


def test_settings_and_history(spark):
    assert store.merged_settings({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}, "d": None, "e": 3}) == {"a": {"b": 1, "c": [2]}, "d": 2, "e": 3}
    tasks = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "task_id string, finished_at int")
    assert [tuple(r) for r in store.history(tasks).collect()] == [("x", 3), ("y", 2)]


def test_stream_drops_repeated_paragraphs(spark, tmp_path):
    rows = spark.sql("select * from values (1L, timestamp'2024-01-01 00:00:00', 'A b\nc'), (2L, timestamp'2024-01-01 00:01:00', 'ab\n\nd') as t(doc_id, at, text)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = arrivals.fresh_paragraphs(arrivals.arriving(spark, str(tmp_path / "in"), rows.schema), "at")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ab", "c", "d"]


def test_requests_are_json(spark):
    got = spark.createDataFrame([(["a", 'q"'],)], "x array<string>").select(replies.request(F.col("x")).alias("r")).first().r
    assert json.loads(got) == [{"i": 1, "t": "a"}, {"i": 2, "t": 'q"'}]
