import http.server
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import style
from folioforge.operators import exports, layout, setting, verification
from folioforge.operators import structure as S
from folioforge.sources import providers

BOX = "doc_id long, ord int, x0 double, y0 double, x1 double, y1 double"


def column(x0, x1, n, y0=100.0, step=20.0):
    return [[x0, y0 + step * k, x1, y0 + step * k + 12] for k in range(n)]


def test_columns_are_read_between_spanning_boxes():
    head, middle = [[40.0, 10.0, 560.0, 50.0]], [[40.0, 190.0, 560.0, 250.0]]
    left, right = column(40.0, 280.0, 4) + column(40.0, 280.0, 3, 260.0), column(320.0, 560.0, 4) + column(320.0, 560.0, 3, 260.0)
    box = np.array(head + right + middle + left + [[100.0, 780.0, 140.0, 790.0]])
    order, n = layout.page_order(box, 600)
    rights, lefts = list(range(1, 8)), list(range(9, 16))
    assert n == 2 and order == [0, *lefts[:4], *rights[:4], 8, *lefts[4:], *rights[4:], 16]
    assert layout.gutter(box) is not None and layout.gutter(box[:3]) is None
    assert layout.page_order(box[:0], 600) == ([], 0)


def test_order_is_a_permutation():
    rng = np.random.default_rng(3)
    for n in range(60):
        x, y = rng.uniform(0, 500, n), rng.uniform(0, 800, n)
        box = np.stack([x, y, x + rng.uniform(0, 250, n), y + rng.uniform(0, 30, n)], axis=1)
        assert sorted(layout.page_order(box, 600)[0]) == list(range(n))


def test_columns_of_boxes(spark):
    box = np.array(column(40.0, 180.0, 8) + column(220.0, 360.0, 8) + column(400.0, 540.0, 8) + [[40.0, 0.0, 540.0, 20.0]])
    got, n = layout.columns_of(box, 600)
    assert n == 3 and got.tolist() == [0] * 8 + [1] * 8 + [2] * 8 + [1]
    assert layout.columns_of(box[:8], 600)[1] == 1 and layout.columns_of(box[:0], 600)[1] == 1
    rows = spark.createDataFrame([(d, k, *map(float, b)) for d in (1, None) for k, b in enumerate(box)] + [(2, 0, None, None, None, None)], BOX)
    assert sorted({(r.doc_id or 0, r.columns) for r in layout.columns(rows, 600).collect()}) == [(0, 3), (1, 3), (2, 1)]


def test_pages_over_many_batches(spark):
    rows = spark.range(0, 300).selectExpr("id div 100 as doc_id", "cast(id % 100 as int) as ord", "0D as x0", "cast(100 - id % 100 as double) as y0", "9D as x1", "cast(100.5 - id % 100 as double) as y1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = layout.reading_order(rows, 600).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300 and all(r.reading_ord == 99 - r.ord for r in got)


def kinds(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, size double, n int, y0 double, y1 double, repeated boolean, in_table boolean")
    c = S.kind(F.col("text"), F.col("size"), F.col("n"), F.col("y0"), F.col("y1"), F.lit(800.0), F.lit(10.0), F.col("repeated"), F.col("in_table"))
    return [r.k2 for r in df.select("k", c.alias("k2")).orderBy("k").collect()]


def test_kinds(spark):
    rows = [("12", 10.0, 1, 770.0, 790.0, False, False), ("12", 10.0, 1, 300.0, 310.0, False, False), ("Report", 10.0, 1, 10.0, 20.0, True, False), ("Report", 10.0, 1, 10.0, 20.0, False, None), ("Report", 10.0, 1, 500.0, 520.0, True, False), ("Report", 12.0, 1, 10.0, 20.0, True, True), ("Report", 12.0, 4, 100.0, 120.0, None, None), (None, None, None, None, None, None, None)]
    assert kinds(spark, rows) == ["page_num", "text", "header", "text", "footer", "title", "text", "text"]


def test_style_runs(spark):
    def line(doc, k, bold, width):
        return (doc, k, 0.0, 12.0 * k, width, bold, "f", 10.0)

    rows = [line(1, 0, True, 50.0), line(1, 1, False, 200.0), line(1, 2, False, 190.0), line(2, 0, True, 200.0), line(2, 1, False, 200.0)]
    rows += [line(3, k, k % 2 == 0, 20.0) for k in range(6)] + [line(None, 0, True, 10.0), line(None, 1, False, 100.0)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, x0 double, y0 double, x1 double, bold boolean, font string, size double")
    got = {(r.doc_id, r.ord): r.run for r in S.style_runs(df).collect()}
    assert len(got) == len(rows)
    assert [got[1, k] for k in range(3)] == [0, 1, 1] and [got[None, k] for k in range(2)] == [0, 1]
    assert {v for (d, _), v in got.items() if d in (2, 3)} == {0}
    assert S.style_runs(df.limit(0)).count() == 0


def test_recognised_paragraphs(spark):
    y = [0, 12, 24, 60, 72, 90]
    x1 = [200, 200, 90, 200, 200, 200]
    rows = [(1, k, 0.0, float(a), float(b), a + 10.0) for k, (a, b) in enumerate(zip(y, x1, strict=True))] + [(2, 0, 0.0, 0.0, 5.0, 5.0), (3, 0, None, None, None, None)]
    got = {(r.doc_id, r.ord): r.paragraph for r in S.recognised_paragraphs(spark.createDataFrame(rows, BOX)).collect()}
    assert [got[1, k] for k in range(6)] == [0, 0, 0, 1, 1, 2] and got[2, 0] == got[3, 0] == 0


def test_rules_and_table_regions(spark):
    rows = [(1, "l", 0.0, 10.0, 100.0, 11.0), (1, "l", 50.0, 100.0, 50.5, 10.0), (1, "re", 20.0, 20.0, 90.0, 25.0), (1, "l", 0.0, 0.0, 9.0, 9.0), (2, "l", 0.0, 0.0, 100.0, 0.0), (3, None, None, None, None, None)]
    found = S.rules(spark.createDataFrame(rows, "doc_id long, kind string, x0 double, y0 double, x1 double, y1 double"), 600)
    assert found.where("across").count() == 4 and found.where("not across").count() == 1
    assert [tuple(r) for r in S.table_regions(found).collect()] == [(1, 0.0, 10.0, 100.0, 100.0)]


def shrunk(box, others):
    r = list(box)
    for o in others:
        w, h = min(r[2], o[2]) - max(r[0], o[0]), min(r[3], o[3]) - max(r[1], o[1])
        if w > 0.3 and h > 0.3:
            axis = 1 if w >= h else 0
            if o[axis] > r[axis]:
                r[axis + 2] = min(r[axis + 2], o[axis])
            else:
                r[axis] = max(r[axis], o[axis + 2])
    return tuple(box) if r[2] - r[0] < 1 or r[3] - r[1] < 1 else tuple(r)


def test_erased_boxes_spare_kept_neighbours(spark):
    rng = random.Random(4)
    rows = []
    for d in range(4):
        for k in range(25):
            x, y = rng.uniform(0, 80), rng.uniform(0, 80)
            rows.append((d, k, x, y, x + rng.uniform(1, 30), y + rng.uniform(1, 30), rng.choice(["a", "b", " ", None]), rng.choice(["", None, "t"])))
    df = spark.createDataFrame(rows, BOX + ", text string, target string")
    got = {(r.doc_id, r.ord): tuple(r.erase) for r in S.erase_box(df).collect()}
    over = {(r.doc_id, r.ord): r.overlaps for r in S.overlaps_any(df).collect()}
    for d, k, *box, _, _ in rows:
        others = [r for r in rows if r[0] == d and r[1] != k and (r[6] or "").strip()]
        assert got[d, k] == shrunk(box, [r[2:6] for r in others if not r[7]])
        assert over[d, k] == any(min(box[2], r[4]) - max(box[0], r[2]) > 1 and min(box[3], r[5]) - max(box[1], r[3]) > 1 for r in others)


def test_verified(spark):
    paragraphs = spark.createDataFrame([(1, 0, "a-b c"), (1, 1, "xyz"), (1, 2, "q"), (1, 3, None), (2, 0, "Ａ1")], "doc_id long, ord int, target string")
    pages = spark.createDataFrame([(1, "… (abc) …"), (2, "a A 1")], "doc_id long, text string")
    assert sorted(tuple(r) for r in verification.verified(paragraphs, pages).collect()) == [(1, 3, 1), (2, 1, 0)]


def test_styles(spark):
    rows = [("ABCDEF+Times-BoldItalic", 0, 0xFFFFFF), ("Courier", 18, 0), (None, None, None)]
    df = spark.createDataFrame(rows, "name string, flags int, color int").select(style.font_style(F.col("name"), F.col("flags")).alias("s"), style.readable_on(F.col("color")).alias("ink"))
    assert [(*r.s, r.ink) for r in df.collect()] == [(True, True, False, True, 0), (False, True, True, True, 0xFFFFFF), (False, False, False, False, 0)]


@pytest.mark.parametrize(("lines", "want"), [([], 0.0), ([(0.0, 0.0), (1.0, 0.0)], 0.0), ([(-1.0, 0.0)], 180.0), ([(0.0, -1.0)], -90.0)])
def test_rotation(spark, lines, want):
    df = spark.createDataFrame([(lines,)], "d array<struct<dx: double, dy: double>>")
    assert df.select(style.rotation(F.col("d")).alias("r")).first().r == want


def test_leading(spark):
    df = spark.createDataFrame([(10.0, None), (10.0, 8.0), (10.0, 15.0), (10.0, 30.0)], "n double, p double")
    assert [r.s for r in df.select(style.leading(F.col("n"), F.col("p")).alias("s")).collect()] == [10.0, 10.0, 15.0, 18.0]


def test_lines_hold_the_text():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("ab 漢字。，（」\n") for _ in range(rng.randrange(60)))
        room = rng.uniform(2, 12)
        lines = setting.wrapped(text, room)
        assert "".join("".join(lines).split()) == "".join(text.split())
        assert all(a[0] not in setting.NOT_FIRST for a in lines[1:] if a)
        for line in lines:
            bare = line.rstrip("".join(setting.NOT_FIRST) + " ")
            assert sum(map(setting.usual_width, bare)) <= room
    assert setting.wrapped("漢字（漢", 3) == ["漢字", "（漢"] and setting.wrapped("abcdef", 1.5) == ["abc", "def"] and setting.wrapped(" ", 5) == [""]


def test_fitting():
    size, lines, fits = setting.fitted("漢" * 40, 100, 60, 30, 4)
    assert fits and len(lines) * size * 1.05 <= 60.5 and not setting.fitted("漢" * 40, 100, 60, size + 1, size + 1)[2]
    assert setting.fitted("漢", 100, 60, 20, 4) == (20, ["漢"], True)
    assert setting.fitted("漢" * 400, 20, 10, 20, 8)[0::2] == (8, False)
    assert setting.fitted("x", 0, 10, 20, 8) == (8, ["x"], False)


def test_tracking():
    assert setting.tracking(["漢字漢字漢字漢字", "漢字"], 10, 87, "left", 0.5) == [1.0, 0.0]
    assert setting.tracking(["漢", "字"], 10, 87, "left", 0.5) == [0.0, 0.0] and setting.tracking([], 10, 87, "left", 0.5) == []


def test_fitted_rows(spark):
    rows = spark.createDataFrame([(1, 0, None, None, None), (1, 1, "漢字", 100.0, 20.0)], "doc_id long, ord int, text string, width double, height double")
    assert [(r.ord, r.size, r.lines, r.fits) for r in setting.fit_rows(rows).orderBy("ord").collect()] == [(0, 4.0, [""], False), (1, 12.0, ["漢字"], True)]


def test_segments_as_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, "text", "a\nb", None, None, [1.004, 2.0])], "doc_id long, ord int, page int, kind string, text string, target string, reason string, bbox array<double>")
    exports.segments(rows).write.json(str(tmp_path / "s"))
    got = json.loads("".join(p.read_text() for p in (tmp_path / "s").glob("*.json")))
    assert got == {"doc_id": 1, "id": 0, "page": 1, "kind": "text", "source": "a b", "target": "", "skip_reason": "", "bbox": [1.0, 2.0], "translatable": True}


def test_hosted_provider_tries_again():
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = (503, b"") if len(asked) == 1 else (200, json.dumps({"choices": [{"message": {"content": "[]"}}]}).encode())
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    chat = providers.patient(providers.hosted(f"http://127.0.0.1:{server.server_port}/v1", "m", "k"), pause=0.0)
    assert chat("[1]", "") == "[]"
    server.shutdown()
    assert [a[:2] for a in asked] == [("/v1/chat/completions", "Bearer k")] * 2 and asked[1][2]["messages"][1]["content"] == "[1]"
    assert {"mock", "ollama", "custom"} <= set(providers.PROVIDERS)
