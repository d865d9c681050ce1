"""Queries of parsed pages, regions, recognised text, fonts, requests and stores; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import prompts as P
from folioforge.functions import style as S
from folioforge.functions import text as T
from folioforge.operators import fonts, pageplan, placement, recognition, regions
from folioforge.plans.catalog import BOXES, CLEAN, JUDGED, LINES, _boxes, doc_lines, query, table
from folioforge.plans.pages import BOXES_A_PAGE
from folioforge.sources import spans as source
from folioforge.sources import store

# Pages of a document hold BOXES_A_PAGE lines; they are numbered doc_id * 1000 + page.
PAGED = f"{BOXES}, paged as (select doc_id * 1000 + ord // {BOXES_A_PAGE} as page, ord % {BOXES_A_PAGE} as place, * from boxes)"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir, "line", "lang").withColumn("doc_id", F.col("doc_id") * 1000 + F.floor(F.col("ord") / BOXES_A_PAGE))
    return rows.withColumn("ord", (F.col("ord") % BOXES_A_PAGE).cast("int"))


@query(f"""with {LINES}, d as (select doc_id, ord // 5 as para, ord, [1.0, 0.0, -1.0, 0.5, 0.0][1 + length(line) % 5] as dx, [0.0, 1.0, 0.0, -0.75, 0.0][1 + length(line) % 5] as dy from lines),
f as (select doc_id, para, arg_min((dx, dy), ord) filter (dx != 0 or dy != 0) as v from d group by all)
select doc_id, para, coalesce(case when abs(v[2]) > abs(v[1]) then round(degrees(atan2(v[2], v[1])), 2) when v[1] < 0 then 180 else 0 end, 0)::double as rotation from f""")
def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.length("line") % 5 + 1).cast("int"))
    rows = doc_lines(spark, sf_dir).select("doc_id", F.floor(F.col("ord") / 5).alias("para"), "ord", F.struct(pick([1.0, 0.0, -1.0, 0.5, 0.0]).alias("dx"), pick([0.0, 1.0, 0.0, -0.75, 0.0]).alias("dy")).alias("d"))
    dirs = rows.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("ord", "d"))).alias("x"))
    return dirs.select("doc_id", "para", S.rotation(F.transform("x", lambda v: v["d"])).alias("rotation"))


@query(r"""with a as (select doc_id, regexp_replace(text, '([A-Za-z])[-‐‑]\s*\n\s*([a-z])', '\1\2', 'g') as t from documents),
b as (select doc_id, regexp_replace(regexp_replace(t, '([\x{3000}-\x{303f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}])\n', '\1', 'g'), '[ \t]*\n[ \t]*', ' ', 'g') as t from a)
select doc_id, sha256(regexp_replace(regexp_replace(t, '[ \t\x{3000}]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) as joined from b""")
def running_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.join_lines(F.split("text", "\n")), 256).alias("joined"))


@query(f"with {LINES}, s as (select doc_id, ord, {CLEAN} as s from lines where ord < 3) select doc_id, left(coalesce(string_agg(s, chr(10) order by ord) filter (s != ''), ''), 600) as hint from s group by doc_id")
def context_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.context_hint(doc_lines(spark, sf_dir).select("doc_id", "ord", F.col("line").alias("text")), "doc_id")


TERMS = f"""{LINES}, w as (select source, doc_id, ord, string_split(line, ' ')[1] as src, string_split(line, ' ')[2] as dst from lines),
t as (select source, src, arg_max(dst, (doc_id, ord)) as dst, min((doc_id, ord)) as place from w where regexp_full_match(src, '[A-Za-z]+') and regexp_full_match(dst, '[A-Za-z]+') group by all)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("line", " ")
    two = doc_lines(spark, sf_dir).select("source", "doc_id", "ord", words[0].alias("src"), F.get(words, 1).alias("dst")).where("src rlike '^[A-Za-z]+$' and dst rlike '^[A-Za-z]+$'")
    return P.glossary(two.select(F.col("source").alias("glossary_id"), F.struct("doc_id", "ord").alias("ord"), F.concat("src", F.lit(" = "), "dst").alias("line")))


@query(f"with {TERMS} select source as glossary_id, src, dst from t")
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("glossary_id", "src", "dst")


@query(f"""with {TERMS}, r as (select *, row_number() over (partition by source order by place, src) as k from t)
select source as glossary_id, 'You translate a document into French.' || chr(10) || chr(10) || 'Rules:' || chr(10) || 'Keep names.' || chr(10) || chr(10) || 'Glossary (always use these):' || chr(10) || string_agg('- ' || src || ' → ' || dst, chr(10) order by k) || chr(10) || chr(10) || 'Reply in JSON.' as prompt from r where k <= 200 group by source""")
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = P.glossary_block(_terms(spark, sf_dir))
    return blocks.select("glossary_id", P.system_prompt(F.lit("French"), F.lit(" Keep names. "), F.lit("Reply in JSON."), F.lit("auto"), F.col("block")).alias("prompt"))


# Regions of a page: a grid of cells that moves with the page's number, bands of rows, and a table.
REGIONS = [("cell", 0, 30.0, 20.0, 170.0, 120.0), ("cell", 1, 100.0, 60.0, 320.0, 300.0), ("row", 0, 0.0, 90.0, 600.0, 240.0), ("row", 1, 0.0, 200.0, 600.0, 260.0), ("table", 0, 40.0, 20.0, 330.0, 500.0)]
REGIONS_SQL = "g(kind, gord, gx0, gy0, gx1, gy1) as (values " + ", ".join(f"('{k}', {o}, {a}, {b}, {c}, {d})" for k, o, a, b, c, d in REGIONS) + "), regions as (select page, kind, gord, gx0 + page % 7 * 10 as rx0, gy0 as ry0, gx1 + page % 7 * 10 as rx1, gy1 as ry1 from (select distinct page from paged), g)"


def _regions(pages: DataFrame) -> DataFrame:
    moved = lambda x: x + F.col("doc_id") % 7 * 10
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(o).alias("ord"), moved(F.lit(a)).alias("x0"), F.lit(b).alias("y0"), moved(F.lit(c)).alias("x1"), F.lit(d).alias("y1")) for k, o, a, b, c, d in REGIONS)))
    return pages.select("doc_id").distinct().select("doc_id", each.alias("r")).select("doc_id", "r.*")


@query(f"""with {PAGED}, {REGIONS_SQL}, h as (select page, place, arg_min((kind, rx0, ry1), (kind != 'cell', case when kind = 'row' then ry1 - ry0 else 0 end, gord)) as r
from paged join regions using (page) where kind != 'table' and (x0 + x1) / 2 between rx0 and rx1 and (y0 + y1) / 2 between ry0 and ry1 group by all)
select page as doc_id, place::int as ord, r[1] as kind, r[2]::double as x0, r[3]::double as y1 from paged left join h using (page, place)""")
def constraint_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(spark, sf_dir)
    return regions.constrained(rows, _regions(rows)).select("doc_id", "ord", "limit.kind", F.col("limit.x0").alias("x0"), F.col("limit.y1").alias("y1"))


@query(f"""with {PAGED}, {REGIONS_SQL} select distinct page as doc_id, place::int as ord from paged join regions using (page)
where kind = 'table' and (x1 - x0) * (y1 - y0) > 0 and greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) >= 0.5 * ((x1 - x0) * (y1 - y0))""")
def boxes_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(spark, sf_dir)
    return regions.shared_area(rows, _regions(rows).where("kind = 'table'"))


@query(f"""with {PAGED} select a.page as doc_id, a.place::int as ord, greatest(0.0, least(825.0, coalesce(min(b.y0) filter (b.y0 + b.y1 > a.y0 + a.y1), 825.0)) - a.y1)::double as below,
greatest(0.0, a.y0 - greatest(17.0, coalesce(max(b.y1) filter (b.y0 + b.y1 < a.y0 + a.y1), 17.0)))::double as above
from paged a join paged b on a.page = b.page and a.x0 = b.x0 group by a.page, a.place, a.y0, a.y1""")
def room_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.room(paged(spark, sf_dir).withColumn("column", F.col("x0")), F.lit(17.0), F.lit(825.0)).select("doc_id", "ord", "below", "above")


@query(f"""with {PAGED}, c as (select page, place, x0 + place % 3 * 0.3 as x0, y0 // 28 * 28 as y0, x0 + 80.4 as x1, y0 // 28 * 28 + place % 5 as y1 from paged)
select page as doc_id, min(place)::int as ord from c where x1 - x0 >= 2 and y1 - y0 >= 2 group by page, round_even(x0, 0), round_even(y0, 0), round_even(x1, 0), round_even(y1, 0)""")
def distinct_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.floor(F.col("y0") / 28) * 28.0
    found = paged(spark, sf_dir).select("doc_id", "ord", (F.col("x0") + F.col("ord") % 3 * F.lit(0.3)).alias("x0"), top.alias("y0"), (F.col("x0") + 80.4).alias("x1"), (top + F.col("ord") % 5).alias("y1"))
    return regions.table_cells(found).select("doc_id", "ord")


@query(f"""with {PAGED}, h as (select page, list_sort(list(y1 - y0)) as h from paged group by page), s as (select page, greatest(6.0, case when h[len(h) // 2 + 1] = 0 then 10 else h[len(h) // 2 + 1] end * 0.7::double) as step from h)
select page as doc_id, place::int as ord, (row_number() over (partition by page order by round_even((y0 + y1) / 2 / step, 0), x0, place) - 1)::int as "at" from paged join s using (page)""")
def recognised_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.sorted_boxes(paged(spark, sf_dir)).select("doc_id", "ord", F.col("place").alias("at"))


@query(None)
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.merged_boxes(paged(spark, sf_dir).withColumn("score", F.length("line") % 8 / 8.0))


@query("""with s as (select item_id, generate_subscripts(string_split(text, ''), 1) as step, unnest(string_split(text, '')) as c from benchmark),
n as (select item_id, step, case when c between 'a' and 'z' then ascii(c) - 96 else 0 end as sign, step % 8 / 8.0::double as score from s),
l as (select *, sign != 0 and sign != lag(sign, 1, 0) over (partition by item_id order by step) and sign < 26 as new from n)
select item_id as line_id, coalesce(string_agg(chr((96 + sign)::int), '' order by step) filter (new), '') as text, coalesce(avg(score) filter (new), 0)::double as confidence from l group by item_id""")
def decoded_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_id"), F.posexplode(F.split("text", "")).alias("step", "c"))
    steps = chars.select("line_id", (F.col("step") + 1).alias("step"), F.when(F.col("c").between("a", "z"), F.ascii("c") - 96).otherwise(0).alias("sign"), ((F.col("step") + 1) % 8 / 8.0).alias("score"))
    signs = spark.range(1, 26).select(F.col("id").cast("int").alias("sign"), F.char(F.col("id") + 96).alias("char"))
    return recognition.decoded(steps, signs)


@query(f"with {PAGED} select page as doc_id, place // 4 as paragraph, avg(length(line) % 8 / 8.0::double) as confidence from paged group by all")
def recognised_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(spark, sf_dir)
    return recognition.confidence(rows.select("doc_id", F.floor(F.col("ord") / 4).alias("paragraph"), (F.length("line") % 8 / 8.0).alias("confidence")))


@query(f"""with {PAGED}, b as (select doc_id, page, place, x0, y0, length(line) % 3 = 0 as ocr from paged)
select doc_id as file_id, page, place::int as old, (row_number() over (partition by doc_id order by page, round_even(y0, 1), x0, ocr, place) - 1)::int as id from b""")
def appended_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(spark, sf_dir).select(F.floor(F.col("doc_id") / 1000).alias("file_id"), F.col("doc_id").alias("page"), F.col("ord").alias("id"), F.col("ord").alias("old"), "x0", "y0", (F.length("line") % 3 == 0).alias("ocr"))
    return recognition.appended(rows.where("not ocr").drop("ocr"), rows.where("ocr").drop("ocr")).select("file_id", "page", "old", "id")


# Faces and styles: the types of the part table stand in for installed fonts.
FACE = "length(p_type)"


@query(f"""with f as (select distinct p_type as name, {FACE} as n from part), s as (select unnest(range(0, 8)) as style_id),
j as (select style_id, name, style_id % 2 = 1 as bold, style_id // 2 % 2 = 1 as light, style_id // 4 = 1 as serif, n % 2 = 0 as fbold, n from f, s),
r as (select *, row_number() over (partition by style_id order by n % 10 >= 7, n % 7 = 0, n % 3 = 0, n % 5 = 0, (bold != fbold)::int, (light != (n % 4 = 1))::int, (serif != (n % 6 < 3))::int, n % 11 = 0, n % 13 = 0, name) as k from j)
select style_id, name, bold and not fbold as faux_bold from r where k = 1""")
def ranked_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("p_type")
    traits = {"coverage": F.when(n % 10 >= 7, 0.5).otherwise(1.0), "variable": n % 7 == 0, "subset_safe": n % 3 != 0, "cjk_ok": n % 5 != 0, "bold": n % 2 == 0, "light": n % 4 == 1, "serif": n % 6 < 3, "space_ok": n % 11 != 0, "builtin": n % 13 == 0, "ascii_ok": F.lit(True)}
    faces = table(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("name"), *(c.alias(k) for k, c in traits.items()))
    styles = spark.range(8).select(F.col("id").alias("style_id"), (F.col("id") % 2 == 1).alias("bold"), (F.floor(F.col("id") / 2) % 2 == 1).alias("light"), (F.col("id") >= 4).alias("serif"))
    return fonts.ranked(styles, faces)


@query("select source as font, count(*) as n from documents group by source order by n desc, font limit 6")
def fonts_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fonts.used(table(spark, sf_dir, "documents").select(F.concat(F.lit("/fonts/sub\\"), "source", F.lit(".ttf")).alias("font")))


@query("select doc_id, len(list_filter(string_split('etaoinshrdlu国é', ''), lambda c: contains(text, c))) / 14.0::double as share from documents")
def glyph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", recognition.simplified_share(F.col("text"), "etaoinshrdlu国é").alias("share"))


@query(f"with {LINES} select doc_id, ord::int as ord, replace(replace(replace(line, 'a', '•'), 'e', '<='), 'o', '') as drawn from lines")
def drawable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.translate("line", "aeo", "≤")
    glyphs = F.lit("".join(map(chr, range(32, 127))) + "•")
    return doc_lines(spark, sf_dir).select("doc_id", F.col("ord").cast("int").alias("ord"), fonts.drawable(marked, glyphs, True).alias("drawn"))


@query(f"""with {LINES}, t as (select doc_id, ord, string_split(replace(replace(line, ' t', '漢'), '.', '。'), '') as c from lines),
w as (select doc_id, ord, c, [regexp_matches(x, '[漢。]') for x in c] as wide from t)
select doc_id, ord::int as ord, len([i for i in range(1, len(c)) if wide[i] != wide[i + 1] and c[i] != '。' and not regexp_matches(c[i], '\\s') and not regexp_matches(c[i + 1], '\\s')])::int as gaps from w""")
def script_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.replace(F.replace("line", F.lit(" t"), F.lit("漢")), F.lit("."), F.lit("。"))
    return doc_lines(spark, sf_dir).select("doc_id", F.col("ord").cast("int").alias("ord"), fonts.script_gaps(mixed).alias("gaps"))


@query(f"""{JUDGED}, p as (select lang, reason = 'translatable' as t, ord % 7 != 0 as done, length(line) as n, ord % 5 = 0 as cached, ord % 11 as m from judged)
select lang, count(*) filter (t) as paragraphs, count(*) filter (t and done) as translated, count(*) filter (t and not done) as failed, count(*) filter (not t) as skipped, coalesce(sum(n) filter (t), 0)::bigint as tokens,
count(*) filter (t and cached) as cache_hits, count(*) filter (t and m > 8) as numeric_mismatched from p group by lang""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).select("lang", (T.skip_reason(F.col("line")) == "translatable").alias("translatable"), F.when(F.col("ord") % 7 != 0, "x").alias("target"), F.length("line").alias("tokens"), (F.col("ord") % 5 == 0).alias("cached"), F.lit(0).alias("retries"), F.greatest(F.lit(0), F.col("ord") % 11 - 8).alias("numbers_missing"))
    return store.run_statistics(rows, "lang").drop("retries")


@query(f"with {PAGED} select page as doc_id from paged group by page having bool_or(length(line) % 50 = 7)")
def pages_to_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.pages_to_set(paged(spark, sf_dir).withColumn("target", F.when(F.length("line") % 50 == 7, F.col("line"))))


@query(r"""with a as (select page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[<>:"|?*\x00-\x1f]', '_', 'g') as s, length(html) * 97 as n from pages),
b as (select page_id, n, regexp_replace(s, '^[ .]+|[ .]+$', '', 'g') as s from a)
select page_id, case when s = '' then 'file' else s end as name, case when n < 1024 then printf('%d B', n) when n < 1048576 then printf('%.1f KB', n / 1024.0::double) else printf('%.1f MB', n / 1048576.0::double) end as size from b""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.safe_name(F.col("url")).alias("name"), P.human_size(F.length("html") * 97).alias("size"))


TASKS = "tasks as (select event_id as task_id, case when event_id % 500 = 3 then 'running' when event_id % 3 = 1 then 'done' else 'error' end as status, (ts, event_id) as created_at from events)"


@query(f"""with {TASKS}, running as (select count(*) as n from tasks where status = 'running'), done as (select *, row_number() over (order by created_at desc) as k from tasks where status != 'running')
select task_id, status from tasks where status = 'running' union all select task_id, status from done, running where k <= greatest(0, 50 - n)""")
def kept_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 500 == 3, "running").when(F.col("event_id") % 3 == 1, "done").otherwise("error")
    tasks = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), status.alias("status"), F.struct("ts", "event_id").alias("created_at"))
    return store.kept_tasks(tasks).select("task_id", "status")


@query("select user_id as file_id, name from (select user_id, event_type || '.PDF' as name, row_number() over (partition by user_id order by ts, event_type || '.PDF') as k, ts from events where event_type != 'click') where k = 1 order by ts desc, file_id limit 30")
def registered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("event_type", F.when(F.col("event_type") == "click", ".doc").otherwise(".PDF"))
    return store.registered(table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), name.alias("name"), F.col("ts").alias("uploaded_at"))).select("file_id", "name")


@query("select user_id as task_id, count(*) as n, max(event_id) as last from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k <= 200 group by user_id")
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("at"), F.col("event_type").alias("message"))
    return store.recent_logs(logs).groupBy("task_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))


@query("select source as task_id, 'x' || doc_id || '.md' as name, lang as kind, lang as label, n_chars as size, '/api/download/' || source || '/x' || doc_id || '.md' as url from documents")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("task_id"), F.concat(F.lit("out/"), "lang", F.lit("/x"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("lang").alias("kind"), F.lit("").alias("label"), F.col("n_chars").alias("size"))
    return store.manifest(files)


@query("""with t as (select event_id, event_id % 41 as done, 40.0::double as elapsed from events), p as (select *, round(20 + 60 * least(1.0, done / 37.0::double), 1) as percent from t)
select event_id, percent, case when percent >= 100 then 0 when percent > 0 then elapsed * (100 - percent) / percent end::double as eta from p""")
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = P.progress(F.lit(20.0), F.lit(80.0), F.col("event_id") % 41, F.lit(37.0), F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", percent.alias("percent"), P.seconds_left(F.lit(40.0), percent).alias("eta"))


# Spans: two for each line, in blocks of five lines in two columns; the first line of some blocks is a heading.
SPANS_A_PAGE = 40


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = doc_lines(spark, sf_dir).select("doc_id", (F.col("ord") % SPANS_A_PAGE).alias("at"), F.floor(F.col("ord") / SPANS_A_PAGE).cast("int").alias("page"), "line")
    block, row = F.floor(F.col("at") / 5), F.col("at") % 5
    head = (row == 0) & (block % 3 == 0)
    size = F.when(head, 14.0).otherwise(10.0)
    x0, y0 = 40.0 + block % 2 * 280, 30.0 + F.floor(block / 2) * 120 + row * 14
    half = F.floor(F.length("line") / 2).cast("int")
    made = lines.select("doc_id", "page", block.cast("int").alias("block"), row.cast("int").alias("line_no"), head.alias("head"), size.alias("size"), x0.alias("x0"), y0.alias("y0"), F.left("line", half).alias("a"), F.expr("substr(line, int(floor(length(line) / 2)) + 1)").alias("b"))
    wide = lambda c: F.least(F.lit(120.0), F.length(c) * F.col("size") * F.lit(0.4))  # noqa: E731  long lines are set narrower
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("span"), F.col(c).alias("text"), (F.col("x0") + (wide("a") if k else F.lit(0.0))).alias("sx0"), (F.col("x0") + wide("a") + (wide("b") if k else F.lit(0.0))).alias("sx1")) for k, c in enumerate("ab"))))
    spans = made.select("*", both.alias("s")).select(
        F.col("doc_id").cast("string").alias("file_id"), "page", "block", F.col("line_no").alias("line"), "s.span", "s.text", F.col("s.sx0").alias("x0"), "y0", F.col("s.sx1").alias("x1"), (F.col("y0") + F.col("size")).alias("y1"),
        F.when(F.col("head"), "Serif-Bold").when(F.col("s.span") == 0, "Sans").otherwise("Sans-Italic").alias("font"), "size", F.when(F.col("head"), 16).otherwise(0).alias("flags"), F.lit(0).alias("color"), (F.col("y0") + F.col("size") * F.lit(0.75)).alias("origin_y"),
    )
    pages = spans.select("file_id", "page").distinct().select("*", F.lit(600.0).alias("width"), F.lit(640.0).alias("height"))
    return source.conform(spans, source.SPANS), source.conform(pages, source.PAGES)


SPAN_LINES = f"""{LINES}, l as (select doc_id, ord // {SPANS_A_PAGE} as page, ord % {SPANS_A_PAGE} as pos, line as t from lines),
b as (select doc_id::varchar as file_id, page::int as page, (pos // 5)::int as block, (pos % 5)::int as line, t, case when pos % 5 = 0 and pos // 5 % 3 = 0 then 14.0 else 10.0 end::double as size, 30.0 + pos // 5 // 2 * 120 + pos % 5 * 14 as y0 from l)"""


@query(rf"""with {SPAN_LINES} select file_id, page, block, line, t as text, greatest(0, y0)::double as y0, least(640, y0 + size)::double as y1, size,
case when size = 14 then 'Serif-Bold' when greatest(1, length(regexp_replace(regexp_replace(left(t, length(t) // 2), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g'))) * (length(t) > 1)::int >= greatest(1, length(regexp_replace(regexp_replace(substr(t, length(t) // 2 + 1), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g'))) then 'Sans' else 'Sans-Italic' end as font, size = 14 as bold
from b where regexp_replace(t, '^\s+|\s+$', '', 'g') != ''""")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, pages = _spans(spark, sf_dir)
    return source.lines(spans, pages).select("file_id", "page", "block", "line", "text", "y0", "y1", "size", "font", "bold")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, pages = _spans(spark, sf_dir)
    found = pages.select("file_id", "page", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(o).alias("ord"), F.lit(a).alias("x0"), F.lit(b).alias("y0"), F.lit(c).alias("x1"), F.lit(d).alias("y1")) for k, o, a, b, c, d in REGIONS))).alias("r")).select("file_id", "page", "r.*")
    rows = pageplan.paragraphs(spans, pages, found)
    return pageplan.kinds(rows, pageplan.repeated_keys(rows))


@query(None)
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("file_id", "page", "id", "kind", "column", "columns", "align", "bold", "size", "font", "rotation", "in_table", F.size("lines").alias("n_lines"), F.col("limit.kind").alias("limit_kind"))


@query(None)
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pageplan.merged(_parsed(spark, sf_dir)).select("file_id", "page", "id", "kind", "bold", "size", F.size("lines").alias("n_lines"))


def _placed(spark: SparkSession, sf_dir: str, dual: bool) -> DataFrame:
    rows = paged(spark, sf_dir).withColumns({"column": (F.col("x0") > 100).cast("int"), "size": F.lit(9.0), "rotation": F.when(F.length("line") % 29 == 3, 90.0).when(F.length("line") % 31 == 4, 180.0).otherwise(0.0), "height": F.lit(842.0), "pitch": F.lit(None).cast("double"), "text": F.col("line")})
    limited = regions.constrained(rows, _regions(rows).where("kind != 'table'"))
    return placement.plan(limited.withColumn("target", F.when(F.col("ord") % 4 != 1, F.col("text"))), dual)


@query(None)
def placed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.summary(_placed(spark, sf_dir, False))


@query(None)
def placed_pages_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.summary(_placed(spark, sf_dir, True))
