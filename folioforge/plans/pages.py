"""Queries of pages, replies and exports; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import exports, layout, replies
from folioforge.plans.catalog import BOXES, CELLS, GRID, JUDGED, LINES, _boxes, doc_lines, query, table
from folioforge.sources import store

PAGE_WIDTH, LINES_A_PAGE = 600.0, 50
FENCE = "```"
BOXES_A_PAGE = 2 * LINES_A_PAGE


def paged(rows: DataFrame, by_column: bool = False) -> DataFrame:
    """Boxes with a number of their page (or column of a page) as doc_id."""
    page = F.col("doc_id") * 100000 + F.floor(F.col("ord") / BOXES_A_PAGE) * 2
    return rows.withColumn("doc_id", (page + F.col("ord") % 2 if by_column else page).cast("long"))


@query(f"with {BOXES}, g as (select doc_id, y0 - lag(y0) over (partition by doc_id order by y0) as gap from boxes) select doc_id, coalesce(median(gap) filter (gap > 0.5), 0)::double as spacing from g group by doc_id")
def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_spacing(_boxes(spark, sf_dir))


@query(f"with {BOXES}, {GRID} select doc_id, ord from boxes where (x1 - x0) * (y1 - y0) > 0 and exists (select 1 from cells where greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) >= 0.5 * ((x1 - x0) * (y1 - y0)))")
def in_any_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).where(layout.in_any_region([c[1:] for c in CELLS])).select("doc_id", "ord")


@query(f"""with {BOXES}, f as (select *, max(x1) over w as r, greatest(1.0, max(x1) over w - min(x0) over w) as w, ord = max(ord) over w as is_last from boxes window w as (partition by doc_id)),
s as (select doc_id, count(*) as n, count(*) filter (not is_last and x1 >= r - greatest(2.0, 0.06::double * w)) as full_, max(w) as w, max(x0) - min(x0) as l, max(x1) - min(x1) as r, max((x0 + x1) / 2) - min((x0 + x1) / 2) as c from f group by doc_id),
t as (select *, greatest(1.5, 0.03::double * w) as tol from s)
select doc_id, case when n < 2 then 'left' when l > tol and c <= tol then 'center' when l > tol and r <= tol then 'right' when n > 2 and l <= tol and full_ >= (n - 1) * 0.8 then 'justify' else 'left' end as align from t""")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.alignment(_boxes(spark, sf_dir))


@query(None)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(paged(_boxes(spark, sf_dir)), PAGE_WIDTH)


@query(None)
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.columns(paged(_boxes(spark, sf_dir)), PAGE_WIDTH)


@query(None)
def merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(_boxes(spark, sf_dir)).withColumns({"column": (F.col("x0") > 100).cast("int"), "kind": F.lit("text"), "size": F.lit(10.0), "color": F.lit(0), "bold": F.lit(False), "first_x0": F.col("x0"), "last_x1": F.col("x1")})
    return layout.merged_paragraphs(rows)


@query(None)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_rows(paged(_boxes(spark, sf_dir)).withColumnRenamed("y1", "y"))


@query(f"""{JUDGED}, r as (select doc_id, ord, ord - row_number() over (partition by doc_id order by ord) as island from judged where reason = 'translatable'),
i as (select doc_id, min(ord) + 1 as a, max(ord) + 1 as b from r group by doc_id, island)
select doc_id, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as spec from i group by doc_id""")
def format_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = doc_lines(spark, sf_dir).where(T.skip_reason(F.col("line")) == "translatable")
    return kept.groupBy("doc_id").agg(T.format_pages(F.array_sort(F.collect_list("ord"))).alias("spec"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = doc_lines(spark, sf_dir).withColumn("reason", T.skip_reason(F.col("line")))  # a column, as each use of the expression would compute it again
    reason = F.col("reason")
    kind = F.when(reason.isin("page_num", "code"), reason).otherwise("text")
    page = F.floor(F.col("ord") / LINES_A_PAGE).cast("int")
    return judged.select("doc_id", "ord", page.alias("page"), kind.alias("kind"), F.col("line").alias("text"), F.when(reason == "translatable", F.col("line")).alias("target"), "reason")


def _exported(shown: str, heading: str, block: str) -> str:
    return f"""{JUDGED}, k as (select *, case when reason = 'translatable' then s else '' end as target, ord // {LINES_A_PAGE} as page from judged),
shown as (select *, lag(page) over (partition by doc_id order by ord) as before from k where {shown}),
joined as (select doc_id, string_agg(case when before is distinct from page then replace('{heading}', '{{}}', (page + 1)::varchar) || chr(10) || chr(10) else '' end || {block}, chr(10) || chr(10) order by ord) as body from shown group by doc_id)
select doc_id, sha256(coalesce(body, '') || chr(10)) as body_sha256 from (select distinct doc_id from lines) left join joined using (doc_id)"""


@query(_exported("reason not in ('page_num', 'empty')", exports.PAGE, f"case when reason = 'code' then '{FENCE}' || chr(10) || s || chr(10) || '{FENCE}' else '{exports.SOURCE}' || s || chr(10) || chr(10) || '{exports.TARGET}' || case when target = '' then '（' || reason || '）' else target end end"))
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.markdown(_paragraphs(spark, sf_dir)).select("doc_id", F.sha2("markdown", 256).alias("body_sha256"))


@query(f"{JUDGED} select doc_id, sha256(string_agg(concat_ws(chr(31), ord, ord // {LINES_A_PAGE} + 1, case when reason in ('page_num', 'code') then reason else 'text' end, s, case when reason = 'translatable' then s else '' end), chr(10) order by ord)) as segments_sha256 from judged group by doc_id")
def export_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = exports.segments(_paragraphs(spark, sf_dir)).withColumn("row", F.concat_ws("\x1f", "id", "page", "kind", "source", "target"))
    ordered = F.array_sort(F.collect_list(F.struct("id", "row")))
    return segments.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n"), 256).alias("segments_sha256"))


@query(_exported("reason = 'translatable'", "===== 第 {} 页 =====", "target"))
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.plain_text(_paragraphs(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("body_sha256"))


@query(rf"with {LINES}, t as (select doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') as t from lines) select doc_id, count(*) as items, sum(length(t)) as chars from t where t != '' group by doc_id")
def reply_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit(f"Here you are:\n{FENCE}json\n"), replies.request(F.split(F.replace(F.col("text"), F.lit("`"), F.lit("'")), "\n")), F.lit(f"\n{FENCE}"))
    got = replies.read_replies(table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply")), "doc_id", "reply")
    return got.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum(F.length("t")).alias("chars"))


@query(None)
def long_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = replies.chunks(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "chunk", F.length("piece").alias("n_chars"), F.sha2("piece", 256).alias("piece_sha256"))


@query("select p_brand as key, coalesce(max(p_name) filter (p_size >= 25), max(p_name)) as value from part group by p_brand")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"), "p_size")
    cached = rows.where("p_size < 25").groupBy("key").agg(F.max("value").alias("value"))
    return store.upsert(cached, rows.where("p_size >= 25").select("key", "value"))


NUMERALS = {"第二十五条": "25", "二〇二〇年": "2020", "两百零三个": "203", "一般": "", "十分": "", "三万五千 / 十": "35000,10", "一亿二千万": "120000000", "x一y": "1", "〇一": "1"}


@query(f"""with {LINES}, n as (select doc_id, ord, line, {[k for k in NUMERALS]}[1 + (doc_id + ord) % {len(NUMERALS)}] as numeral, {[v for v in NUMERALS.values()]}[1 + (doc_id + ord) % {len(NUMERALS)}] as found from lines)
select doc_id, ord::int as ord, length(regexp_replace(line, '{T.HAN_NUMERAL}', '', 'g')) + length(numeral) + 2 as chars, found from n""")
def han_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals put into the lines of the corpus, in place of those that lines have themselves."""
    pick = F.element_at(F.array(*map(F.lit, NUMERALS)), ((F.col("doc_id") + F.col("ord")) % len(NUMERALS) + 1).cast("int"))
    rows = doc_lines(spark, sf_dir).select("doc_id", F.col("ord").cast("int").alias("ord"), F.concat(F.regexp_replace("line", T.NUMERAL_SEARCH, ""), F.lit(" "), pick, F.lit(" ")).alias("text"))
    found = rows.withColumn("found", F.array_join(T.han_numerals(F.col("text")), ","))
    return found.select("doc_id", "ord", F.length("text").alias("chars"), "found")
