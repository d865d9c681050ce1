"""Queries of kinds, styles, recognised lines, tables, neighbours and setting; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import style
from folioforge.functions import text as T
from folioforge.operators import corpus as C
from folioforge.operators import setting, verification
from folioforge.operators import structure as S
from folioforge.plans.catalog import BOXES, CLEAN, KEY, ORACLE_SQL, PAGE, _boxes, doc_lines, query, table
from folioforge.plans.pages import BOXES_A_PAGE, PAGE_WIDTH, paged

PAGE_HEIGHT, BODY = 740.0, 10.0


def _pages(by_column: bool = False) -> str:
    """SQL of boxes by page (or column of a page), as `paged` gives them."""
    column = " + ord % 2" if by_column else ""
    return f"{BOXES}, p as (select * replace (doc_id * 100000 + ord // {BOXES_A_PAGE} * 2{column} as doc_id), doc_id as document from boxes)"


def _repeated() -> str:
    return ORACLE_SQL["repeated_lines"].split("select source, key, pages from")[1]


@query(f"""with {BOXES}, keyed as (select b.*, n, {KEY.replace("line", "b.line")} as key, {CLEAN.replace("line", "b.line")} as s, length(b.line) % 12 + 6 as size, length(b.line) % 10 = 0 as in_table from boxes b join lines using (doc_id, ord)),
total as (select source, count(distinct doc_id) as total from lines group by 1), c as (select source, key, count(distinct doc_id) as pages, bool_or(ord = 0 or ord = n - 1) as zone from keyed where length(key) between 2 and 300 group by all),
r as (select source, key, true as repeated from {_repeated()}),
z as (select *, case when y1 <= {PAGE_HEIGHT} * 0.08 then 'header' when y0 >= {PAGE_HEIGHT} * 0.90 then 'footer' end as zone from keyed left join r using (source, key))
select doc_id, case when not in_table and zone is not null and s != '' and length(s) <= 24 and ({PAGE}) then 'page_num' when not in_table and repeated then coalesce(zone, case when y1 <= {PAGE_HEIGHT} * 0.5 then 'header' else 'footer' end) when size >= {BODY} * 1.18 and length(s) <= 120 then 'title' else 'text' end as kind, count(*) as n from z group by all""")
def paragraph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir, "source", "line").withColumn("key", T.match_key(F.col("line")))
    repeated = C.repeated_keys(doc_lines(spark, sf_dir), 0.04, 0.06)
    length = F.length("line")
    kind = S.kind(F.col("line"), length % 12 + 6, F.lit(1), F.col("y0"), F.col("y1"), F.lit(PAGE_HEIGHT), F.lit(BODY), F.col("repeated"), length % 10 == 0)
    return C.with_repeated(rows, repeated).groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""with {BOXES}, b as (select * replace (doc_id * 100000 + ord // 6 as doc_id), length(line) % 3 = 0 as bold, 'f' as font, (length(line) // 3 % 2 * 4 + 10)::double as size from boxes),
m as (select *, ((bold, font, size) is distinct from lag((bold, font, size)) over w and row_number() over w > 1)::int as fresh from b window w as (partition by doc_id order by y0, ord)),
r as (select *, sum(fresh) over (partition by doc_id order by y0, ord rows unbounded preceding) as run from m),
g as (select doc_id, run, count(*) as n, max(x1 - x0) as wide, any_value(bold) as bold, any_value(size) as size from r group by all),
h as (select *, n <= 3 and wide <= max(wide) over (partition by doc_id) * 0.72::double as heading from g),
j as (select *, run = 0 or ((bold is distinct from lag(bold) over w or size is distinct from lag(size) over w) and (heading or lag(heading) over w)) as good from h window w as (partition by doc_id order by run)),
k as (select doc_id, count(*) between 2 and 4 and bool_and(good) as parted from j group by doc_id)
select doc_id, ord, (case when parted then run else 0 end)::bigint as run from r join k using (doc_id)""")
def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.length("line")
    rows = _boxes(spark, sf_dir, "line").withColumns({"doc_id": (F.col("doc_id") * 100000 + F.floor(F.col("ord") / 6)).cast("long"), "bold": length % 3 == 0, "font": F.lit("f"), "size": (F.floor(length / 3) % 2 * 4 + 10).cast("double")})
    return S.style_runs(rows).select("doc_id", "ord", "run")


@query(f"""with {_pages(True)}, a as (select *, (y0 + y1) / 2 - lag((y0 + y1) / 2) over w as pitch, lag(x0) over w as px0, lag(x1) over w as px1 from p window w as (partition by doc_id order by ord)),
l as (select doc_id, list_sort(list(greatest(1.0, y1 - y0))) as hs, list_sort(list(greatest(1.0, x1 - x0))) as ws, list_sort(list(pitch) filter (pitch > 1)) as ps from a group by doc_id),
s as (select doc_id, hs[len(hs) // 2 + 1] as h, ws[least(len(ws), floor(len(ws) * 0.85::double)::int + 1)] as w, ps[greatest(1, floor(len(ps) * 0.25::double)::int)] as q from l),
f as (select a.*, coalesce(pitch > 0 and pitch <= greatest(coalesce(q, h * 1.4::double) * 1.35::double, h * 1.25::double) and (least(px1, x1) - greatest(px0, x0)) / greatest(1.0, least(px1 - px0, x1 - x0)) >= 0.45 and abs(y1 - y0 - h) <= h * 0.35::double and px1 - px0 >= w * 0.68::double and abs(x0 - px0) <= h * 0.9::double, false) as goes_on from a join s using (doc_id))
select doc_id, ord, (sum((not goes_on)::int) over (partition by doc_id order by ord rows unbounded preceding) - 1)::bigint as paragraph from f""")
def recognised_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recognised_paragraphs(paged(_boxes(spark, sf_dir), True)).select("doc_id", "ord", "paragraph")


DRAWN = f"{_pages()}, d as (select * replace (case when ord % 2 = 0 then y1 else y0 + length(line) % 3 end as y1), case when ord % 2 = 0 then 're' else 'l' end as kind from p)"
EDGES = "r as (select doc_id, x0, y0, x1, y0 as y1 from d where x1 - x0 >= 36 and (kind = 're' or y1 - y0 < 2) union all select doc_id, x0, y1, x1, y1 from d where x1 - x0 >= 36 and kind = 're')"


@query(f"with {DRAWN}, {EDGES} select doc_id, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from r group by doc_id having count(*) >= 3")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = F.col("ord") % 2 == 0
    drawn = paged(_boxes(spark, sf_dir, "line")).withColumns({"y1": F.when(rect, F.col("y1")).otherwise(F.col("y0") + F.length("line") % 3), "kind": F.when(rect, "re").otherwise("l")})
    return S.table_regions(S.rules(drawn, PAGE_WIDTH))


@query(f"with {_pages(True)}, g as (select doc_id, ord, y1 as y, y1 - lag(y1) over (partition by doc_id order by y1) as gap from p) select doc_id, arg_min(y, ord) as first, median(gap) filter (gap > 0.5) as pitch from g group by doc_id")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.baselines(paged(_boxes(spark, sf_dir), True).select("doc_id", "ord", F.col("y1").alias("y")))


@query(f"with {_pages()}, t as (select *, {CLEAN} != '' as full_ from p) select a.doc_id, a.ord, bool_or(coalesce(b.full_ and a.ord != b.ord and least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1 and least(a.y1, b.y1) - greatest(a.y0, b.y0) > 1, false)) as overlaps from t a join t b using (doc_id) group by a.doc_id, a.ord")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overlaps_any(paged(_boxes(spark, sf_dir, F.col("line").alias("text")))).select("doc_id", "ord", "overlaps")


@query(None)
def erase_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(_boxes(spark, sf_dir, F.col("line").alias("text"))).withColumn("target", F.when(F.length("text") % 2 == 0, F.col("text")))
    return S.erase_box(rows).select("doc_id", "ord", "erase.*")


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, regexp_replace(regexp_replace(text, '[0-9]', '', 'g'), '[^\p{L}\p{N}]', '', 'g') as hay from documents), k as (select *, regexp_replace(line, '[^\p{L}\p{N}]', '', 'g') as needle from l where line != '')
select doc_id, count(*)::int as checked, count(*) filter (length(needle) >= 2 and not contains(hay, needle))::int as missing from k group by doc_id""")
def output_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return verification.verified(doc_lines(spark, sf_dir).withColumnRenamed("line", "target"), docs.select("doc_id", F.regexp_replace("text", "[0-9]", "").alias("text")))


@query("select doc_id, n >= 0 and n < 40 and share >= 0.35 as needed, case when n >= 40 then 'text' when share >= 0.35 then 'scan' when n = 0 then 'blank' else 'few images' end as why from (select doc_id, length(regexp_replace(text, '[ \\t\\n]', '', 'g')) % 60 as n, doc_id % 100 / 100.0::double as share from documents)")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.length(F.regexp_replace("text", "[ \\t\\n]", "")) % 60
    return table(spark, sf_dir, "documents").select("doc_id", S.needs_recognition(chars, F.col("doc_id") % 100 / 100.0).alias("x")).select("doc_id", "x.*")


def _has(parts: tuple[str, ...]) -> str:
    return f"regexp_matches(name, '{style.any_part(parts)}')"


@query(f"""with f as (select p_partkey, lower(p_name) as name, p_size, (p_partkey * 7919 % 16777216)::int as c, p_retailprice::double as pitch from part)
select p_partkey, {_has(style.SERIF)} as serif, {_has(style.BOLD)} or p_size & 16 != 0 as bold, {_has(style.MONO)} as mono, {_has(style.ITALIC)} or p_size & 2 != 0 as italic,
case when 0.299::double * (((c >> 16) & 255) / 255.0::double) + 0.587::double * (((c >> 8) & 255) / 255.0::double) + 0.114::double * ((c & 255) / 255.0::double) > 0.55 then 0 else 16777215 end as ink,
least(greatest(pitch, p_size * 60.0::double), p_size * 60.0::double * 1.8::double) as leading from f""")
def font_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    color = (F.col("p_partkey") * 7919 % 16777216).cast("int")
    made = table(spark, sf_dir, "part").select("p_partkey", style.font_style(F.concat(F.lit("ABCDEF+"), F.upper("p_name")), F.col("p_size")).alias("s"), style.readable_on(color).alias("ink"), style.leading(F.col("p_size") * 60.0, F.col("p_retailprice").cast("double")).alias("leading"))
    return made.select("p_partkey", "s.*", "ink", "leading")


@query(None)
def fitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir, F.col("line").alias("text")).select("doc_id", "ord", "text", (F.col("x1") - F.col("x0")).alias("width"), F.lit(60.0).alias("height"))
    return setting.fit_rows(rows).select("doc_id", "ord", "size", F.size("lines").alias("n_lines"), "fits")
