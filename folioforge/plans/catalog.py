"""All queries of the engine, with the same results as DuckDB SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import corpus as C
from folioforge.sources import store
from folioforge.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lines(table(spark, sf_dir, "documents"))


LINES = "lines as (select doc_id, source, lang, len(p) as n, generate_subscripts(p, 1) - 1 as ord, unnest(p) as line from (select *, string_split(text, chr(10)) as p from documents))"
CLEAN = r"regexp_replace(regexp_replace(replace(replace(line, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x{3000}]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
KEY = rf"lower(regexp_replace({CLEAN}, '\s+', '', 'g'))"


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAGE = " or ".join(f"regexp_matches(s, {_sql(p)})" for p in T.PAGE_NUMBER)
DENSE = r"(length(s) - length(regexp_replace(s, '[{}\[\]();=<>]', '', 'g')))"
CODE = f"(regexp_matches(s, {_sql(T.CODE_START)}) or (length(s) > 8 and {DENSE} / length(s) > 0.18))"
PLAIN = rf"(length(s) >= 2 and not regexp_matches(s, {_sql(T.URL_ONLY)}) and not regexp_matches(s, {_sql(T.EMAIL_ONLY)}) and not regexp_matches(s, {_sql(T.NUMBER_ONLY)}) and regexp_matches(s, '\p{{L}}') and length(regexp_replace(s, '[^\p{{L}}\p{{N}}_]', '', 'g')) >= 2)"
REASON = f"case when s = '' then 'empty' when length(s) <= 24 and ({PAGE}) then 'page_num' when {CODE} then 'code' when not {PLAIN} then 'not_translatable' else 'translatable' end"
JUDGED = f"with {LINES}, cleaned as (select *, {CLEAN} as s from lines), judged as (select *, {REASON} as reason from cleaned)"


@query(f"{JUDGED} select lang, reason, count(*) as n_lines, sum(length(line)) as chars from judged group by all")
def line_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = doc_lines(spark, sf_dir).withColumn("reason", T.skip_reason(F.col("line")))
    return judged.groupBy("lang", "reason").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


@query(f"{JUDGED} select source, count(distinct doc_id) as pages, count(*) as paragraphs, count(*) filter (reason = 'translatable') as translatable, sum(length(line)) as chars, count(*) filter (reason = 'code') as code, count(*) filter (reason = 'page_num') as page_numbers from judged group by all")
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = doc_lines(spark, sf_dir).withColumn("reason", T.skip_reason(F.col("line")))
    return judged.groupBy("source").agg(F.countDistinct("doc_id").alias("pages"), F.count("*").alias("paragraphs"), F.count_if(F.col("reason") == "translatable").alias("translatable"), F.sum(F.length("line")).alias("chars"), F.count_if(F.col("reason") == "code").alias("code"), F.count_if(F.col("reason") == "page_num").alias("page_numbers"))


@query(f"""with {LINES}, keyed as (select *, {KEY} as key from lines), total as (select source, count(distinct doc_id) as total from lines group by 1),
c as (select source, key, count(distinct doc_id) as pages, bool_or(ord = 0 or ord = n - 1) as zone from keyed where length(key) between 2 and 300 group by all)
select source, key, pages from c join total using (source) where pages >= case when zone then greatest(2, floor(total * 0.04)) else greatest(3, floor(total * 0.06)) end""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeated_keys(doc_lines(spark, sf_dir), 0.04, 0.06)


@query(f"with {LINES}, keyed as (select *, {KEY} as key from lines) select key, (min((doc_id, ord)))[1] as doc_id, (min((doc_id, ord)))[2]::int as ord, count(*) - 1 as followers from keyed where key != '' group by key")
def dedup_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.leaders(doc_lines(spark, sf_dir))


@query(f"with {LINES}, s as (select *, {CLEAN} as s from lines), cache as (select distinct s from s where lang = 'en' and s != '') select lang, count(*) as misses, count(distinct s.s) as distinct_misses from s where s.s != '' and s.s not in (select s from cache) group by lang")
def cache_miss_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = doc_lines(spark, sf_dir).where(T.clean_text(F.col("line")) != "").withColumn("cache_key", C.cache_key(F.col("line")))
    cache = keyed.where("lang = 'en'").select("cache_key").distinct()
    missed = keyed.join(cache, "cache_key", "left_anti")
    return missed.groupBy("lang").agg(F.count("*").alias("misses"), F.countDistinct("cache_key").alias("distinct_misses"))


@query("select lang, count(*) as n_docs, sum(n_chars) as chars from documents where doc_id in (select unnest(range(0, 5)) union select 7 union select unnest(range(14, 20)) union select unnest(range(99, 180))) group by lang")
def page_range_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spark.createDataFrame([("1-5，8; 20~15 x-y 100至180, 0", 180)], "spec string, total int")
    pages = spec.select(F.explode(T.page_range(F.col("spec"), F.col("total"))).alias("page")).select(F.col("page").cast("long").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(pages, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


@query(r"select lang, sum(case when text = '' then 0 else floor((length(text) - length(regexp_replace(text, '[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]', '', 'g'))) * 1.05::double + length(regexp_replace(text, '[\x{3000}-\x{9fff}\x{ff00}-\x{ffef}]', '', 'g')) / 3.6::double)::bigint + 1 end)::bigint as tokens from documents group by lang")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


@query(f"with {LINES}, s as (select *, {CLEAN} as s from lines) select doc_id, ord::int as ord, {DENSE}::int as symbols, {CODE} as code from s where {DENSE} > 0")
def code_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_lines(spark, sf_dir).select("doc_id", "ord", T.symbol_count(T.clean_text(F.col("line")), T.CODE_SYMBOLS).alias("symbols"), T.looks_like_code(F.col("line")).alias("code"))
    return found.where("symbols > 0")


@query(r"select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) as token from documents) group by token")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.number_tokens(F.col("text"))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(None)
def missing_numbers_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", "source", "text")
    first = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("target"))
    return docs.join(first, "source").select("doc_id", T.missing_numbers(F.col("text"), F.col("target")).alias("missing"))


@query("""with w as (select source, lang, sum(greatest(1, n_chars)) as w, min(doc_id) as f from documents group by all)
select source, arg_max(lang, (w, -f)) as lang, max(w)::bigint as weight from w group by source""")
def weighted_mode_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.weighted_mode(table(spark, sf_dir, "documents"), "source", "lang", F.greatest(F.lit(1), F.col("n_chars")), "doc_id")


@query(f"with {LINES}, e as (select source, length(line) % 12 + 6 as size, unnest(range(0, greatest(1, least(400, greatest(1, length(line))) // 40))) from lines) select source, median(size)::double as body_size from e group by source")
def median_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.greatest(F.lit(1), F.floor(F.least(F.lit(400), F.greatest(F.lit(1), F.length("line"))) / 40)).cast("int")
    rows = doc_lines(spark, sf_dir).select("source", (F.length("line") % 12 + 6).alias("size"), times.alias("times"))
    return rows.groupBy("source").agg(F.expr("percentile(size, 0.5, times)").alias("body_size"))


BOXES = f"{LINES}, boxes as (select doc_id, line, source, ord::int as ord, ((ord % 2) * 260 + 40)::double as x0, ((ord // 2 % 50) * 14 + 20)::double as y0, ((ord % 2) * 260 + 60 + length(line) % 200)::double as x1, ((ord // 2 % 50) * 14 + 30 + length(line) % 7)::double as y1 from lines)"
CELLS = [("a", 0.0, 0.0, 300.0, 200.0), ("b", 300.0, 0.0, 600.0, 200.0), ("c", 0.0, 150.0, 600.0, 420.0), ("d", 100.0, 400.0, 380.0, 800.0)]
GRID = "cells(region, rx0, ry0, rx1, ry1) as (values " + ", ".join(f"('{r}', {a}, {b}, {c}, {d})" for r, a, b, c, d in CELLS) + ")"
INSIDE = "(x0 + x1) / 2 between rx0 and rx1 and (y0 + y1) / 2 between ry0 and ry1"


def _boxes(spark: SparkSession, sf_dir: str, *keep) -> DataFrame:
    return C.boxes(doc_lines(spark, sf_dir), *keep)


@query(f"""with {BOXES}, r as (select *, max(x1) over (partition by doc_id order by x0, y0, ord rows between unbounded preceding and 1 preceding) as reach from boxes),
g as (select doc_id, ord, sum(coalesce((x0 - reach > 15)::int, 0)) over (partition by doc_id order by x0, y0, ord rows unbounded preceding) as cluster from r)
select doc_id, cluster::bigint as cluster, count(*) as n from g group by all""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clusters(_boxes(spark, sf_dir)).groupBy("doc_id", "cluster").agg(F.count("*").alias("n"))


@query(f"with {BOXES}, {GRID} select doc_id, ord, min(region) as region from boxes left join cells on {INSIDE} group by all")
def center_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contained(_boxes(spark, sf_dir), CELLS).select("doc_id", "ord", "region")


@query(f"with {BOXES}, {GRID} select doc_id, ord, arg_min(region, (ry1 - ry0, region)) as region from boxes left join cells on {INSIDE} group by all")
def row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contained(_boxes(spark, sf_dir), CELLS, by_height=True).select("doc_id", "ord", "region")


@query(f"with {BOXES} select a.doc_id, a.ord, greatest(0.0, coalesce(min(b.y0), 842.0) - a.y1)::double as room from boxes a left join boxes b on a.doc_id = b.doc_id and a.x0 = b.x0 and b.y0 + b.y1 > a.y0 + a.y1 group by a.doc_id, a.ord, a.y1")
def next_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.room_below(_boxes(spark, sf_dir), 842.0).select("doc_id", "ord", "room")


@query("select doc_id, sha256(list_reduce(string_split(text, chr(10)), lambda a, b: a || case when regexp_matches(a, '[A-Za-z0-9]$') and regexp_matches(b, '^[A-Za-z0-9]') then ' ' else '' end || b)) as joined from documents")
def piece_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(C.join_pieces(F.split("text", "\n")), 256).alias("joined"))


@query("""with recursive items as (select doc_id, generate_subscripts(p, 1) as i, len(p) as m, length(unnest(p)) as n from (select doc_id, string_split(text, chr(10)) as p from documents)),
r(doc_id, i, m, b, k, c) as (select doc_id, i, m, 0, 1, n from items where i = 1 union all
select r.doc_id, x.i, r.m, r.b + (r.k >= 12 or r.c + x.n > 6000)::int, case when r.k >= 12 or r.c + x.n > 6000 then 1 else r.k + 1 end, case when r.k >= 12 or r.c + x.n > 6000 then x.n else r.c + x.n end from r join items x on x.doc_id = r.doc_id and x.i = r.i + 1)
select doc_id, b::int as batch, count(*) as items from r group by all""")
def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    packed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.batches(sizes)).alias("ord", "batch"))
    return packed.groupBy("doc_id", "batch").agg(F.count("*").alias("items"))


@query("""select event_id, ts, user_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 order by ts desc, event_id desc limit 50""")
def history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "event_id", F.struct("ts", "event_id").alias("finished_at"))
    return store.history(tasks).select("event_id", "finished_at.ts", F.col("task_id").alias("user_id"))
