"""Translation of the paragraphs of a corpus: each text once, cached texts never, in batches, with numbers checked.

Null and blank paragraphs and those with a skip reason have no target and no error; an empty table gives an empty table.
The plan reads the answers once, so no text is asked for twice; a task that is lost asks again for its own texts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import corpus, replies
from folioforge.plans.catalog import CLEAN, KEY, JUDGED, doc_lines, query
from folioforge.sources import providers
from folioforge.sources.cache import Cache
from folioforge.sources.tables import materialise

# Items and characters of a request, and further tries with what a reply lacks.
ITEMS, CHARS, TRIES = 12, 6000, 2
#: Pieces that are asked for before any is handed on; whole requests.
FRAME = 1_200
NO_ANSWER, NUMBERS = "no translation", "numbers missing: "


def batched(texts: list[str], items: int = ITEMS, chars: int = CHARS) -> Iterator[list[int]]:
    """Positions of texts, in order, in batches of at most so many items and characters (one longer text is a batch)."""
    batch: list[int] = []
    total = 0
    for k, t in enumerate(texts):
        if batch and (len(batch) == items or total + len(t) > chars):
            yield batch
            batch, total = [], 0
        batch.append(k)
        total += len(t)
    if batch:
        yield batch


def asked(chat: providers.Provider, texts: list[str], hint: str = "") -> list[tuple[str | None, str | None, int]]:
    """(answer, error, repeats) of each text: together, then what is missing again, then one by one. The error is that of the
    last request without an answer; repeats are requests that had to be made again, by the text that stands first in them."""
    out: list[str | None] = [None] * len(texts)
    errors: list[str | None] = [None] * len(texts)
    repeats = [0] * len(texts)

    def request(at: list[int], again: bool) -> None:
        message = json.dumps([{"i": i, "t": texts[k]} for i, k in enumerate(at, 1)], ensure_ascii=False)
        before = getattr(chat, "repeats", 0)
        try:
            got, why = replies.read_reply(chat(message, hint)), None
        except Exception as e:  # noqa: BLE001  a refusal is the error of its items, not of the job
            got, why = {}, f"{type(e).__name__}: {e}"
        repeats[at[0]] += again + getattr(chat, "repeats", 0) - before
        for i, k in enumerate(at, 1):
            out[k] = got.get(i, out[k])
            errors[k] = None if out[k] is not None else why or NO_ANSWER

    for batch in batched(texts):
        for attempt in range(1 + TRIES):
            if open_ := [k for k in batch if out[k] is None]:
                request(open_, attempt > 0)
        for k in batch:
            if out[k] is None:
                request([k], True)
    return list(zip(out, errors, repeats, strict=True))


def ask(chat: providers.Provider, texts: list[str], hint: str = "") -> list[str | None]:
    """An answer to each text, None where there is none."""
    return [x[0] for x in asked(chat, texts, hint)]


ANSWERED = "key string, chunk int, piece string, target string, why string, repeats int"


def _asking(make: Callable[[], providers.Provider], rows: DataFrame) -> DataFrame:
    """The pieces of rows (key, text), with target, why there is none, and repeats; texts go to Python once, as what they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = providers.patient(make())
        for f in frames:
            parts = [(key, chunk, piece) for key, text in zip(f["key"], f["text"], strict=True) for chunk, piece in enumerate(replies.long_pieces(text))]
            for at in range(0, len(parts), FRAME):  # long texts have many pieces
                some = pd.DataFrame(parts[at : at + FRAME], columns=["key", "chunk", "piece"])
                yield some.assign(**_columns(asked(chat, some["piece"].tolist()), some.index))

    return rows.select("key", "text").mapInPandas(run, ANSWERED)


def _columns(got: list[tuple], index) -> dict[str, pd.Series]:
    return {n: pd.Series([x[k] for x in got], index=index, dtype=t) for k, (n, t) in enumerate((("target", object), ("why", object), ("repeats", "int32")))}


def _asking_again(make: Callable[[], providers.Provider], rows: DataFrame) -> DataFrame:
    """rows, whose targets lack numbers, asked for once more, with a hint that names those of a request."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = providers.patient(make())
        for f in frames:
            pieces, missing, got = f["piece"].tolist(), f["missing"].tolist(), []
            for at in batched(pieces):
                hint = "Keep these numbers: " + ", ".join(sorted({n for k in at for n in missing[k]}))
                got += asked(chat, [pieces[k] for k in at], hint)
            new = _columns(got, f.index)
            yield f.assign(target=new["target"], why=new["why"], repeats=f["repeats"] + new["repeats"] + 1).drop(columns="missing")

    return rows.mapInPandas(run, ANSWERED)


def translate_texts(texts: DataFrame, make: Callable[[], providers.Provider]) -> DataFrame:
    """(key, target, error, repeats, mismatched) of (key, text) with distinct keys: pieces that answer joined, or the first
    error; the requests made again for it, and whether numbers were missing in a first answer."""
    missing = F.when(F.col("target").isNull(), F.array().cast("array<string>")).otherwise(T.missing_numbers(F.col("piece"), F.col("target")))
    first = materialise(_asking(make, texts).withColumn("missing", missing), "asked")  # a lost task does not ask twice
    again = materialise(_asking_again(make, first.where("size(missing) > 0")).withColumn("missing", missing), "answered")
    checked = first.where("size(missing) = 0").unionByName(again)  # what lacks nothing is neither sent, read nor written again
    error = F.when(F.col("target").isNull(), F.coalesce("why", F.lit(NO_ANSWER))).when(F.size("missing") > 0, F.concat(F.lit(NUMBERS), F.array_join("missing", ", ")))
    judged = checked.withColumn("error", error)
    framed = F.concat(F.regexp_extract("piece", r"(?U)^\s*", 0), "target", F.regexp_extract("piece", r"(?U)\s*$", 0))
    part = F.struct("chunk", F.when(F.col("error").isNull(), framed).alias("target"), "error")
    parts = judged.groupBy("key").agg(F.array_sort(F.collect_list(part)).alias("x"), F.sum("repeats").cast("int").alias("repeats"))  # pieces of one text
    parts = parts.join(first.where("size(missing) > 0").select("key").distinct().withColumn("_m", F.lit(True)), "key", "left")
    good = F.filter(F.transform("x", lambda p: p["target"]), lambda t: t.isNotNull())
    whole = F.size(good) == F.size("x")  # white space at the cuts is that of the text
    target = F.when(whole, F.array_join(good, "")).when(F.size(good) > 0, corpus.join_pieces(good))
    bad = F.filter(F.transform("x", lambda p: p["error"]), lambda e: e.isNotNull())
    return parts.select("key", target.alias("target"), F.when(target.isNull(), F.get(bad, F.lit(0))).alias("error"), "repeats", F.coalesce("_m", F.lit(False)).alias("mismatched"))


def _answers(texts: DataFrame, make: Callable[[], providers.Provider], cache: DataFrame | None) -> DataFrame:
    """(key, target, error, repeats, mismatched, origin) of (key, text): from the cache, asked for (new), or asked for because
    numbers are missing in the cached value (stale)."""
    if cache is None:
        return translate_texts(texts, make).withColumn("origin", F.lit("new"))
    known = texts.join(cache.select("key", "value"), "key", "left")
    fits = F.col("value").isNotNull() & (F.size(T.missing_numbers(F.col("text"), F.col("value"))) == 0)
    known = materialise(known.withColumn("fits", fits), "known")
    hits = known.where("fits").select("key", F.col("value").alias("target"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("repeats"), F.lit(False).alias("mismatched"), F.lit("cache").alias("origin"))
    new = translate_texts(known.where(~F.col("fits")), make).join(known.select("key", F.when(F.col("value").isNull(), "new").otherwise("stale").alias("origin")), "key")
    return hits.unionByName(new)


def _name(key: Column) -> Column:
    """A match key in 44 characters (SHA-256), however long the text is."""
    return F.base64(F.unhex(F.sha2(key, 256)))


def _texts(paragraphs: DataFrame, language: str, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """paragraphs with skip_reason and key (short: its name), and (key, text) of the texts to translate: of one key the first.
    Both read one table, so that reasons and keys are computed once."""
    reason = T.skip_reason(F.col("line"), language)
    key = T.key_of_bare(F.col("_bare"))
    rows = paragraphs.select("*", T.bare(F.col("line")).alias("_bare")).select("*", reason.alias("skip_reason"), (_name(key) if short else key).alias("key")).drop("_bare")
    rows = materialise(rows.withColumn("skip_reason", F.when(F.col("skip_reason") != "translatable", F.col("skip_reason"))), "judged")
    leading = rows.where("skip_reason is null").groupBy("key").agg(F.min(F.struct("doc_id", "ord", "line"))["line"].alias("line"))
    return rows, leading.select("key", T.clean_text(F.col("line")).alias("text"))


def _joined(rows: DataFrame, done: DataFrame) -> DataFrame:
    left_alone = rows.where("skip_reason is not null").withColumns({"target": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    return rows.where("skip_reason is null").join(done.select("key", "target", "error"), "key", "left").unionByName(left_alone).drop("key")


def translate(paragraphs: DataFrame, provider: str = "mock", cache: DataFrame | None = None, language: str = "zh") -> DataFrame:
    """paragraphs (doc_id, ord, line) with skip_reason, target and error; cache: (key, value) by match key.

    Paragraphs of one key have the target of the first. A cached value is left aside if numbers are missing in it."""
    rows, texts = _texts(paragraphs, language, short=True)
    named = None if cache is None else cache.select(_name(F.col("key")).alias("key"), "value")
    return _joined(rows, _answers(texts, providers.PROVIDERS[provider], named))


def translate_with(paragraphs: DataFrame, cache: Cache, provider: str = "mock", language: str = "zh") -> tuple[DataFrame, dict[str, int]]:
    """The same with a versioned cache, and the run's counters. One version of the cache takes the new targets; values in
    which numbers were missing are dropped, and stay dropped if nothing better came."""
    rows, texts = _texts(paragraphs, language)
    is_ = lambda o: (F.col("origin") == o).cast("int")
    counted = {
        "texts": F.lit(1), "cache_hits": is_("cache"), "dropped": is_("stale"), "translated": F.col("target").isNotNull().cast("int"), "failed": F.col("target").isNull().cast("int"),
        "retries": F.col("repeats"), "numeric_mismatched": (F.col("mismatched") | (F.col("origin") == "stale")).cast("int"),
    }
    seen = Observation("translation")
    answers = _answers(texts, providers.PROVIDERS[provider], cache.read())
    done = materialise(answers.observe(seen, *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counted.items())), "answers")
    asked_ = done.where("origin != 'cache'")
    cache.apply(asked_.where("target is not null").select("key", F.col("target").alias("value")), asked_.where("origin = 'stale' and target is null").select("key"))
    return _joined(rows, done), {k: int(v) for k, v in seen.get.items()}


@query(f"""{JUDGED}, keyed as (select *, {KEY} as key from judged where reason = 'translatable'), first as (select key, arg_min({CLEAN}, (doc_id, ord)) as s from keyed group by key),
swapped as (select key, translate(s, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') as target from first)
select doc_id, count(*) as translated, sha256(string_agg(target, chr(10) order by ord)) as target_sha256 from keyed join swapped using (key) group by doc_id""")
def translate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = translate(doc_lines(spark, sf_dir).select("doc_id", "ord", "line")).where("target is not null")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "target")))
    return done.groupBy("doc_id").agg(F.count("*").alias("translated"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["target"]), "\n"), 256).alias("target_sha256"))
