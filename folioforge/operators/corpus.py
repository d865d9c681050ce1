"""Operators over a corpus: documents, their lines as paragraphs, and boxes on pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from folioforge.functions import text as T
from folioforge.sources.tables import materialise


def lines(docs: DataFrame) -> DataFrame:
    """One row a line: doc_id, source, lang, ord (from 0), n (lines of the document), line.

    The generator makes all three: a count beside it is moved behind it by the optimizer, and takes the whole text along with
    each line, into the queues of Python workers too."""
    of = lambda parts: F.transform(parts, lambda line, ord: F.struct(F.size(parts).alias("n"), ord.alias("ord"), line.alias("line")))
    return docs.select("doc_id", "source", "lang", F.inline(T.bound(F.split("text", "\n"), of)))


def repeated_keys(paragraphs: DataFrame, zone_share: float, body_share: float) -> DataFrame:
    """(source, key, pages): keys on enough pages of a source; fewer suffice if a key ever stands at a page's edge.

    Keys are as long as lines, so hashes of them are counted first, and keys themselves only where their hash has enough
    pages. Keys of one hash have together at least the pages of each, so none is lost, and the second count is exact."""
    edge = (F.col("ord") == 0) | (F.col("ord") == F.col("n") - 1)
    keyed = paragraphs.where(T.has_key(F.col("line"))).select("source", "doc_id", edge.alias("edge"), T.match_key(F.col("line")).alias("key"))
    hashed = keyed.select("source", "doc_id", "edge", F.xxhash64("key").alias("hash"), F.length("key").alias("chars"), "key")
    total = paragraphs.where("ord = 0").groupBy("source").agg(F.countDistinct("doc_id").alias("total"))  # each document has one first line

    def enough(rows: DataFrame, by: str) -> DataFrame:
        some = rows.groupBy("source", by).agg(F.countDistinct("doc_id").alias("pages"), F.max("edge").alias("zone"), F.min("chars").alias("least"), F.max("chars").alias("most")).where("most >= 2 and least <= 300")
        need = F.when(F.col("zone"), F.greatest(F.lit(2), F.floor(F.col("total") * zone_share))).otherwise(F.greatest(F.lit(3), F.floor(F.col("total") * body_share)))
        return some.join(total, "source").where(F.col("pages") >= need)

    wanted = materialise(enough(hashed.drop("key"), "hash").select("source", "hash"), "hashes")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return enough(hashed.join(few, ["source", "hash"], "left_semi"), "key").select("source", "key", "pages")


#: Rows of (source, key) up to which they are broadcast, about 64 MB; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def with_repeated(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows (source, key) with `repeated`, true or null. Keys too short to be repeated, blank ones above all, take no part in a
    shuffle."""
    found = materialise(repeated.select("source", "key", F.lit(True).alias("repeated")), "repeated")
    if found.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), ["source", "key"], "left")
    long = F.length("key").between(2, 300)
    rest = rows.where(~F.coalesce(long, F.lit(False))).withColumn("repeated", F.lit(None).cast("boolean"))
    return rows.where(long).join(found, ["source", "key"], "left").unionByName(rest)


def leaders(paragraphs: DataFrame) -> DataFrame:
    """(key, doc_id, ord, followers): the first paragraph of each key, and how many repeat it."""
    keyed = paragraphs.where(T.has_key(F.col("line"))).withColumn("key", T.match_key(F.col("line")))
    got = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "ord")).alias("x"), (F.count("*") - 1).alias("followers"), F.max(F.length("key")).alias("chars")).where("chars > 0")
    return got.select("key", "x.doc_id", "x.ord", "followers")


def cache_key(c: Column, provider: str = "mock", model: str = "mock", target: str = "zh", prompt: str = "", glossary: str = "") -> Column:
    """The name under which a translation is kept. Own instructions and a glossary change answers, so they are part of it
    where there are any; white space around them is not."""
    more = [F.lit(x.strip()) for x in (prompt, glossary)] if prompt.strip() or glossary.strip() else []
    return F.substring(F.sha1(F.to_json(F.array(F.lit(provider), F.lit(model), F.lit(target), *more, T.clean_text(c)))), 1, 32)


def weighted_mode(rows: DataFrame, by: str, value: str, weight: Column, order: str) -> DataFrame:
    """(by, value, weight): the value of most weight in each group, of ties the one that comes first."""
    sums = rows.groupBy(by, value).agg(F.sum(weight).alias("w"), F.min(order).alias("first"))
    got = sums.groupBy(by).agg(F.max(F.struct("w", (-F.col("first")).alias("f"), value)).alias("x"))
    return got.select(by, F.col(f"x.{value}").alias(value), F.col("x.w").alias("weight"))


def join_pieces(pieces: Column) -> Column:
    """Pieces in order as one text, a space only between ASCII letters or digits."""
    real = F.filter(pieces, lambda p: p != "")

    def glued(p: Column, i: Column) -> Column:
        return F.when(F.get(real, i - 1).rlike("[A-Za-z0-9]$") & p.rlike("^[A-Za-z0-9]"), F.concat(F.lit(" "), p)).otherwise(p)

    return F.array_join(F.transform(real, glued), "")


def batches(sizes: Column, most_items: int = 12, most_chars: int = 6000) -> Column:
    """The batch (from 0) of each item of an array of lengths: a batch is closed when it is full or the next is too long."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for lengths in rows:
            if lengths is None:
                out.append(None)
                continue
            total = np.concatenate(([0], np.cumsum(lengths)))
            batch, at, n = np.empty(len(lengths), np.int32), 0, 0
            while at < len(lengths):
                to = int(np.searchsorted(total, total[at] + most_chars, "right")) - 1
                to = max(at + 1, min(to, at + most_items))
                batch[at:to] = n
                at, n = to, n + 1
            out.append(batch)
        return pd.Series(out, dtype=object)

    return run(sizes)


# Boxes on pages: (doc_id, ord, x0, y0, x1, y1)


def boxes(paragraphs: DataFrame, *keep: str | Column) -> DataFrame:
    """A box for each line of the corpus, in two columns of a page, with columns to keep; stands in for parsed geometry."""
    x0 = (F.col("ord") % 2) * 260 + 40
    return paragraphs.select("doc_id", "ord", x0.cast("double").alias("x0"), ((F.floor(F.col("ord") / 2) % 50) * 14 + 20).cast("double").alias("y0"), (x0 + 20 + F.length("line") % 200).cast("double").alias("x1"), ((F.floor(F.col("ord") / 2) % 50) * 14 + 30 + F.length("line") % 7).cast("double").alias("y1"), *keep)


def clusters(rows: DataFrame, gap: float | Column = 15.0, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows with `cluster` (from 0 in each document): a new one where x0 lies more than gap right of all boxes before."""
    order = Window.partitionBy(*by).orderBy("x0", "y0", "ord")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.coalesce((F.col("x0") - reach > gap).cast("int"), F.lit(0)))
    return flagged.withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def contained(rows: DataFrame, regions: list[tuple], by_height: bool = False) -> DataFrame:
    """rows with `region`: of the regions (name, x0, y0, x1, y1; a short list that holds for all pages) that hold a box's
    centre, edges included, the first by name or by_height the flattest. For regions by page see regions.constrained."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    known = sorted((d - b if by_height else 0.0, n, a, b, c, d) for n, a, b, c, d in regions)
    out = F.lit(None).cast("string")
    for _, n, a, b, c, d in reversed(known):
        out = F.when(cx.between(a, c) & cy.between(b, d), n).otherwise(out)
    return rows.withColumn("region", out)


def room_below(rows: DataFrame, page_height: float) -> DataFrame:
    """rows with `room`: from a box's lower edge to the nearest upper edge of a box of its column whose centre is lower."""
    column = Window.partitionBy("doc_id", "x0").orderBy("_c")
    placed = rows.withColumn("_c", F.col("y0") + F.col("y1")).withColumn("_r", F.dense_rank().over(column))
    lower = Window.partitionBy("doc_id", "x0").orderBy("_r").rangeBetween(1, Window.unboundedFollowing)
    return placed.withColumn("room", F.greatest(F.lit(0.0), F.coalesce(F.min("y0").over(lower), F.lit(page_height)) - F.col("y1"))).drop("_c", "_r")
