"""Sharding by sampled splitters, with DataFrame operations only.

Records are put in the order of a 64-bit key and the key space is cut into shards of near-equal bytes. (1) A sample
weighted by size, of a fixed expected number of keys, gives quantile splitters of many narrow ranges. (2) Exact sizes of
the ranges are summed, and ranges that hold more than twice their share are subdivided by a denser sample of their own.
(3) Running sums inside each range, started at the exact sizes of the ranges before it, give each record its position.

The default key has 40 bits of the text's hash above 24 bits of the id's hash: equal texts lie side by side, yet a text
that makes up a third of the table is still cut into many ranges. Only the keys and sizes are shuffled, never the text.

Defined cases: a null text has size 1 and no checksum; an empty one size 1; null ids and repeated rows are placed as
any others; an empty table gives an empty table; only the columns asked for are read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import materialise, small

SHARDS = 16
#: Narrow ranges a shard, and expected sample keys a range; both fixed, so that what reaches the driver is bounded.
RANGES_A_SHARD = 16
KEYS_A_RANGE = 24
ROUNDS = 3
_LOW = (1 << 24) - 1


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def content_key(text: Column, *ids: Column) -> Column:
    """Equal texts side by side, told apart by their ids."""
    high, low = F.xxhash64(text), F.xxhash64(*ids)
    return high.bitwiseAND(F.lit(~_LOW)).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most the key: a coarse step over every w-th splitter, then one over w of them."""
    if not splitters:
        return F.lit(0)
    w = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + w] for i in range(0, len(splitters), w)]
    coarse = F.size(F.filter(_longs([b[0] for b in blocks]), lambda s: s <= key))
    fine = F.from_json(F.lit("[[]," + ",".join("[" + ",".join(map(str, b)) + "]" for b in blocks) + "]"), "array<array<bigint>>")
    inside = F.size(F.filter(F.element_at(fine, coarse + 1), lambda s: s <= key))
    return F.greatest(coarse - 1, F.lit(0)) * w + inside


def _sampled(keys: DataFrame, unit: float, seed: int) -> list[int]:
    """Keys drawn once for every `unit` bytes on average, in order; larger records count as often as they fill units."""
    draw = F.pmod(F.xxhash64("key", "size", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("size") / F.lit(unit) + draw).cast("int")
    rows = keys.select("key", times.alias("times")).where("times > 0").collect()  # as many as total size / unit
    return sorted(k for r in rows for k in [r["key"]] * r["times"])


def _quantiles(keys: list[int], parts: int) -> list[int]:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def splitters(keys: DataFrame, parts: int, keys_a_range: int = KEYS_A_RANGE, rounds: int = ROUNDS) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Splitters of (key, size) into about `parts` even ranges, and rows and bytes of each range."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], {}
    cuts = _quantiles(_sampled(keys, total / (parts * keys_a_range), 0), parts)
    share, filled = total / parts, {}
    for turn in range(rounds + 1):
        sums = keys.groupBy(range_of(F.col("key"), cuts).alias("r")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        filled = {r["r"]: (r["n"], r["b"]) for r in sums.collect()}  # a row for each range
        full = sorted(r for r, (n, b) in filled.items() if b > 2 * share and n > 1)
        if not full or turn == rounds:
            break
        at = F.array_contains(_longs(full), range_of(F.col("key"), cuts).cast("long"))
        more = _sampled(keys.where(at), share / keys_a_range, turn + 1)
        new = set(cuts)
        for r in full:
            inside = [k for k in more if bisect_right(cuts, k) == r]
            new.update(_quantiles(inside, max(2, round(filled[r][1] / share))))
        if len(new) == len(cuts):  # one key alone fills each of them
            break
        cuts = sorted(new)
    return cuts, filled


def shard_by_splitters(keys: DataFrame, shards: int = SHARDS, ranges_a_shard: int = RANGES_A_SHARD) -> DataFrame:
    """(key, size, ...) with `shard` (0 to shards-1, in key order, bytes near equal) and `slot` (gapless from 0 in each)."""
    names = keys.columns
    cuts, filled = splitters(keys, shards * ranges_a_shard)
    total = sum(b for _, b in filled.values())
    before: list[tuple[int, int, int]] = []
    rows = size = 0
    for r in range(len(cuts) + 1):
        before.append((r, rows, size))
        n, b = filled.get(r, (0, 0))
        rows, size = rows + n, size + b
    rows0, size0 = (F.element_at(_longs([x[k] for x in before]), F.col("_r") + 1) for k in (1, 2))
    inside = Window.partitionBy("_r").orderBy("key", *(c for c in names if c != "key"))
    placed = (
        keys.withColumn("_r", range_of(F.col("key"), cuts))
        .withColumn("_row", F.row_number().over(inside) - 1)
        .withColumn("_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.col("_row") + rows0)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("_end") + size0 - F.col("size") / 2) * shards / F.lit(max(1, total)))).cast("int"))
        .select(*names, "shard", "_row")
    )
    placed = materialise(placed, "shards")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # a row for each shard
    return placed.join(small(first, shards), "shard").withColumn("slot", (F.col("_row") - F.col("_first")).cast("long")).select(*names, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.col("text")
    keys = docs.select("doc_id", byte_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), content_key(text, F.col("doc_id")).alias("key"))
    keys = materialise(keys, "keys")
    out = shard_by_splitters(keys, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
