"""Secret scans, with DataFrame operations only.

Three base patterns (assignments, access keys, hex runs) are matched over every whole text. The method adds spans: every
unbroken run of at least MIN_RUN key-like characters is scored by two character Markov models, one of random strings and
one of ordinary identifiers; a log-likelihood ratio above THRESHOLD makes it a secret.

The models are trained here from labelled samples: random strings made from hashes in several alphabets, and ordinary
identifiers taken from a bounded sample of the corpus (IDENTIFIER_ROWS different texts; this bounds training only, scanning
covers every row). What reaches the driver is one table of character pairs, at most 128 x 128.

Offsets are code points, end exclusive. Defined cases: a null text counts as empty and has no spans; repeated rows are
scanned one by one; an empty table gives an empty table and a model of random strings against uniform identifiers;
other columns are passed through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import bound
from folioforge.llm.common import bounded_sample, free_name

#: The base patterns and their least length (of group 2, or of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 20
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % MIN_RUN
THRESHOLD = 8.0
RANDOM_ROWS = 20_000
IDENTIFIER_ROWS = 2_000
#: Elements of arrays that grow; spans of a text above which it is cut as an array of characters.
CHUNK = 128
MANY = 64
SPAN = "array<struct<start:int,rank:int,end:int>>"


def running(values: Column, add) -> Column:
    """What add() makes of 0 and all values before each one, as an array. Arrays grow in chunks, not as a whole, so the work
    is linear but for a small share. `values` is a variable of a lambda, computed once."""
    ints = F.array().cast("array<int>")
    steps = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(CHUNK))).otherwise(ints)
    part = lambda s: F.slice(values, s + 1, CHUNK)

    def scan(xs: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), ints.alias("out"))
        return F.aggregate(xs, begin, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    totals = F.transform(steps, lambda s: F.aggregate(part(s), F.lit(0), add))
    return bound(totals, lambda t: F.flatten(F.zip_with(steps, scan(t, F.lit(0)), lambda s, z: scan(part(s), z))))


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Spans of all leftmost non-overlapping matches: the gaps between matches give their offsets."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    good = keep or (lambda hit: F.lit(True))
    sized = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), good(h).alias("good")))

    def placed(rows: Column, before: Column) -> Column:
        span = lambda x, at: F.when(x["good"], F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["hit"]).alias("end")))
        return F.filter(F.zip_with(rows, before, span), lambda s: s.isNotNull())

    sums = lambda rows: bound(F.transform(rows, lambda x: x["gap"] + x["hit"]), lambda n: placed(rows, running(n, lambda a, x: a + x)))
    return F.when(text.rlike(pattern), bound(sized, sums)).otherwise(F.from_json(F.lit("[]"), SPAN))


def base_spans(text: Column) -> list[Column]:
    """One array of spans for each base kind."""
    return [
        _spans(text, ASSIGN, 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6),
        _spans(text, ACCESS, 1),
        _spans(text, HEX, 2),
    ]


# The models


def random_strings(spark: SparkSession, rows: int = RANDOM_ROWS, seed: int = 0) -> DataFrame:
    """Labelled samples of secrets (column s): hash output in hex, base64, base64url, capitals with digits, letters with digits."""
    raw = F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    b64 = F.base64(raw)
    kinds = [F.hex(raw), F.lower(F.hex(raw)), b64, F.translate(b64, "+/", "-_"), F.regexp_replace(b64, "[^A-Za-z0-9]", ""), F.lower(F.regexp_replace(b64, "[^A-Za-z0-9]", "")), F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))]
    pick = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    return spark.range(rows).select(F.substring(pick, 1, 40).alias("s"))


def identifiers(docs: DataFrame, text: str = "text", rows: int = IDENTIFIER_ROWS) -> DataFrame:
    """Labelled samples of ordinary identifiers (column s): words of sampled documents, clear of the base patterns, plain and joined as in code."""
    sample = bounded_sample(docs.select(F.col(text).alias("t")), rows, "t")
    clean = F.col("t")
    for p in (ASSIGN, ACCESS, HEX):
        clean = F.regexp_replace(clean, p, " ")
    words = sample.select(F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit("[A-Za-z]{3,}"), F.lit(0)))).alias("w"))
    low = F.lower("w")
    return words.select(F.explode(F.array(F.col("w"), low, F.concat(low, F.lit("_"), low), F.concat(low, F.initcap("w")), F.concat(low, F.lit("/"), low), F.concat(low, F.lit("-"), low), F.upper("w"))).alias("s"))


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of adjacent characters."""
    codes = F.filter(F.transform(F.split("s", ""), lambda c: F.ascii(c)), lambda c: c > 0)
    both = F.transform(F.sequence(F.lit(0), F.size("codes") - 2), lambda i: F.get("codes", i) * 128 + F.get("codes", i + 1))
    return strings.select(codes.alias("codes")).where("size(codes) >= 2").select(F.explode(both).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def train(secrets: DataFrame, ordinary: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each pair of characters (first * 128 + second), from labelled strings in column s."""
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    both = _pairs(secrets).withColumn("secret", F.lit(True)).unionByName(_pairs(ordinary).withColumn("secret", F.lit(False)))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in both.collect():  # at most two tables of 128 x 128
        counts[r["secret"]][r["pair"]] = r["n"]
    table = [0.0] * (128 * 128)
    for a in alphabet:
        sums = {k: sum(counts[k].get(a * 128 + b, 0) for b in alphabet) + smoothing * len(alphabet) for k in counts}
        for b in alphabet:
            p = {k: (counts[k].get(a * 128 + b, 0) + smoothing) / sums[k] for k in counts}
            table[a * 128 + b] = round(math.log(p[True] / p[False]), 6)
    return table


def train_on(docs: DataFrame, text: str = "text") -> list[float]:
    return train(random_strings(docs.sparkSession), identifiers(docs, text))


def llr(token: Column, table: list[float]) -> Column:
    """Sum of the table over adjacent characters of the token."""
    values = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    parts = F.transform(codes, lambda c, i: F.get(codes, i + 1) + c * 128)
    total = F.aggregate(parts, F.struct(F.lit(-1).alias("_"), F.lit(0.0).alias("sum")), lambda acc, p: F.struct(F.lit(-1).alias("_"), (acc["sum"] + F.coalesce(F.get(values, p), F.lit(0.0))).alias("sum")))
    return total["sum"]


def scan_secrets(df: DataFrame, table: list[float], text: str = "text", spans: str = "secret_spans", threshold: float = THRESHOLD) -> DataFrame:
    """df with an array of (start, rank, end) by start and rank; rank points into KINDS."""
    body, parts = F.coalesce(F.col(text), F.lit("")), [free_name(df, f"_{k}") for k in KINDS]
    found = df.select("*", *(c.alias(n) for c, n in zip([*base_spans(body), _spans(body, RUN, 3, lambda hit: llr(hit, table) > threshold)], parts, strict=True)))
    base = F.concat(*(F.col(n) for n in parts[:3]))
    added = F.filter(F.col(parts[3]), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.select(*(F.col(c) for c in df.columns), F.array_sort(F.concat(base, added)).alias(spans))


def listed(spans: Column) -> Column:
    """kind:start:end joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def redact_secrets(df: DataFrame, table: list[float], text: str = "text", mark: str = "<secret>") -> DataFrame:
    """df with every span of a secret replaced by the mark; overlapping spans become one. n_chars, if there, follows."""
    spans = free_name(df, "_spans")
    found = scan_secrets(df, table, text, spans)
    body = F.col(text)

    def cut(ends: Column) -> Column:
        """The text between spans; `ends` has the greatest end before each span, and of all at last."""
        gap = lambda piece: F.zip_with(F.col(spans), F.slice(ends, F.lit(1), F.size(spans)), lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit(mark))).otherwise(""))
        few = gap(lambda a, b: F.substring(body, a + 1, b - a))
        many = bound(F.split(body, ""), lambda chars: gap(lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")))
        head = F.array_join(F.when(F.size(spans) > MANY, many).otherwise(few), "")
        return F.concat(head, F.substring(body, F.element_at(ends, -1) + 1, F.length(body)))

    last = F.array(F.lit(0))  # a value more, so that the greatest of all is there too
    clean = bound(F.concat(F.transform(spans, lambda s: s["end"]), last), lambda e: bound(running(e, lambda a, x: F.greatest(a, x)), cut))
    out = found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text).cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*df.columns)
