"""Quality rules as a short-circuit cascade.

Every rule is a predicate that rejects a document. A bounded sample gives each rule's cost (CPU time) and selectivity
(share of documents rejected); the rules then run in the order of rejections per cost and stop at the first hit. The
verdict is a conjunction, so it does not depend on that order.

Words are runs of characters other than space and U+0009..U+000D. Defined cases: a null text counts as empty and an
empty text has no words, so it fails `few_words`; repeated rows are judged one by one; an empty table gives an empty
table (the rules then keep their given order); columns of the input that are not asked for are passed through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import bounded_sample, free_name, texts

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 2_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """What the rules look at, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes.split cuts at exactly space and U+0009..U+000D

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in " \t\n\x0b\x0c\r")

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by five-word windows that occur twice or more."""
        n = len(self.words)
        if n <= WINDOW:
            return 0
        h = np.fromiter(map(hash, self.words), np.int64, n).view(np.uint64)
        key = h[: n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            key = key * _ODD + h[k : n - WINDOW + 1 + k]
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        hit = np.zeros(len(key), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        cover = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(hit)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        return int((np.cumsum(cover[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: The two base rules and the method's own; integer arithmetic, so that other engines can repeat them exactly.
RULES = (
    Rule("few_words", lambda f: len(f.words) < 10),
    Rule("repetition", lambda f: 100 * f.n_repeat_words > 20 * len(f.words)),
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * len(f.words)),
    Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 50 * len(f.lines)),
    Rule("short_words", lambda f: f.word_chars < 2 * len(f.words)),
    Rule("long_words", lambda f: f.word_chars > 40 * len(f.words)),
)
BASE = ("few_words", "repetition")

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
)


def rule_order(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per second of CPU, as a sample of at most about sample_rows rows shows them."""
    names = [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits = np.zeros(len(rules)), np.zeros(len(rules), np.int64)
        for b in batches:
            for t in texts(b):
                for k, r in enumerate(rules):
                    f, at = Features(t), time.thread_time()
                    hits[k] += r.rejects(f)
                    cost[k] += time.thread_time() - at
        yield pa.RecordBatch.from_pydict({"rule": names, "cost": cost, "hits": hits})

    sample = bounded_sample(df.select(F.col(text).alias("text")), sample_rows, "text")
    seen = sample.mapInArrow(measure, "rule string, cost double, hits long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits"))
    got = {r["rule"]: r["hits"] / max(r["cost"], 1e-9) for r in seen.collect()}  # a row for each rule
    return sorted(names, key=lambda n: (-got.get(n, 0.0), names.index(n)))


def judge(f: Features, ordered: list[Rule]) -> tuple[bool, int]:
    """Whether no rule rejects, and how many rules ran until that was known."""
    for k, r in enumerate(ordered, 1):
        if r.rejects(f):
            return False, k
    return True, len(ordered)


def quality_cascade(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, kept: str = "kept", stats: bool = False) -> DataFrame:
    """df with a boolean column `kept`; with stats also the base figures and base_failed of every document. Each has a free
    name (underscores behind it) if df has a column of that name."""
    by = {r.name: r for r in rules}
    ordered = [by[n] for n in (order or rule_order(df, text, rules))]
    base = [by[n] for n in BASE if n in by]
    extra = [*(STATS.fields if stats else ()), *([T.StructField("base_failed", T.BooleanType())] if stats else ()), T.StructField(kept, T.BooleanType())]
    schema = T.StructType([*df.schema.fields, *(T.StructField(free_name(df, f.name), f.dataType) for f in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in extra}
            for t in texts(b, text):
                f = Features(t)
                out[kept].append(judge(f, ordered)[0])
                if stats:
                    out["n_words"].append(len(f.words))
                    for name in STATS.names[1:]:
                        out[name].append(getattr(f, name))
                    out["base_failed"].append(any(r.rejects(f) for r in base))
            kinds = {n: pa.bool_() if n in (kept, "base_failed") else pa.int64() for n in out}
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, kinds[n]) for n, v in out.items())], names=schema.names)

    return df.mapInArrow(run, schema)


def quality_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows no rule rejects, with their columns as they were."""
    kept = free_name(df, "kept")
    return quality_cascade(df, text, kept=kept).where(F.col(kept)).select(*df.columns)
