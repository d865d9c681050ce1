"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with runs of white space as one space. A benchmark item of length L may occur in a
document with up to E = floor(ERROR_RATE * L) edits (at any place, against any part of the document). It is cut into
E + 1 pieces, of which one at least must then occur exactly. A piece is known by its length and the hashes of its first and
last run of characters, as long as the greatest power of two that fits, which together cover it; those runs of a text are
hashed once for all lengths, by doubling. A hit is compared with its piece, and around each exact hit Myers' bit-parallel
algorithm gives the least edit distance. Items so short that they may have no edit (below 20 characters) are one piece, and
must not stand inside a word: no letter or digit may go on where they begin or end with one.

Benchmark items are broadcast in blocks of BLOCK_CHARS characters at most (ITEM_CHARS more are counted for each item, so that
many small ones count as what they take); they pass the driver a block at a time, and all benchmarks up to this size take one
pass over the documents. Defined cases: null
and empty texts match nothing, null, empty and blank items are ignored; repeated items are each reported, repeated documents are scanned one by one; an empty table on either side gives no matches; a tie between
places of equal distance goes to the first.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import texts
from folioforge.llm.ngram_join import _STEP

ERROR_RATE = 0.05
BLOCK_CHARS = 48_000_000
ITEM_CHARS = 150
#: Characters of items that are hashed together.
CHUNK = 1_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of near-equal length, with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        out[c] |= 1 << k
    return dict(out)


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and where the first such substring ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down = full, 0
    score = best = m
    at = 0
    for k, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(xh | up))
        minus = up & xh
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, at = score, k
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(xv | plus))
        down = plus & xv
    return best, at


def run_hashes(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, the hash of each run of k code points) for each power of two up to `longest`, by doubling."""
    run, size, base = codes.astype(np.uint64) + _STEP, 1, _STEP
    while len(run):
        yield size, run * _STEP ^ (run >> np.uint64(29))
        if 2 * size > longest:
            return
        run = run[: len(run) - size] * base + run[size:] if len(run) > size else run[:0]
        size, base = 2 * size, np.uint64(int(base) ** 2 & (2**64 - 1))


def piece_keys(first: np.ndarray, last: np.ndarray, n) -> np.ndarray:
    """The key of pieces of n characters by the hashes of their first and last run."""
    x = (first * _STEP + last) * _STEP + np.asarray(n).astype(np.uint64)
    return x * _STEP ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Matcher:
    """A block of benchmark items, ready to search. Arrays of small numbers by piece; items are hashed a chunk at a time."""

    def __init__(self, items: list[tuple[object, str]], rate: float = ERROR_RATE):
        self.items = [(i, t) for i, t in ((i, normal(t or "")) for i, t in items) if t]
        size = np.array([len(t) for _, t in self.items], np.int64)
        self.errors = (rate * size).astype(np.int32)
        chunk = np.cumsum(size) // CHUNK
        parts = [self._pieces(which, size) for c in np.unique(chunk) for which in [np.flatnonzero(chunk == c)]]
        keys, item, at, end, run, first = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, t) for t in (np.uint64, np.int32, np.int32, np.int32, np.int32, np.uint64))
        order = np.argsort(keys, kind="stable")
        self.keys, self.piece_item, self.piece_at, self.piece_end = keys[order], item[order], at[order], end[order]
        # for each run length: which lengths pieces have, and a bitmap that says no to most first runs
        self.bits = min(26, max(10, int(len(keys)).bit_length() + 3))
        self.shift = np.uint64(64 - self.bits)
        self.lengths, self.seen = {}, {}
        for k in np.unique(run).tolist():
            mine = run == k
            self.lengths[k] = np.unique((end - at)[mine]).tolist()
            self.seen[k] = np.zeros(1 << self.bits, bool)
            self.seen[k][first[mine] >> self.shift] = True
        self.peq: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def _pieces(self, which: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Key, item, place, end, run length and first run's hash of the pieces of some items."""
        n = self.errors[which].astype(np.int64) + 1
        owner = np.repeat(np.arange(len(which)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        n, long = np.repeat(n, n), size[which][owner]
        at, end = long * k // n, long * (k + 1) // n
        base = (np.cumsum(size[which]) - size[which])[owner]
        run = 1 << np.floor(np.log2(end - at)).astype(np.int64)
        first, last = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.uint64)
        for r, h in run_hashes(_codes("".join(self.items[i][1] for i in which.tolist())), int(run.max())):
            mine = run == r
            first[mine], last[mine] = h[(base + at)[mine]], h[(base + end - run)[mine]]
        return piece_keys(first, last, end - at), which[owner].astype(np.int32), at.astype(np.int32), end.astype(np.int32), run.astype(np.int32), first

    def hits(self, text: str) -> Iterator[tuple[int, int]]:
        """(place in the text, piece), for pieces whose keys are there."""
        codes = _codes(text)
        for k, h in run_hashes(codes, max(self.lengths, default=0)):
            if k not in self.lengths:
                continue
            near = np.flatnonzero(self.seen[k][h >> self.shift])
            for n in self.lengths[k] if len(near) else ():
                at = near[near + n <= len(codes)]
                key = piece_keys(h[at], h[at + n - k], n)
                lo = np.searchsorted(self.keys, key)
                there = np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == key)
                hi = np.searchsorted(self.keys, key[there], "right")
                for p, a, b in zip(at[there].tolist(), lo[there].tolist(), hi.tolist(), strict=True):
                    for e in range(a, b):
                        yield p, e

    def search(self, text: str, first: bool = False) -> list[tuple[object, int, int, int, int]]:
        """(item, distance, errors allowed, start, end) in the normal text, the best place of each item; with first any one."""
        text = normal(text)
        out = []
        shifts: dict[int, set[int]] = defaultdict(set)
        whole: dict[int, int] = {}
        for p, e in self.hits(text):
            k, at, end = int(self.piece_item[e]), int(self.piece_at[e]), int(self.piece_end[e])
            if not text.startswith(self.items[k][1][at:end], p):
                continue
            if self.errors[k]:
                shifts[k].add(p - at)
            elif p < whole.get(k, len(text)) and not inside_word(text, p, p + end):
                whole[k] = p
                if first:
                    return [(self.items[k][0], 0, 0, p, p + end)]
        out += [(self.items[k][0], 0, 0, p, p + len(self.items[k][1])) for k, p in whole.items()]
        for k, starts in shifts.items():
            item, e = self.items[k][1], int(self.errors[k])
            m = len(item)
            if k not in self.peq:
                if len(self.peq) >= 10_000:
                    self.peq.clear()
                self.peq[k] = masks(item), masks(item[::-1])
            best: tuple[int, int, int] | None = None
            spans: list[list[int]] = []
            for s in sorted(starts):
                if spans and s - spans[-1][1] <= 2 * e:
                    spans[-1][1] = s
                else:
                    spans.append([s, s])
            for lo, hi in spans:
                a, b = max(0, lo - e), hi + m + e
                d, end = myers(self.peq[k][0], m, text[a:b])
                if d <= e and (best is None or d < best[0]):
                    back = myers(self.peq[k][1], m, text[max(0, a + end - m - e) : a + end][::-1])
                    best = d, a + end - back[1], a + end
            if best:
                out.append((self.items[k][0], best[0], e, best[1], best[2]))
                if first:
                    break
        return out


def inside_word(text: str, start: int, end: int) -> bool:
    """Whether a letter or digit goes on over an end of text[start:end]."""
    goes_on = lambda k: 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
    return goes_on(start) or goes_on(end)


def blocks(benchmark: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about `size` characters, ITEM_CHARS more for each item, one block at a time on the driver."""
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = -(-(items.agg(F.sum(F.length("text") + ITEM_CHARS)).first()[0] or 0) // size)
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).sort("item_id", "text").collect()]


class Block:
    """Items as a broadcast variable with a name of its own."""

    def __init__(self, docs: DataFrame, items: list[tuple[object, str]]):
        self.id, self.sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)


_last: list = [None, None]


def matcher(items: Block, rate: float) -> Matcher:
    """The worker's matcher of a broadcast block; a worker keeps the last one."""
    if _last[0] != (items.id, rate):
        _last[:] = [(items.id, rate), Matcher(items.sent.value, rate)]
    return _last[1]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that it holds: distance, errors allowed, and the place as words of the document."""
    schema = "doc_id long, item_id long, distance int, allowed int, start_word int, end_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    for part in blocks(benchmark, block):
        items = Block(docs, part)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            found_by = matcher(items, rate)
            for b in batches:
                rows = []
                for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                    if found := found_by.search(t):
                        words = normal(t)
                        rows += [(d, i, dist, e, words.count(" ", 0, s), words.count(" ", 0, end) + 1) for i, dist, e, s, end in found]
                if rows:
                    kinds = [pa.int64()] * 2 + [pa.int32()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "distance", "allowed", "start_word", "end_word"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block: int = BLOCK_CHARS) -> DataFrame:
    """docs without those that hold an item."""
    for part in blocks(benchmark, block):
        items = Block(docs, part)

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            found_by = matcher(items, rate)
            for b in batches:
                yield b.filter(pa.array([not found_by.search(t, first=True) for t in texts(b)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
