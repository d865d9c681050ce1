"""Token ids packed into fixed-length rows by best-fit-decreasing, with segment-tree capacity search.

Each document becomes byte-level BPE ids plus an end mark; documents longer than a row are split without loss into whole
rows and a rest. Every task packs its own documents as they stream by, in buffers of about BUFFER tokens: the segments
of a buffer, longest first, each go to the fullest row that still has room. Nothing is shuffled and a task holds one
buffer (or one document, if that is longer); which documents share a row, and row ids, so follow the partitions of df. Rows carry the packed ids (16-bit little-endian, padded with the end mark),
the cumulative segment lengths, and position numbers that start again at 0 with every segment; `write` saves them.

Defined cases: a null text counts as empty and becomes its end mark alone; repeated rows are packed one by one; of rows
with equal room the one opened last is used, and equal lengths keep their order; an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import texts

ROW = 2_048
BUFFER = 1 << 21
MEMO = 400_000
SCHEMA = "row_id long, n_segments int, n_tokens int, doc_ids array<long>, seg_starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


class Capacities:
    """Rows by the room they have left; a segment tree over room finds the least that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.leaves
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room that is at least `need`; the row is taken out."""
        k = need + self.leaves
        while not self.any[k]:
            while k & 1:  # climb to the next subtree on the right
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[k] = 0
            while k > 1:
                k >>= 1
                self.any[k] = self.any[2 * k] or self.any[2 * k + 1]
                if self.any[k]:
                    break
        return room, row


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Positions of the lengths (each at most `row`) in each packed row."""
    free, out = Capacities(row), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = free.take(lengths[i])
        if got is None:
            got = row, len(out)
            out.append([])
        out[got[1]].append(i)
        if left := got[0] - lengths[i]:
            free.put(left, got[1])
    return out


class ByteBpe:
    """Ids of texts; words after single spaces are remembered, as no token crosses such a space from the left."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}
        self.most = memo

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u2").tobytes()

    def _word(self, word: str) -> bytes:
        if len(self.memo) >= self.most:
            self.memo.clear()
        got = self.memo[word] = self.whole(" " + word)
        return got

    def encode(self, text: str) -> bytes:
        """The ids as 16-bit numbers."""
        if not text or "  " in text:
            return self.whole(text)
        words = text.split(" ")
        get, word = self.memo.get, self._word
        return b"".join([self.whole(words[0]), *[get(w) or word(w) for w in words[1:]]])


def segments(doc: object, ids: bytes, row: int) -> list[tuple[object, int, bytes]]:
    """(document, first token, ids) of pieces of at most `row` tokens."""
    return [(doc, a // 2, ids[a : a + 2 * row]) for a in range(0, len(ids), 2 * row)]


def pack(parts: list[tuple[object, int, bytes]], row: int, pad: int, first_id: int) -> pa.RecordBatch:
    """The packed rows of a buffer of segments."""
    lengths = [len(p[2]) // 2 for p in parts]
    cols: dict[str, list] = {n: [] for n in ("row_id", "n_segments", "n_tokens", "doc_ids", "seg_starts", "cu_seqlens", "ids", "position_ids")}
    fill, count = np.array([pad], "<u2").tobytes(), np.arange(row, dtype="<u2")
    for k, members in enumerate(best_fit_decreasing(lengths, row)):
        got = [lengths[i] for i in members]
        n = sum(got)
        cols["row_id"].append(first_id + k)
        cols["n_segments"].append(len(members))
        cols["n_tokens"].append(n)
        cols["doc_ids"].append([parts[i][0] for i in members])
        cols["seg_starts"].append([parts[i][1] for i in members])
        cols["cu_seqlens"].append(np.concatenate(([0], np.cumsum(got))).tolist())
        cols["ids"].append(b"".join([parts[i][2] for i in members]) + fill * (row - n))
        cols["position_ids"].append(b"".join([count[:g].tobytes() for g in got]) + b"\0\0" * (row - n))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)], names=list(cols))


def pack_documents(docs: DataFrame, path: str, pattern: str, row: int = ROW, buffer: int = BUFFER) -> DataFrame:
    """Packed rows of all documents; row_id is the task's number above 32 bits of its own count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, pattern)
        end = np.array([bpe.end], "<u2").tobytes()
        base, done, held, parts = TaskContext.get().partitionId() << 32, 0, 0, []
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids = bpe.encode(t) + end
                parts += segments(d, ids, row)
                held += len(ids) // 2
                if held >= buffer:
                    out = pack(parts, row, bpe.end, base + done)
                    held, parts, done = 0, [], done + out.num_rows
                    yield out
        if parts:
            yield pack(parts, row, bpe.end, base + done)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet, the matrices as binary columns of one length, in any store that Spark can write."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def matrix(rows: list, column: str = "ids", row: int = ROW) -> np.ndarray:
    """The id or position matrix of collected rows."""
    return np.frombuffer(b"".join(bytes(r[column]) for r in rows), "<u2").reshape(-1, row)
