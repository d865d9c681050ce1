"""Texts for a model and back: pieces of long texts, requests, and replies in whatever form they come."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes and the names under which replies carry numbers, texts and nested results.
ITEM_CHARS = 1600
NUMBER_NAMES, TEXT_NAMES = ("i", "index", "id"), ("t", "text", "translation")
NESTED_NAMES = ("translations", "result", "results", "data", "items")
SENTENCE_END = re.compile(r"[.!?;:。！？；：\n]\s*")


def long_pieces(text: str | None, most: int = ITEM_CHARS) -> list[str]:
    """A text in pieces of at most `most` characters, cut at ends of sentences, inside a sentence only if it is longer.

    White space after a sentence stays with it; pieces of nothing else are left out."""
    text = (text or "").strip()
    if len(text) <= most:
        return [text]
    ends = [0, *(m.end() for m in SENTENCE_END.finditer(text)), len(text)]
    sentences = [text[i : min(i + most, b)] for a, b in zip(ends[:-1], ends[1:], strict=True) for i in range(a, b, most)]
    groups: list[list[str]] = []
    room = -1
    for s in sentences:
        if len(s) > room:
            groups.append([])
            room = most
        groups[-1].append(s)
        room -= len(s)
    return [p for p in map("".join, groups) if p.strip()]


def chunks(docs: DataFrame, most: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, chunk, piece) of every text; null and blank texts have one empty piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                pieces = long_pieces(text, most)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], names=["doc_id", "chunk", "piece"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk int, piece string")


def request(items: Column) -> Column:
    """The user message of an array of texts: a JSON array of numbers (from 1) and texts."""
    return F.to_json(F.transform(items, lambda t, k: F.struct((k + 1).alias("i"), t.alias("t"))))


def _pick(entry: dict, names: tuple[str, ...], default: object) -> object:
    return next((entry[n] for n in names if n in entry), default)


def _whole(x: object, default: int | None) -> int | None:
    try:
        return int(x)  # type: ignore[call-overload]
    except (TypeError, ValueError, OverflowError):
        return default


def _from_list(found: list) -> dict[int, str]:
    out = {}
    for k, x in enumerate(found, 1):
        if isinstance(x, str):
            out[k] = x
        elif isinstance(x, dict):
            out[_whole(_pick(x, NUMBER_NAMES, k), k)] = str(_pick(x, TEXT_NAMES, ""))
    return out


def _from_dict(found: dict) -> dict[int, str]:
    keys = [_whole(k, None) for k in found]
    if keys and None not in keys:
        return {k: str((v.get("t") or v.get("text") or "") if isinstance(v, dict) else v) for k, v in zip(keys, found.values(), strict=True)}
    return next((got for n in NESTED_NAMES if n in found and (got := _structured(found[n]))), {})


def _structured(found: object) -> dict[int, str]:
    return _from_list(found) if isinstance(found, list) else _from_dict(found) if isinstance(found, dict) else {}


def _as_json(body: str) -> dict[int, str]:
    """Numbers and texts of the reply, of its outermost array or of its outermost object, also with commas too many."""
    spans = (m.group() for p in (r".*", r"\[.*\]", r"\{.*\}") if (m := re.search(p, body, re.S)))
    for span in spans:
        for mended in (False, True):  # a reply that parses is not searched any further
            try:
                parsed = json.loads(re.sub(r",(?=\s*[}\]])", "", span) if mended else span)
            except (ValueError, RecursionError):
                continue
            if got := _structured(parsed):
                return got
            break
    return {}


STRING = r'"((?:[^"\\]|\\.)*)"'


def _as_pairs(body: str) -> dict[int, str]:
    """Number and text fields beside each other, in either order, out of JSON that does not parse."""

    def plain(s: str) -> str:
        try:
            return json.loads(f'"{s}"', strict=False)
        except ValueError:
            return s

    if got := {int(a): plain(b) for a, b in re.findall(rf'"i"\s*:\s*(\d{{1,18}})\s*,\s*"t"\s*:\s*{STRING}', body, re.S)}:
        return got
    return {int(b): plain(a) for a, b in re.findall(rf'"t"\s*:\s*{STRING}\s*,\s*"i"\s*:\s*(\d{{1,18}})', body, re.S)}


def _as_lines(body: str) -> dict[int, str]:
    """Numbered lines."""
    found = (re.match(r"\s*\[?(\d{1,18})\]?\s*[.、:：)）]\s*(.+)", x) for x in body.splitlines())
    return {int(m[1]): m[2] for m in found if m}


READERS: tuple[Callable[[str], dict[int, str]], ...] = (_as_json, _as_pairs, _as_lines)


def read_reply(reply: str | None) -> dict[int, str]:
    """Number -> text of a reply: the first reader that finds any holds; blank texts are left out."""
    fence = "```" in (reply or "") and re.search(r"```(?:json)?(.*?)```", reply, re.S | re.I)
    body = (fence[1] if fence else reply or "").strip()
    got = next((x for r in READERS if (x := r(body))), {}) if body else {}
    return {k: v.strip().encode("utf-8", "replace").decode() for k, v in got.items() if v.strip()}


def read_replies(rows: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, i, t): numbers and texts of each reply; a reply with none has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("key", pa.int64()), ("i", pa.int64()), ("t", pa.string())])
        for b in batches:
            for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = {i: t for i, t in read_reply(r).items() if abs(i) < 2**63}
                yield pa.RecordBatch.from_pydict({"key": [k] * len(got), "i": list(got), "t": list(got.values())}, kinds)

    return rows.select(F.col(key).cast("long"), F.col(reply).cast("string")).mapInArrow(run, "key long, i long, t string").withColumnRenamed("key", key)
