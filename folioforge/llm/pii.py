"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Offsets are code points, end exclusive. The base kinds (email, ip, card, phone) are always reported; iban, short cards
and id numbers only when checksum and context lift their score to MIN_SCORE. Defined cases: a null or empty text has no
spans; repeated rows are scanned one by one; an empty table gives an empty table; other columns are passed through.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioforge.llm.common import free_name, texts

#: Kinds in the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "national_id")
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 48
CONTEXT_STEP = 0.25
MIN_SCORE = 0.6
#: Score before checksum and context.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.7, "short_card": 0.4, "national_id": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "amex", "credit", "diners", "karte", "carte", "tarjeta"),
    "national_id": ("ssn", "social security", "national id", "identity"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits' weighted sum, every second from the right doubled, is a multiple of ten."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of international account numbers: rotated by four, letters as 10..35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each '@' outwards in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        if (m := _DOMAIN.match(text, at + 1)) is not None:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of four numbers joined by points: each longest chain of numbers is read once, four by four."""
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            parts = m[0].split(".")
            at = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    yield at, end
                at = end + 1


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose form and checksum hold."""
    for s, e in emails(text):
        yield "email", s, e
    if _DIGIT.search(text) is None:
        return
    for s, e in addresses(text):
        yield "ip", s, e
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield ("card" if len(d) >= 16 else "short_card"), *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code):
            yield "iban", *m.span()
    for m in _ID.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "national_id", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior, raised by each of at most two context words near the span."""
    near = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}".lower()
    return min(1.0, PRIOR[kind] + CONTEXT_STEP * min(2, sum(w in near for w in CONTEXT[kind])))


def find_pii(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind and start; base spans always, others at MIN_SCORE and clear of base spans."""
    base, more = [], []
    for kind, s, e in propose(text):
        (base if kind in BASE_KINDS else more).append((kind, s, e, score(text, kind, s, e)))
    if more:  # a base span that overlaps is the last one of its kind that starts before the other ends
        by_kind = [sorted((b[1], b[2]) for b in base if b[0] == k) for k in BASE_KINDS]
        clear = lambda s, e: all((i := bisect.bisect_left(spans, (e,))) == 0 or spans[i - 1][1] <= s for spans in by_kind)
        more = [x for x in more if x[3] >= MIN_SCORE and clear(x[1], x[2])]
    return sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    out, done = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: x[1]):
        if s >= done:
            out += [text[done:s], f"<{kind}>"]
            done = e
    return "".join([*out, text[done:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def scan_pii(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """df with a column of spans (kind, start, end, score), under a free name if df has one of that name."""
    spans = free_name(df, spans)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find_pii(t)] for t in texts(b, text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, spans])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(spans, SPANS)]))


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def digest(listing: str) -> str:
    return hashlib.sha256(listing.encode()).hexdigest()
