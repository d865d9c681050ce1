"""BPE encoding and decoding that equals the tokenizers library on every text.

Every text of more than LEAF code points is encoded by tree concatenation. It is halved down to leaves, at any place where
normalization cannot join the characters of both sides, inside words as well, and the leaves of a batch of texts are
encoded together. Then neighbours are joined bottom-up, all joins of a level together: the text of a few units on both
sides of a join is encoded anew, and the window grows until its first and last unit are those that were there before. As a
row of units is the encoding of its text if each two neighbours are that of theirs, the joined rows are exact.

The units are pre-tokens where one regular expression cuts them (texts of ASCII and Latin-1 letters, if the file's
normalizer and pre-tokenizer are the ones it stands for) and else runs without space or line feed, which the library
normalizes and cuts further; distinct ones are encoded once per worker (memos of bounded size, of short units only). A text
with a run of more than LEAF code points has the tokens themselves as units: its leaves and windows are encoded by the
library, over its threads. Texts that hold a special token are cut at spaces alone.

Requirements on the tokenizer: pre-tokens hold no space or line feed, and the decoder, where there is one, is None
(tokens joined by one space). Defined cases: a null text counts as empty and has no tokens; repeated rows are encoded
one by one; an empty table gives an empty table; other columns are passed through.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioforge.llm.common import free_name, texts

#: Code points of a leaf; units on each side of a join at first.
LEAF = 4_096
WINDOW = 4
#: Pieces remembered by a worker, and their code points at most.
MEMO = 300_000
REMEMBERED = 64
#: Rows of a batch whose texts are strings at once.
ROWS = 500
#: Code points of chunks that one call of the library gets at most.
BATCH = 1 << 20

#: The normalizer and pre-tokenizer of the word BPE files, for which the fast way holds.
WORD_NORMALIZER = ["NFC", ["Replace", "\\s+", " "], "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern over the characters of the fast way, which are their own NFC and lower-case to one character.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-zß-öø-ÿ0-9]+")
_OTHER = re.compile(r"[^ \n!-~À-ÖØ-öø-ÿ]")
_CHUNKS = re.compile(r"[^ \n]+")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the code points from 256."""
    table, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[b] = chr(b)
        else:
            table[b] = chr(extra)
            extra += 1
    return table


def apart(text: str, at: int) -> bool:
    """Whether normalization treats both sides of a place alone."""
    a, b = text[at - 1], text[at]
    if a.isascii() and b.isascii():
        return True
    return not unicodedata.combining(b) and unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b)


class Part:
    """Tokens of text[start:end]: ids, tokens and the code points that each comes from."""

    def __init__(self, start: int, end: int, e):
        self.start, self.end = start, end
        self.ids, self.tokens = e.ids, e.tokens
        self.offsets = [(start + a, start + b) for a, b in e.offsets]


class Encoder:
    """One tokenizer file, with the memo of a worker."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.window = leaf, window
        if self.tok.decoder is not None:
            raise ValueError("only tokenizers without a decoder are supported")
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.chunks: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.names = {str(i): self.tok.id_to_token(i) for i in self.tok.get_vocab(with_added_tokens=True).values()}
        self.fast = self._is_word_bpe()
        self.bytes = byte_alphabet()

    def _is_word_bpe(self) -> bool:
        spec = json.loads(self.tok.to_str())
        norm = [n["type"] if n["type"] != "Replace" else ["Replace", n["pattern"].get("Regex"), n["content"]] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        special = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        return norm == WORD_NORMALIZER and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"] == {"Regex": WORD_PATTERN} and pre[0]["invert"] and not pre[1]["add_prefix_space"] and special

    # Tree concatenation

    def _all(self, spans: list[tuple[int, int]], text: str) -> list[Part]:
        """Parts of the text encoded together, over the library's threads."""
        return [Part(a, b, e) for (a, b), e in zip(spans, self.tok.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False), strict=True)]

    def _cuts(self, text: str) -> list[int]:
        """Places that halve the text down to leaves."""
        out, todo = {0, len(text)}, [(0, len(text))]
        while todo:
            a, b = todo.pop()
            if b - a <= self.leaf:
                continue
            at = next((k for k in range((a + b) // 2, b) if apart(text, k)), None) or next((k for k in range((a + b) // 2, a, -1) if apart(text, k)), None)
            if at is not None:
                out.add(at)
                todo += [(a, at), (at, b)]
        return sorted(out)

    @staticmethod
    def _edge(text: str, part: Part, n: int, left: bool) -> int:
        """Tokens of a window's side, `n` or more: up to a place where a token and a character begin anew."""
        offsets, size = part.offsets, len(part.ids)
        while n < size:
            before, after = (offsets[size - n - 1], offsets[size - n]) if left else (offsets[n - 1], offsets[n])
            at = after[0] if left else before[1]
            if before[1] <= after[0] and apart(text, at):
                return n
            n += 1
        return size

    def _joined(self, text: str, pairs: list[tuple[Part, Part]]) -> list[Part]:
        """Each two neighbours as one part."""
        out: list[Part | None] = [None] * len(pairs)
        todo = [(k, self.window, self.window) for k in range(len(pairs))]
        while todo:
            spans, sides = [], []
            for k, a, b in todo:
                left, right = pairs[k]
                a, b = self._edge(text, left, a, True), self._edge(text, right, b, False)
                sides.append((k, a, b))
                spans.append((left.offsets[-a][0] if a < len(left.ids) else left.start, right.offsets[b - 1][1] if b < len(right.ids) else right.end))
            todo = []
            for (k, a, b), got in zip(sides, self._all(spans, text), strict=True):
                left, right = pairs[k]
                whole_left, whole_right = a == len(left.ids), b == len(right.ids)
                same = lambda i, part, j: bool(got.ids) and got.ids[i] == part.ids[j] and got.offsets[i] == part.offsets[j]  # noqa: B023, E731
                ok_left, ok_right = whole_left or same(0, left, -a), whole_right or same(-1, right, b - 1)
                if ok_left and ok_right:
                    keep = len(left.ids) - a
                    got.start, got.end = left.start, right.end
                    got.ids, got.tokens = left.ids[:keep] + got.ids + right.ids[b:], left.tokens[:keep] + got.tokens + right.tokens[b:]
                    got.offsets = left.offsets[:keep] + got.offsets + right.offsets[b:]
                    out[k] = got
                else:
                    todo.append((k, a if ok_left else 2 * a, b if ok_right else 2 * b))
        return out

    def tree(self, text: str) -> tuple[list[int], list[str]]:
        """Ids and tokens of a text of any length."""
        cuts = self._cuts(text)
        level = self._all(list(zip(cuts[:-1], cuts[1:], strict=True)), text)
        while len(level) > 1:
            pairs = self._joined(text, list(zip(level[0::2], level[1::2], strict=False)))
            level = pairs + level[2 * len(pairs) :]
        return (level[0].ids, level[0].tokens) if level else ([], [])

    # Units of texts

    def _halved(self, batch: list[str], cut: Callable[[str], list[str]], learn: Callable[[Iterable[str]], None]) -> list[list[str]]:
        """The units of each text, by tree concatenation; learn() is given the units of leaves and windows, a level at a time."""
        rows = []
        for t in batch:
            cuts = self._cuts(t)
            rows.append([(a, b, cut(t[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        learn(u for parts in rows for _, _, units in parts for u in units)
        while any(len(parts) > 1 for parts in rows):
            joins = [(k, i) for k, parts in enumerate(rows) for i in range(0, len(parts) - 1, 2)]
            done: dict[tuple[int, int], list[str]] = {}
            todo = [(k, i, self.window, self.window) for k, i in joins]
            while todo:
                wider, made = [], []
                for k, i, n, m in todo:
                    (start, mid, left), (_, end, right) = rows[k][i], rows[k][i + 1]
                    n, m = min(n, len(left)), min(m, len(right))
                    whole_left, whole_right = n == len(left), m == len(right)
                    a = start if whole_left else _back(batch[k], mid, left, n)
                    b = end if whole_right else _forth(batch[k], mid, right, m)
                    got = cut(batch[k][a:b])
                    made += got
                    ok_left = whole_left or (bool(got) and got[0] == left[-n])
                    ok_right = whole_right or (bool(got) and got[-1] == right[m - 1])
                    if ok_left and ok_right:
                        done[k, i] = left[: len(left) - n] + got + right[m:]
                    else:
                        wider.append((k, i, n if ok_left else 2 * n, m if ok_right else 2 * m))
                learn(made)
                todo = wider
            rows = [[(parts[i][0], parts[i + 1][1], done[k, i]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)] for k, parts in enumerate(rows)]
        return [parts[0][2] if parts else [] for parts in rows]

    # Whole texts

    @staticmethod
    def _entry(ids: list[int], tokens: list[str]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join(tokens)

    def _told(self, ids: str) -> tuple[int, str, str]:
        """The entry of ids that are joined by spaces."""
        each = ids.split(" ") if ids else []
        return len(each), ids, " ".join([self.names[i] for i in each])

    def _piece(self, piece: str) -> str:
        """The ids of a pre-token of the fast way."""
        found = self.tok.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes))
        return " ".join([str(t.id) for t in found])

    def _known(self, batch: list[str], memo: dict[str, str], most: int, cut: Callable[[str], list[str]], encode: Callable[[list[str]], list[str]]) -> list[tuple[int, str, str]]:
        """The entries of texts from the ids of their units, which are all that is remembered; new units of a level are encoded
        in one call."""
        if len(memo) > most:
            memo.clear()
        here: dict[str, str] = {}

        def learn(units: Iterable[str]) -> None:
            new = list({u for u in units if u not in memo and u not in here})
            for u, x in zip(new, encode(new), strict=True):
                (memo if len(u) <= REMEMBERED else here)[u] = x

        get = memo.get
        return [self._told(" ".join([x for u in units if (x := here[u] if (y := get(u)) is None else y)])) for units in self._halved(batch, cut, learn)]

    def _way(self, text: str) -> str:
        if len(text) > self.leaf and max(map(len, text.replace("\n", " ").split(" "))) > self.leaf and not any(s in text for s in self.special):
            return "tree"
        return "fast" if self.fast and "<|" not in text and not _OTHER.search(text) else "slow"

    def _group(self, batch: list[str]) -> list[tuple[int, str, str]]:
        ways = [self._way(t) for t in batch]
        of = {w: iter(self._by(w, [t for t, x in zip(batch, ways, strict=True) if x == w])) for w in set(ways)}
        return [next(of[w]) for w in ways]

    def _by(self, way: str, batch: list[str]) -> list[tuple[int, str, str]]:
        if way == "tree":
            return [self._entry(*self.tree(t)) for t in batch]
        if way == "fast":
            return self._known([t.lower() for t in batch], self.pieces, MEMO, _PIECES.findall, lambda units: [self._piece(u) for u in units])
        slow = lambda units: [" ".join(map(str, e.ids)) for e in self.tok.encode_batch(units, add_special_tokens=False)]
        return self._known(batch, self.chunks, MEMO // 4, _CHUNKS.findall, slow)

    def encode(self, batch: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of tokens, the ids joined by spaces, the decoded text."""
        wait: list[str] = []
        chars = 0
        for t in batch:
            wait.append(t)
            chars += len(t)
            if chars >= BATCH:
                yield from self._group(wait)
                wait, chars = [], 0
        if wait:
            yield from self._group(wait)


def _back(text: str, at: int, units: list[str], n: int) -> int:
    """Where the last n units before a place begin; only spaces and line feeds stand between units."""
    for u in reversed(units[len(units) - n :]):
        while text[at - 1] in " \n":
            at -= 1
        at -= len(u)
    return at


def _forth(text: str, at: int, units: list[str], n: int) -> int:
    """Where the first n units after a place end."""
    for u in units[:n]:
        while text[at] in " \n":
            at += 1
        at += len(u)
    return at


_encoders: dict[str, Encoder] = {}
_lock = threading.Lock()


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file."""
    with _lock:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]


def _read(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a batch, a few rows at a time."""
    for k in range(0, batch.num_rows, ROWS):
        yield from texts(batch.slice(k, ROWS), column)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def encode_digest(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df without its text, with the number of tokens and the hashes of ids and decoded text, under free names where df has them."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(free_name(df, f.name), f.dataType) for f in DIGEST.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows = [(n, _sha(ids), _sha(back)) for n, ids, back in e.encode(_read(b, text))]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_ids(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the token ids (array of int) and the decoded text of every row, under free names where df has them."""
    ids, decoded = free_name(df, ids), free_name(df, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows = list(e.encode(_read(b, text)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[int(x) for x in r[1].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
