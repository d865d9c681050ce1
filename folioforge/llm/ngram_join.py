"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (lower case, split at white space; fewer than five words make one
shingle). Pairs of sets with Jaccard similarity of THRESHOLD or more are linked.

(1) Equal sets collapse into one representative. (2) Chosen paths: in each of several runs a set starts at the root and
follows each of its shingles that a hash samples with probability 1 / (THRESHOLD * size), so that similar sets meet at
the same node. Nodes of at most BUCKET sets are leaves; larger nodes are split again by shingles sampled anew for that
node, MAX_DEPTH times at most. RUNS repeats the runs until the chance to miss a pair at the threshold is below
1 - RECALL. Before a node is split all its sets are compared with one of them, its leader, by sketch: sets that
are very like the leader do not go on, and a node goes on only if more than UNLIKE * BUCKET sets are unlike its leader
(see `compared`); else these are compared with all others, so a group of near copies costs its size. (3) Leaves with the same members are kept once and searched by brute force on small
one-permutation sketches; only a spanning forest of the matches is passed on. A leaf that stays large is searched block against block.
(4) The connected parts of that candidate graph are small sets of documents that hold every link; there whole shingle
sets are compared exactly, again in blocks where a part is large. So links of one part found in no leaf are found here.

No step emits all pairs of a group: leaves and blocks emit forests and counts. Nothing but row counts reaches the driver.
A row is named by a 64-bit hash of its id and text, so that texts can be read again, wherever a lost task runs anew; hashes
that different rows share are looked for, and those rows are named by another hash.

Defined cases: null and empty texts have no shingles and no links, each is a class of its own; null ids and repeated
rows are rows as any other (copies of each other); an empty table gives an empty table; ties between equally small
class ids cannot occur, and of repeated rows with one id and text any one is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batches_of, free_name, materialise, release, small, texts

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Sets in a leaf; splits of a node; sets in a block of an exact comparison, and of one of sketches.
BUCKET = 64
MAX_DEPTH = 4
BLOCK = 256
SKETCH_BLOCK = 2_048
#: Values of sets that are compared at once, and rows with sets that a worker gets at once.
AT_ONCE = 500_000
SETS = 256
#: Bins of a sketch of one byte each, and the least estimate that is compared exactly (five standard errors below).
BINS = 128
SLACK = 0.18
#: How much lower the estimate may be at which sets of a large node are joined to its leader.
LEEWAY = 0.12
#: Sets of a large node that may be unlike its leader, in leaves, for it not to be split.
UNLIKE = 8
#: Names that two rows may share.
CLASHES = 10_000
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = [np.uint64(x) for x in (30, 27, 31)]


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold is missed with chance 1 - recall, if its leaves lie at this depth.

    A pair at the threshold shares one sampled shingle a node on average (a critical branching process), so it lives on
    to the next depth with chance 1 - exp(-chance)."""
    live = 1.0
    for _ in range(depth):
        live = 1 - math.exp(-live)
    return math.ceil(math.log(1 - recall) / math.log(1 - live))


RUNS = runs_for(RECALL, MAX_DEPTH)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _SHIFT[0])) * _M1
    x = (x ^ (x >> _SHIFT[1])) * _M2
    return x ^ (x >> _SHIFT[2])


class Shingler:
    """Shingle hashes of texts; remembers the hashes of words."""

    def __init__(self, words: int = WORDS, memo: int = 500_000):
        self.words, self.most, self.memo = words, memo, {}

    def _word(self, w: str) -> int:
        if len(self.memo) >= self.most:
            self.memo.clear()
        h = self.memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h

    def sequence(self, text: str) -> np.ndarray:
        """The hash of each run of `words` words, in order."""
        get, word = self.memo.get, self._word
        h = np.array([get(w) or word(w) for w in text.lower().split()], np.uint64)
        if not len(h):
            return h
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * _STEP + h[i : len(h) - k + 1 + i]
        return mix(out)

    def set(self, text: str) -> np.ndarray:
        return np.unique(self.sequence(text))


def children(shingles: np.ndarray, nodes: np.ndarray, threshold: float) -> np.ndarray:
    """Nodes below `nodes` that a set goes to: its shingles that each node's hash samples, hashed with the node."""
    h = mix(shingles[None, :] ^ nodes[:, None])
    bound = min(2**64 - 1, int(2.0**64 / (threshold * len(shingles))))
    return mix(h[h <= np.uint64(bound)] + _STEP)


def sketch(shingles: np.ndarray) -> bytes:
    """One byte a bin: low bits of the least hash among those that fall into the bin, 0 if none does."""
    h = np.sort(mix(shingles + _M1))
    bins = (h >> np.uint64(57)).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = (mix(h[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def row_name(clashes: list[int] = ()) -> Column:
    """The name of a row: a hash of id and text; for the hashes that different rows share, another one."""
    name, other = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")
    return F.when(name.isin(*clashes), other).otherwise(name) if clashes else name


def name_clashes(rows: DataFrame) -> list[int]:
    """Names that different rows share (about one in 2 ** 65 pairs of rows; more than CLASHES are refused)."""
    found = rows.groupBy("_uid").agg(F.min("_other").alias("lo"), F.max("_other").alias("hi")).where("lo < hi").select("_uid").limit(CLASHES + 1).collect()
    if len(found) > CLASHES:
        raise ValueError("too many rows share a name")
    return [r[0] for r in found]


# Step 1


def digest(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """(_uid, doc_id, rep, n, sketch, nodes): what later steps need of each row; rep names the set."""
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * _STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler()
        for b in batches:
            rep, n, sk, nodes = [], [], [], []
            for t in texts(b):
                x = s.set(t)
                n.append(len(x))
                rep.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                sk.append(sketch(x) if len(x) else None)
                nodes.append(children(x, roots, threshold).view(np.int64) if len(x) else [])
            yield pa.RecordBatch.from_arrays([b.column("_uid"), b.column("_other"), b.column("doc_id"), pa.array(rep, pa.binary()), pa.array(n, pa.int64()), pa.array(sk, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["_uid", "_other", "doc_id", "rep", "n", "sketch", "nodes"])

    rows = docs.select(row_name().alias("_uid"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_other"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "_uid long, _other long, doc_id long, rep binary, n long, sketch binary, nodes array<long>")


def with_sets(docs: DataFrame, name: Column, wanted: DataFrame, rows: int, fn, schema: str) -> DataFrame:
    """fn(columns of wanted, shingle set) -> rows, over the texts of the wanted _uids; texts are read again, not stored.

    A row that is there more than once comes more than once."""
    texts_ = docs.select(name.alias("_uid"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler()
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            yield from fn(cols, [s.set(t) for t in texts(b)])

    return texts_.join(small(wanted, rows), "_uid").mapInArrow(run, schema)


# Step 2


def compared(rows: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """rows (_uid, node, lo) with `rank`: 0 for sets that are unlike lo, the leader, 1 for those joined to it, 2 for those so
    like it that no set that is unlike it matches them.

    A set is joined to the leader from an estimate of least - LEEWAY on. Sketches of a share d of differing bins from the leader's,
    d / (1 - d) <= LEEWAY / (2 - least), differ from those of a set that is unlike the leader in more than a share of
    1 - least, by the triangle inequality of differing bins, so a leaf would not match them: only those of rank 1 have to meet it."""
    far = LEEWAY / (2 - least)
    near = 1 - far / (1 + far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
            same, any_ = ((a == b) & (a > 0)).sum(1), ((a > 0) | (b > 0)).sum(1)
            rank = (same >= (least - LEEWAY) * any_).astype(np.int32) + (same >= near * any_)
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("_uid", "node", "lo")), pa.array(rank.astype(np.int32))], names=["_uid", "node", "lo", "rank"])

    heads = materialise(rows.select("lo").distinct().join(sketches.select(F.col("_uid").alias("lo"), F.col("sketch").alias("sb")), "lo"), "heads")
    both = rows.join(sketches.select("_uid", F.col("sketch").alias("sa")), "_uid").join(small(heads, 8 * heads.count()), "lo")
    return both.select("_uid", "node", "lo", "sa", "sb").mapInArrow(run, "_uid long, node long, lo long, rank int")


def leaves(docs: DataFrame, name: Column, reps: DataFrame, threshold: float, bucket: int, depth: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members) of small leaves, each set of members once; (node, _uid) of nodes that stay large; (a, b) of sets joined to leaders;
    (node, m, side, _uid) of nodes with few sets that are unlike the leader: those, side 1, have to be compared with side 0, m sets."""
    entries = reps.select(F.col("_uid"), F.explode("nodes").alias("node"))
    done: list[DataFrame] = []
    joined: list[DataFrame] = []
    apart: list[DataFrame] = []
    for level in range(1, depth + 1):
        sizes = entries.groupBy("node").agg(F.count("*").alias("m"), F.min_by("_uid", F.xxhash64("_uid", "node")).alias("lo"))
        shared = materialise(entries.join(sizes.where("m > 1"), "node"), f"node{level}")
        done.append(shared.where(F.col("m") <= bucket).groupBy("node").agg(F.sort_array(F.collect_list("_uid")).alias("members")).select("members"))
        near = materialise(compared(shared.where(F.col("m") > bucket).select("_uid", "node", "lo"), reps.select("_uid", "sketch"), least), f"led{level}")
        joined.append(near.where("rank > 0 and _uid != lo").select(F.col("lo").alias("a"), F.col("_uid").alias("b")).distinct())
        kinds = near.groupBy("node").agg(F.sum((F.col("rank") == 0).cast("long")).alias("unlike"), F.sum((F.col("rank") == 1).cast("long")).alias("m"))
        left = near.where("rank < 2").join(kinds.where("unlike > 0"), "node")
        few = left.where(F.col("unlike") <= UNLIKE * bucket)
        done.append(few.where("rank = 0 and unlike > 1").groupBy("node").agg(F.sort_array(F.collect_list("_uid")).alias("members")).select("members"))
        apart.append(few.where("m > 0").select("node", "m", (1 - F.col("rank")).alias("side"), "_uid"))
        big = left.where(F.col("unlike") > UNLIKE * bucket).select("_uid", "node")
        if level == depth:
            break
        wanted = materialise(big.groupBy("_uid").agg(F.collect_set("node").alias("at")), f"large{level}")
        n = wanted.count()
        if not n:
            break

        def split(cols: dict, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            uid, node = [], []
            for u, at, x in zip(cols["_uid"], cols["at"], sets, strict=True):
                below = children(x, np.array(at, np.int64).view(np.uint64), threshold).view(np.int64)
                uid += [u] * len(below)
                node += below.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(node, pa.int64())], names=["_uid", "node"])

        entries = with_sets(docs, name, wanted, n, split, "_uid long, node long").distinct()
    members, edges, sides_ = (reduce(DataFrame.unionByName, x) for x in (done, joined, apart))
    return members.distinct(), big, edges, sides_


# Step 3


def spanning(hit: np.ndarray, one: bool) -> tuple[list[int], list[int]]:
    """Edges (row, column) of a spanning forest of the matches; with `one` rows and columns are the same things."""
    fresh = [np.ones(hit.shape[0], bool), np.ones(hit.shape[1], bool)]
    if one:
        fresh[1] = fresh[0]
    sides_, out = (hit, hit.T), ([], [])
    for start in np.flatnonzero(hit.any(1)).tolist():
        if not fresh[0][start]:
            continue
        fresh[0][start] = False
        stack = [(0, start)]
        while stack:
            side, v = stack.pop()
            new = np.flatnonzero(sides_[side][v] & fresh[1 - side])
            fresh[1 - side][new] = False
            out[side].extend([v] * len(new))
            out[1 - side].extend(new.tolist())
            stack.extend((0 if one else 1 - side, x) for x in new.tolist())
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which sketches of a and b estimate a similarity of `least` or more."""
    out = np.zeros((len(a), len(b)), bool)
    for i, x in enumerate(a):
        same = ((b == x) & (x > 0)).sum(1)
        any_ = ((b > 0) | (x > 0)).sum(1)
        out[i] = same >= least * any_
    return out


def by_group(rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """fn of the rows of each value of the keys (longs); groups are bounded by the caller, a task holds one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            b = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
            k = b[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()] if len(b) else [0]
            out = [x for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if (x := fn(b.iloc[lo:hi])) is not None]
            rest = b.iloc[cuts[-1] :]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest) and (x := fn(rest)) is not None:
            yield x

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions to compare with each other: those of both blocks, or twice those of the one block."""
    one = np.arange(len(group))
    if not group["two"].iloc[0]:
        return (one, one) if len(one) > 1 else None
    side = group["side"].to_numpy()
    a, b = one[side == 0], one[side == 1]
    return (a, b) if len(a) and len(b) else None


def _edges(least: float):
    """Matches within a leaf, or between the two blocks of a pair, as a spanning forest."""

    def run(group: pd.DataFrame) -> pd.DataFrame | None:
        group = group.drop_duplicates(["_uid", "side"])
        if (ab := sides(group)) is None:
            return None
        a, b = ab
        sk = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(-1, BINS)
        uid = group["_uid"].to_numpy()
        x, y = spanning(similar(sk[a], sk[b], least), not group["two"].iloc[0])
        return pd.DataFrame({"a": uid[a[x]], "b": uid[b[y]]}) if x else None

    return run


def blocks(rows: DataFrame, key: str, m: str, block: int) -> DataFrame:
    """rows (key, m, ...) dealt to pairs of blocks: (key, i, j) is one pair, `side` tells its blocks, `two` if they differ."""
    n = F.ceil(F.col(m) / block).cast("int")
    mine = F.pmod(F.xxhash64("_uid"), F.col("_n")).cast("int")
    out = rows.withColumn("_n", n).withColumn("_k", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumns({"key": F.col(key), "i": F.least("_k", "_o").cast("long"), "j": F.greatest("_k", "_o").cast("long"), "side": (F.col("_k") > F.col("_o")).cast("int"), "two": F.col("_k") != F.col("_o")}).drop("_n", "_k", "_o")


def apart_blocks(apart: DataFrame, block: int) -> DataFrame:
    """Rows (key, i, j, side, two, _uid): side 0 of each node in blocks, the few sets of side 1 with each of them; j tells them from blocks()."""
    n = F.ceil(F.col("m") / block).cast("int")
    at = F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("_uid"), n).cast("int"))).otherwise(F.sequence(F.lit(0), n - 1))
    return apart.select(F.col("node").alias("key"), F.explode(at.cast("array<long>")).alias("i"), F.lit(-1).cast("long").alias("j"), "side", F.lit(True).alias("two"), "_uid")


def candidates(members: DataFrame, large: DataFrame, joined: DataFrame, apart: DataFrame, sketches: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b): a spanning forest of the matches of each leaf, and sets joined to leaders."""
    both = members.where("size(members) = 2").select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"))
    both = both.join(sketches.select(F.col("_uid").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("_uid").alias("b"), F.col("sketch").alias("sb")), "b")
    more = members.where("size(members) > 2").select(F.xxhash64("members").alias("key"), F.size("members").alias("m"), F.explode("members").alias("_uid"))
    sizes = large.groupBy("node").agg(F.count("*").alias("m"))
    wide = large.join(sizes, "node").select(F.col("node").alias("key"), "m", "_uid")
    dealt = blocks(more.unionByName(wide), "key", "m", block).select("key", "i", "j", "side", "two", "_uid").unionByName(apart_blocks(apart, block)).join(sketches, "_uid")
    found = by_group(dealt.select("key", "i", "j", "side", "two", "_uid", "sketch"), ["key", "i", "j"], _edges(least), "a long, b long")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
            ok = ((a == b) & (a > 0)).sum(1) >= least * ((a > 0) | (b > 0)).sum(1)
            yield x.select(["a", "b"]).filter(pa.array(ok))

    pairs = both.mapInArrow(match, "a long, b long")
    return pairs.unionByName(found).unionByName(joined).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(_uid, comp): the least node that each node of the edges is connected to, by alternating large and small stars."""
    edges = materialise(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("_uid"), F.col("b").alias("comp"))
    now, before = edges, None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("lo").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("lo"))
        down = star.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("lo").alias("b")), F.struct(F.col("b").alias("a"), F.col("lo").alias("b")))).alias("x")).select("x.a", "x.b").where("a != b").distinct()
        last, now = now, materialise(down, "star")
        release(last)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first())
        if seen[0] == seen[2] and seen == before:
            return now.select(F.col("a").alias("_uid"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("_uid"), F.col("b").alias("comp"))).distinct()
        before = seen


# Step 4


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sorted sets of a with those of b (of a if None), a range of values at a time."""
    sets = a if b is None else a + b
    parts = -(-sum(map(len, sets)) // AT_ONCE) or 1
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.int64)
    for k in range(parts):
        lo, hi = (2**64 * k // parts, 2**64 * (k + 1) // parts - 1)
        some = [x[np.searchsorted(x, np.uint64(lo)) : np.searchsorted(x, np.uint64(hi), "right")] for x in sets] if parts > 1 else sets
        out += _overlaps(some, len(a), b is None, columns)
    return out


def _overlaps(sets: list[np.ndarray], n: int, one: bool, columns: int) -> np.ndarray:
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[at] > 1
    owner, at = owner[keep], np.unique(at[keep], return_inverse=True)[1]
    out = np.zeros((n, n if one else len(sets) - n), np.float64)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    cuts = np.searchsorted(at, np.arange(0, (at[-1] + 1 if len(at) else 0) + columns, columns))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            m = np.zeros((len(sets), columns), np.float32)
            m[owner[lo:hi], at[lo:hi] % columns] = 1
            out += m[:n] @ (m if one else m[n:]).T
    return out.astype(np.int64)


def _exact(threshold: Fraction):
    """Links of the documents of one part, or between two blocks of it: counts for each, and a spanning forest."""
    p, q = threshold.numerator, threshold.denominator

    def run(group: pd.DataFrame) -> pd.DataFrame | None:
        group = group.drop_duplicates(["_uid", "side"])
        if (ab := sides(group)) is None:
            return None
        a, b = ab
        two = bool(group["two"].iloc[0])
        uid, mult = group["_uid"].to_numpy(), group["mult"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        size = np.array([len(x) for x in sets])
        both = overlaps([sets[i] for i in a], [sets[i] for i in b] if two else None)
        hit = both * (p + q) >= p * (size[a][:, None] + size[b][None, :])
        if not two:
            np.fill_diagonal(hit, False)
        n_texts, n_rows = np.zeros(len(uid), np.int64), np.zeros(len(uid), np.int64)
        n_texts[a], n_rows[a] = hit.sum(1), hit @ mult[b]
        if two:
            n_texts[b], n_rows[b] = hit.sum(0), mult[a] @ hit
        x, y = spanning(hit, not two)
        some = np.flatnonzero(n_texts)
        if not len(some):
            return None
        none = np.zeros(len(x), np.int64)
        return pd.DataFrame({"a": np.concatenate([uid[some], uid[a[x]]]), "b": np.concatenate([np.full(len(some), -1), uid[b[y]]]), "is_link": np.concatenate([none[:0], np.zeros(len(some), np.int64), none + 1]), "texts": np.concatenate([n_texts[some], none]), "rows": np.concatenate([n_rows[some], none])})

    return run


def links(docs: DataFrame, name: Column, reps: DataFrame, comps: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (a, -1, 0, texts, rows) with counts of links, and (a, b, 1, 0, 0) of a spanning forest of the links."""
    sizes = comps.groupBy("comp").agg(F.count("*").alias("m"))
    wanted = materialise(comps.join(sizes, "comp").join(reps.select("_uid", "mult"), "_uid"), "parts")

    def emit(cols: dict, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(cols["_uid"], pa.int64()), pa.array(cols["comp"], pa.int64()), pa.array(cols["m"], pa.int64()), pa.array(cols["mult"], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["_uid", "comp", "m", "mult", "shingles"])

    sets = with_sets(docs, name, wanted, wanted.count(), emit, "_uid long, comp long, m long, mult long, shingles binary")
    dealt = blocks(sets, "comp", "m", block)
    dealt = dealt.select("key", "i", "j", "side", "two", "_uid", "mult", "shingles")
    return by_group(dealt, ["key", "i", "j"], _exact(Fraction(threshold).limit_denominator(1000)), "a long, b long, is_link long, texts long, rows long")


# The operator


def join_classes(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, bucket: int = BUCKET, depth: int = MAX_DEPTH, block: int = BLOCK) -> DataFrame:
    """(_uid, doc_id, rep, class, n_links, n_texts): class is the least _uid of the rows connected by links.

    n_links counts other rows at the threshold, copies included; n_texts the other distinct sets."""
    rows = materialise(digest(docs, threshold, runs), "digest")
    if clashes := name_clashes(rows):
        rows = rows.withColumn("_uid", F.when(F.col("_uid").isin(*clashes), F.col("_other")).otherwise(F.col("_uid")))
    name = row_name(clashes)
    full = rows.where("rep is not null")
    reps = materialise(full.groupBy("rep").agg(F.count("*").alias("mult"), F.min(F.struct("_uid", "sketch", "nodes")).alias("x")).select("rep", "mult", "x._uid", "x.sketch", "x.nodes"), "reps")
    least = threshold - SLACK
    members, large, joined, apart = leaves(docs, name, reps, threshold, bucket, depth, least)
    edges = candidates(members, large, joined, apart, reps.select("_uid", "sketch"), least, block if block < BLOCK else SKETCH_BLOCK)
    parts = components(edges)
    with batches_of(docs.sparkSession, SETS):
        found = materialise(links(docs, name, reps, parts, threshold, block), "links")
    counts = found.where("is_link = 0").groupBy("a").agg(F.sum("texts").alias("n_texts"), F.sum("rows").alias("n_rows"))
    classes = components(found.where("is_link = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = reps.select("rep", "mult", F.col("_uid").alias("first"))
    known = known.join(classes.select(F.col("_uid").alias("first"), "comp"), "first", "left").join(counts.withColumnRenamed("a", "first"), "first", "left")
    known = known.select("rep", F.coalesce("comp", "first").alias("class"), (F.coalesce("n_rows", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    out = rows.select("_uid", "doc_id", "rep").join(known, "rep", "left")
    out = out.select("_uid", "doc_id", "rep", F.coalesce("class", "_uid").alias("class"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_texts")))
    out = materialise(out, "classes")
    release(rows, reps, found)
    out.clashes = clashes
    return out


def class_ids(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (least id of its class, null if all are null), n_links and n_texts of every row."""
    rows = join_classes(docs, **options)
    ids = rows.where("n_links > 0").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    out = rows.join(ids, "class", "left")
    return out.select("doc_id", F.when(F.col("n_links") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_links", "n_texts")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, that of the least (doc_id, name); all other rows as they were."""
    classes = join_classes(docs, **options)
    rows = classes.where("n_links > 0")
    first = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_uid")).alias("x")).select(F.col("x._uid").alias("_uid"))
    drop = materialise(rows.select("_uid").join(first, "_uid", "left_anti").distinct(), "dropped")
    again = materialise(rows.groupBy("_uid").count().where("count > 1").select("_uid"), "again")
    release(classes)
    uid = free_name(docs, "_uid")
    named = docs.withColumn(uid, row_name(classes.clashes))
    gone = drop.select(F.col("_uid").alias(uid))
    kept = named.join(small(gone, gone.count()), uid, "left_anti")
    if n := again.count():  # rows that are there more than once: one of each
        twice = small(again.select(F.col("_uid").alias(uid)), n)
        kept = kept.join(twice, uid, "left_anti").unionByName(kept.join(twice, uid, "left_semi").dropDuplicates([uid]))
    return kept.drop(uid).select(*docs.columns)
