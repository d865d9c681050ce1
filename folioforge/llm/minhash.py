"""Near-duplicate groups by b-bit MinHash.

A document is the set of its two-word shingles (A-Z lower-cased, words are runs of characters other than space and
U+0009..U+000D; one word alone is one shingle). Sets with a Jaccard similarity of THRESHOLD or more are linked, and a group
is what links connect.

(1) Equal sets collapse into one representative. (2) Of HASHES minima a set keeps the low BITS bits of each, packed, and one key
for each band of ROWS whole minima; a pair at the threshold shares no band with chance (1 - 0.8 ** 4) ** 32, below 1e-7. (3) Members
of a band are compared by their packed bits: equal lanes are counted by bit counts and corrected for lanes that are equal by
chance, and of the pairs whose estimate is within SLACK (five standard errors) of the threshold a spanning forest is
passed on, walked so that a member once reached is never compared again. A band above BUCKET members is compared with its first
member, and only those unlike it with all others, in blocks. (4) Forest edges are confirmed on full sets: first each set with
the least one it has an edge to, then the edges that still join different groups. (5) Where confirmed groups lie in one candidate
group, every member outside the largest of them is compared exactly with all members, in blocks, so an edge that fails hides no link.

No step emits all pairs of a group; nothing but counts reaches the driver. Texts are read again where full sets are needed.

Defined cases: null, empty and blank texts have no shingles and no links, each is a group of its own; null ids and repeated rows are
rows as any other (copies of each other), the least id of a group leaves nulls out and is null if there is no other; a null id
is kept only there; an empty table gives no rows; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import batches_of, materialise, release, small
from folioforge.llm.ngram_join import _STEP, SETS, by_group, components, mix, name_clashes, overlaps, row_name, spanning

THRESHOLD = 0.8
BANDS = 32
ROWS = 4
HASHES = BANDS * ROWS
#: Bits kept of each minimum, and what an estimate may lie below the threshold: five standard errors there.
BITS = 4
SLACK = 0.19
#: Members of a band that one task compares, of a block of a larger one, and sets of a block of exact comparisons.
BUCKET = 2_048
EXACT = 256
#: Shingles hashed together.
CHUNK = 2_048
_LANES = 64 // BITS
_LOW = np.uint64(sum(1 << (BITS * k) for k in range(_LANES)))
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
_ADDED = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + _STEP)


class Pairs:
    """Two-word shingles of texts; remembers the hashes of words."""

    def __init__(self, memo: int = 500_000):
        self.most, self.memo = memo, {}

    def _word(self, w: bytes) -> int:
        if len(self.memo) >= self.most:
            self.memo.clear()
        h = self.memo[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def set(self, text: bytes) -> np.ndarray:
        """The sorted hashes of the distinct shingles. Bytes are lower-cased and split by ASCII rules alone."""
        get, word = self.memo.get, self._word
        h = np.array([get(w) or word(w) for w in text.lower().split()], np.uint64)
        return np.unique(mix(h[:-1] * _STEP + h[1:]) if len(h) > 1 else mix(h + _STEP))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), CHUNK):
        np.minimum(out, (shingles[k : k + CHUNK, None] * _FACTORS + _ADDED).min(0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(key * _STEP + row)
    return key


def packed(least: np.ndarray) -> bytes:
    """The low bits of all minima (scrambled first, as minima are not spread evenly)."""
    low = (mix(least) & np.uint64((1 << BITS) - 1)).reshape(-1, _LANES)
    return np.bitwise_or.reduce(low << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)), 1).tobytes()


def unpack(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, HASHES // _LANES)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarities: equal lanes by bit counts, corrected for collisions of BITS bits."""
    x = one ^ others
    for k in (1, 2)[: BITS.bit_length() - 1]:
        x = x | (x >> np.uint64(k))
    same = HASHES - np.bitwise_count(x & _LOW).sum(-1, dtype=np.int64)
    chance = 0.5**BITS
    return (same / HASHES - chance) / (1 - chance)


def forest(signatures: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the pairs with an estimate of `least` or more; only unreached members are compared."""
    a: list[int] = []
    b: list[int] = []
    fresh, stack = np.arange(len(signatures)), []
    while len(fresh):
        if not stack:
            stack, fresh = [fresh[0]], fresh[1:]
        v = stack.pop()
        hit = estimates(signatures[v], signatures[fresh]) >= least
        new = fresh[hit].tolist()
        a += [v] * len(new)
        b += new
        stack += new
        fresh = fresh[~hit]
    return a, b


# Step 1


def digest(docs: DataFrame) -> DataFrame:
    """(_uid, _other, doc_id, rep, n, signature, bands) of each row; rep names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Pairs()
        for b in batches:
            rep, n, sig, bands = [], [], [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                x = s.set(t or b"")
                n.append(len(x))
                least = minima(x) if len(x) else None
                rep.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                sig.append(packed(least) if len(x) else None)
                bands.append(band_keys(least).view(np.int64) if len(x) else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_uid", "_other", "doc_id")), pa.array(rep, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["_uid", "_other", "doc_id", "rep", "n", "signature", "bands"])

    rows = docs.select(row_name().alias("_uid"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_other"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "_uid long, _other long, doc_id long, rep binary, n long, signature binary, bands array<long>")


def with_sets(docs: DataFrame, name: Column, wanted: DataFrame) -> DataFrame:
    """wanted (_uid, at: array of places) as one row for each place, with the full set; texts are read again, not stored."""
    places = wanted.schema["at"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Pairs()
        for b in batches:
            for u, at, t in zip(b.column("_uid").to_pylist(), b.column("at").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                x = s.set(t or b"").tobytes()
                yield pa.RecordBatch.from_pydict({"_uid": pa.array([u] * len(at), pa.int64()), **{f: pa.array([p[f] for p in at], pa.int64()) for f in places.names}, "shingles": pa.array([x] * len(at), pa.binary())})

    read = docs.select(name.alias("_uid"), F.col("text").cast("string").alias("text")).join(small(wanted, wanted.count()), "_uid")
    return read.mapInArrow(run, ", ".join(["_uid long", *(f"{f} long" for f in places.names), "shingles binary"]))


# Steps 2 and 3


def candidate_edges(reps: DataFrame, threshold: float, bucket: int) -> DataFrame:
    """(a, b), a < b: a spanning forest of the estimated matches of each band."""
    least = threshold - SLACK
    entries = reps.select("_uid", F.explode("bands").alias("band"))
    sizes = entries.groupBy("band").agg(F.count("*").alias("m"), F.min("_uid").alias("first"))
    shared = materialise(entries.join(sizes.where("m > 1"), "band"), "bands")
    signatures = reps.select("_uid", "signature")
    members = shared.where(F.col("m") <= bucket).groupBy("band").agg(F.sort_array(F.collect_list("_uid")).alias("members")).select("members").distinct()
    dealt = members.select(F.xxhash64("members").alias("key"), F.explode("members").alias("_uid")).join(signatures, "_uid")

    def compare(group: pd.DataFrame) -> pd.DataFrame | None:
        uid = group["_uid"].to_numpy()
        x, y = forest(unpack(group["signature"]), least)
        return pd.DataFrame({"a": uid[x], "b": uid[y]}) if x else None

    found = by_group(dealt, ["key"], compare, "a long, b long")

    # larger bands: with the first member, then those unlike it with all others
    large = shared.where(F.col("m") > bucket).join(signatures, "_uid")
    first = large.where("_uid = first").select("band", F.col("signature").alias("sf"))
    against = materialise(_with_estimate(large.join(first, "band"), least), "first")
    rest = against.where("NOT alike AND _uid <> first")
    n = rest.groupBy("band").agg(F.ceil(F.count("*") / bucket).alias("ni"))
    both = against.join(n, "band")
    at = lambda k: F.pmod(F.xxhash64("_uid"), F.col(k))
    nj = F.ceil(F.col("m") / bucket)
    left = both.where("NOT alike AND _uid <> first").withColumn("i", at("ni")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), nj - 1))).withColumn("side", F.lit(0))
    right = both.withColumn("_n", nj).withColumn("j", at("_n")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1))).withColumn("side", F.lit(1))
    cols = ["band", "i", "j", "side", "_uid", "signature"]

    def cross(group: pd.DataFrame) -> pd.DataFrame | None:
        side, uid, sig = group["side"].to_numpy(), group["_uid"].to_numpy(), unpack(group["signature"])
        ours, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(ours) or not len(theirs):
            return None
        hit = np.stack([(estimates(sig[v], sig[theirs]) >= least) & (uid[theirs] != uid[v]) for v in ours])
        x, y = spanning(hit, False)
        return pd.DataFrame({"a": uid[ours[x]], "b": uid[theirs[y]]}) if x else None

    blocks = by_group(left.select(*cols).unionByName(right.select(*cols)), ["band", "i", "j"], cross, "a long, b long")
    stars = against.where("alike AND _uid <> first").select(F.col("first").alias("a"), F.col("_uid").alias("b"))
    edges = found.unionByName(stars).unionByName(blocks).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = materialise(edges, "candidates")
    release(shared, against)
    return out


def _with_estimate(rows: DataFrame, least: float) -> DataFrame:
    """rows (band, m, first, _uid, signature, sf) with `alike`: whether signature and sf match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (unpack(b.column(c).to_pylist()) for c in ("signature", "sf"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("band", "m", "first", "_uid", "signature")), pa.array(estimates(x, y) >= least)], names=["band", "m", "first", "_uid", "signature", "alike"])

    return rows.mapInArrow(run, "band long, m long, first long, _uid long, signature binary, alike boolean")


# Steps 4 and 5


def _linked(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    both = int(np.isin(a, b, assume_unique=True).sum()) if len(a) <= len(b) else int(np.isin(b, a, assume_unique=True).sum())
    return threshold.denominator * both >= threshold.numerator * (len(a) + len(b) - both)


def confirmed(docs: DataFrame, name: Column, edges: DataFrame, threshold: Fraction, chunk: int) -> DataFrame:
    """The edges whose full sets are linked. The sets of an edge meet at (a, part): b's goes there once, a's once a part."""
    degree = edges.groupBy("a").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    dealt = edges.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    place = lambda side: F.struct(F.col("a"), F.col("part"), F.lit(side).cast("long").alias("side"))
    hubs = dealt.select("a", "part").distinct().select(F.col("a").alias("_uid"), place(0).alias("at"))
    wanted = materialise(hubs.unionByName(dealt.select(F.col("b").alias("_uid"), place(1).alias("at"))).groupBy("_uid").agg(F.collect_list("at").alias("at")), "wanted")

    def run(group: pd.DataFrame) -> pd.DataFrame | None:
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        side, uid = group["side"].to_numpy(), group["_uid"].to_numpy()
        hub = np.flatnonzero(side == 0)
        if not len(hub):
            return None
        good = [k for k in np.flatnonzero(side == 1) if _linked(sets[k], sets[hub[0]], threshold)]
        return pd.DataFrame({"a": np.full(len(good), uid[hub[0]]), "b": uid[good]}) if good else None

    with batches_of(docs.sparkSession, SETS):
        return materialise(by_group(with_sets(docs, name, wanted), ["a", "part"], run, "a long, b long").distinct(), "confirmed")


def joined(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """edges with the groups (ca, cb) of their ends; what comps does not name is a group of its own."""
    out = edges
    for end in ("a", "b"):
        out = out.join(comps.select(F.col("_uid").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
    return out.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))


def remaining(docs: DataFrame, name: Column, candidates: DataFrame, comps: DataFrame, threshold: Fraction, block: int) -> DataFrame | None:
    """Links between different confirmed groups of one candidate group, as a forest of each pair of blocks; None without any."""
    whole = components(candidates).select("_uid", F.col("comp").alias("cand"))
    rows = whole.join(comps, "_uid", "left").select("_uid", "cand", F.coalesce("comp", "_uid").alias("comp"))
    sizes = materialise(rows.groupBy("cand", "comp").agg(F.count("*").alias("n")), "sizes")
    best = sizes.groupBy("cand").agg(F.max(F.struct("n", "comp")).alias("x"), F.sum("n").alias("m"), F.count("*").alias("k")).where("k > 1")
    best = best.select("cand", F.col("x.comp").alias("largest"), "m", (F.col("m") - F.col("x.n")).alias("r"))
    open_ = materialise(rows.join(best, "cand"), "open")
    if open_.isEmpty():
        return None
    ni, nj = (F.ceil(F.col(c) / block).cast("long") for c in ("r", "m"))
    mine = lambda n: F.pmod(F.xxhash64("_uid"), n)
    place = F.struct("cand", "i", "j", F.col("side").cast("long").alias("side"), "comp")
    left = open_.where("comp <> largest").withColumn("i", mine(ni)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), nj - 1))).withColumn("side", F.lit(0))
    right = open_.withColumn("j", mine(nj)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), ni - 1))).withColumn("side", F.lit(1))
    at = left.select("_uid", place.alias("at")).unionByName(right.select("_uid", place.alias("at")))
    wanted = materialise(at.groupBy("_uid").agg(F.collect_list("at").alias("at")), "places")
    p, q = threshold.numerator, threshold.denominator

    def run(group: pd.DataFrame) -> pd.DataFrame | None:
        side, uid, comp = (group[c].to_numpy() for c in ("side", "_uid", "comp"))
        ours, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(ours) or not len(theirs):
            return None
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        size = np.array([len(x) for x in sets])
        both = overlaps([sets[k] for k in ours], [sets[k] for k in theirs])
        hit = (both * (p + q) >= p * (size[ours][:, None] + size[theirs][None, :])) & (comp[ours][:, None] != comp[theirs][None, :])
        x, y = spanning(hit, False)
        return pd.DataFrame({"a": uid[ours[x]], "b": uid[theirs[y]]}) if x else None

    found = by_group(with_sets(docs, name, wanted), ["cand", "i", "j"], run, "a long, b long")
    with batches_of(docs.sparkSession, SETS):
        return materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")


# The operator


def group_near_copies(docs: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET, block: int = EXACT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    exact = Fraction(threshold).limit_denominator(1000)
    rows = materialise(digest(docs), "digest")
    if clashes := name_clashes(rows):
        rows = rows.withColumn("_uid", F.when(F.col("_uid").isin(*clashes), F.col("_other")).otherwise(F.col("_uid")))
    name = row_name(clashes)
    reps = materialise(rows.where("rep is not null").groupBy("rep").agg(F.min(F.struct("_uid", "signature", "bands")).alias("x")).select("rep", "x.*"), "reps")
    edges = candidate_edges(reps, threshold, bucket)
    least = edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    good = confirmed(docs, name, least, exact, block)
    comps = components(good)
    untried = joined(edges.join(least, ["a", "b"], "left_anti"), comps).where("ca <> cb").select("a", "b")
    good = good.unionByName(confirmed(docs, name, untried, exact, block))
    comps = components(good)
    if (more := remaining(docs, name, edges, comps, exact, block)) is not None:
        comps = components(good.unionByName(more))
    named = reps.select("rep", "_uid").join(comps, "_uid", "left").select("rep", F.coalesce("comp", "_uid").alias("comp"))
    out = materialise(rows.join(named, "rep", "left").select("doc_id", "n", F.coalesce("comp", "_uid").alias("comp"), F.col("rep").isNull().alias("alone")), "groups")
    release(rows, reps, edges)
    ids = out.where("NOT alone").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = out.join(ids, "comp", "left").withColumn("component_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
