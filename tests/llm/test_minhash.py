import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import EDGE, edge_docs

from folioforge.llm import minhash, queries


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, by, up, least = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows))), {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in by[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[find(i)] = find(j)
        for x in s:
            by[x].append(i)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    comp = [least.get(find(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return Counter((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, comp, strict=True))


def near(n, seed, words, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, minhash.group_near_copies(docs, **options).collect()))
    assert got == brute(rows)


def test_table_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op11_minhash(spark, sf).collect())) == brute(rows)


def test_defined_cases(spark):
    rows = [(r[0], r[1]) for r in EDGE] + list(enumerate(["A", "a", "a b", "a B", "b a", "É x", "é x", "a b a b", "a b"], 100)) + [(None, "a b"), (None, None), (100, "A")]
    check(spark, rows)
    check(spark, [])


def test_other_columns_are_not_read(spark):
    docs = edge_docs(spark).withColumnsRenamed({"lang": "_uid", "source": "rep", "n_chars": "kept"})
    got = Counter(map(tuple, minhash.group_near_copies(docs).collect()))
    assert got == brute([(r[0], r[1]) for r in EDGE])


@pytest.mark.parametrize("bucket, block", [(2048, 256), (8, 16)])
def test_groups_whose_links_fail_in_part(spark, bucket, block):
    """Near copies on both sides of the threshold, a shared passage, and chains, in bands and blocks of any size."""
    texts = near(60, 1, 60, 4) + near(50, 2, 30, 6) + near(90, 4, 100, 16) + near(20, 5, 5, 2)
    chain = [f"c{k}" for k in range(40)]
    for k in range(30):
        texts.append(" ".join(chain))
        chain[k] = f"d{k}"
    rnd = random.Random(7)
    texts += ["one very common passage that stands in all of these documents " + " ".join(f"y{rnd.randrange(10**6)}" for _ in range(20)) for _ in range(40)]
    check(spark, list(enumerate(texts)), bucket=bucket, block=block)


def test_estimates_are_corrected_for_collisions():
    rnd = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8):
        got = []
        for _ in range(60):
            x = np.unique(rnd.integers(0, 2**63, 300).astype(np.uint64))
            k = int(2 * share / (1 + share) * len(x))
            y = np.concatenate([x[:k], rnd.integers(0, 2**63, len(x) - k).astype(np.uint64)])
            a, b = (minhash.unpack([minhash.packed(minhash.minima(s))]) for s in (x, y))
            got.append(minhash.estimates(a[0], b)[0])
        assert abs(np.mean(got) - share) < 0.02
        assert np.std(got) < 0.055
