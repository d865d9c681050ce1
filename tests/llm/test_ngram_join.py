import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import EDGE, edge_docs

from folioforge.llm import ngram_join


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, class id, links, different sets linked) of every row."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in by[x] if j != i).items():
            if 9 * n >= 4 * (len(s) + len(sets[j])):
                links[i].add(j)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, js in enumerate(links):
        for j in js:
            up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, min((x for x in least[find(i)] if x is not None), default=None) if links[i] else d, len(links[i]), len({sets[j] for j in links[i]} - {sets[i]})) for i, (d, _) in enumerate(rows)]


def near_copies(n, seed, words=80, edits=2):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, ngram_join.class_ids(docs, **options).collect()))
    assert got == Counter(brute(rows))


def test_small_tables_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_edge_cases(spark):
    check(spark, [(r[0], r[1]) for r in EDGE])
    check(spark, [])


def test_groups_larger_than_leaves_and_blocks(spark):
    texts = near_copies(90, 1) + near_copies(30, 2, edits=5) + near_copies(12, 3, words=9, edits=0) + near_copies(40, 4, words=30, edits=1)
    shared = "one very common passage that stands in all of these otherwise different documents of the test "
    rnd = random.Random(5)
    texts += [shared + " ".join(f"y{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    check(spark, rows, bucket=8, block=16, depth=3)


def test_one_of_each_group_stays(spark):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in EDGE] + [(100 + i, t, "en", "s", 1) for i, t in enumerate(near_copies(20, 7))]
    docs = edge_docs(spark, rows).selectExpr("*", "1 as _uid", "2 as class")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    classes = {(d, t): c for (d, c, *_), (t) in zip(brute([(r[0], r[1]) for r in rows]), [r[1] for r in rows], strict=True)}
    want = Counter()
    for i, (d, t, *_) in enumerate(rows):
        c, links = brute([(r[0], r[1]) for r in rows])[i][1:3] if i == 0 else (classes[d, t], None)
        if shingles(t) and sum(classes[r[0], r[1]] == c for r in rows if shingles(r[1])) > 1:
            want[d, t] = int(d == c)
        else:
            want[d, t] += 1
    assert got == +want


def test_sampling_reaches_its_recall():
    import numpy as np

    hits = 0
    roots = ngram_join.mix(np.arange(1, ngram_join.RUNS + 1, dtype=np.uint64) * ngram_join._STEP)
    rnd = np.random.default_rng(1)
    for _ in range(400):
        x = rnd.integers(0, 2**63, 90).astype(np.uint64)
        a, b = x[:81], np.concatenate([x[9:81], x[81:]])  # 72 shared of 90: similarity 0.8
        hits += bool(set(ngram_join.children(a, roots, 0.8)) & set(ngram_join.children(b, roots, 0.8)))
    assert hits >= 399


@pytest.mark.parametrize("n", [1, 7, 300])
def test_components(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n)] + [(1000, 2000), (1500, 2000)], "a long, b long")
    got = {r["_uid"]: r["comp"] for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1500: 1000, 2000: 1000}


@pytest.mark.parametrize("depth", range(1, ngram_join.MAX_DEPTH + 1))
def test_runs_keep_the_recall_at_every_depth(depth):
    """A pair at the threshold, a set and its 80 % part, that must live to this depth."""
    assert ngram_join.RUNS >= ngram_join.runs_for(ngram_join.RECALL, depth)
    rnd = random.Random(depth)
    found = total = 0
    for _ in range(600):
        x = np.array([rnd.getrandbits(64) for _ in range(60)], np.uint64)
        y = x[:48]
        nodes = ngram_join.mix(np.arange(1, ngram_join.RUNS + 1, dtype=np.uint64) * ngram_join._STEP)
        for _ in range(depth):
            common = [np.intersect1d(ngram_join.children(x, nodes, 0.8), ngram_join.children(y, nodes, 0.8))]
            nodes = np.concatenate(common)
            if not len(nodes):
                break
        found, total = found + bool(len(nodes)), total + 1
    assert found >= 0.99 * total


def split_rows(spark, n, monkeypatch):
    """Rows that the splits of nodes make of a group of n near copies, and whether the links are right."""
    made = []
    keep = ngram_join.materialise

    def counted(df, name):
        out = keep(df, name)
        if name.startswith("large"):
            made.append(out.selectExpr("sum(size(at))").first()[0] or 0)
        return out

    with monkeypatch.context() as m:
        m.setattr(ngram_join, "materialise", counted)
        check(spark, [(i, t) for i, t in enumerate(near_copies(n, 11, words=90, edits=1))], bucket=16, block=64)
    return sum(made)


def test_a_group_of_near_copies_is_joined_to_a_leader_and_not_split(spark, monkeypatch):
    """Without leaders each member went on in all runs, at every depth."""
    assert split_rows(spark, 100, monkeypatch) <= 100 and split_rows(spark, 200, monkeypatch) <= 200


@pytest.mark.parametrize("least", [0.02, 0.32, 0.62, 0.82])
def test_sets_left_behind_with_the_leader_match_no_set_unlike_it(spark, least):
    """Sketches of any fill: where one is very like the leader (2) and one unlike it (0), a leaf would not match them."""
    rnd = np.random.default_rng(3)
    lead = rnd.integers(0, 256, ngram_join.BINS).astype(np.uint8) * (rnd.random(ngram_join.BINS) < 0.6).astype(np.uint8)
    sk = [lead]
    for _ in range(300):
        x = lead.copy()
        at = rnd.permutation(ngram_join.BINS)[: rnd.integers(0, ngram_join.BINS)]
        x[at] = rnd.integers(0, 3, len(at)) * rnd.integers(0, 100, len(at))
        sk.append(x)
    sketches = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sk)], "_uid long, sketch binary")
    big = spark.createDataFrame([(i, 1, 0) for i in range(len(sk))], "_uid long, node long, lo long")
    like = {r["_uid"]: r["rank"] for r in ngram_join.compared(big, sketches, least).collect()}
    hit = ngram_join.similar(np.array(sk), np.array(sk), least)
    assert like[0] == 2 and not any(hit[i, j] for i in like for j in like if like[i] == 2 and like[j] == 0)
