import random

from cases import edge_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import decontaminate as D


def least_distance(pattern, text):
    """Least edit distance to any substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != t)))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
def test_myers(pattern, text):
    assert D.myers(D.masks(pattern), len(pattern), text)[0] == least_distance(pattern, text)


def brute(item, text):
    """The least distance of a normal item to any part of a normal text, if it is allowed; else None."""
    n, t, e = D.normal(item or ""), D.normal(text or ""), 0
    if not n:
        return None
    if e := int(D.ERROR_RATE * len(n)):
        return d if (d := least_distance(n, t)) <= e else None
    at = [k for k in range(len(t) - len(n) + 1) if t.startswith(n, k)]
    free = lambda k: not (0 < k < len(t) and t[k - 1].isalnum() and t[k].isalnum())
    return 0 if any(free(k) and free(k + len(n)) for k in at) else None


def edited(text, n, rnd):
    t = list(text)
    for _ in range(n):
        k = rnd.randrange(len(t))
        t[k : k + 1] = rnd.choice([[], ["z"], [t[k], "q"]])
    return "".join(t)


def test_matches_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abehiost") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(20 + i))) for i in range(6)] + [(7, None), (8, ""), (9, "too short"), (10, "Abe  hio"), (11, "is"), (5, "same again " * 6), (None, "no id " * 12)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rnd.randint(0, 60))]
        if i % 2:
            _, t = rnd.choice(items[:6])
            body.insert(rnd.randrange(len(body) + 1), edited(t, rnd.randint(0, 9), rnd).upper().replace(" ", "\n "))
        if i % 7 == 0:
            body.insert(rnd.randrange(len(body) + 1), rnd.choice(["abe hio", "abe  hiox", "too SHORT", "is"]))
        docs.append((i, " ".join(body)))
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([*docs, (100, None), (101, "")], "doc_id long, text string")
    want = set()
    for i, t in docs:
        for k, x in items:
            if (dist := brute(x, t)) is not None:
                want.add((i, k, dist))
    rows = D.matches(d, b).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == want and len(rows) == len(want) > 10
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in D.matches(d, b, block=300).collect()} == want
    kept = {r["doc_id"] for r in D.drop_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, *_ in want} | {100, 101}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.text("abc é,", max_size=60)), max_size=8), st.text("abc é,", max_size=150))
def test_search_against_brute_force(items, text):
    got = {(i, d) for i, d, *_ in D.Matcher(items).search(text)}
    assert got == {(i, d) for i, x in items if (d := brute(x, text)) is not None}


def test_run_hashes():
    import numpy as np

    x = np.array([1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5, 6, 7], np.uint32)
    got = dict(D.run_hashes(x, 7))
    assert set(got) == {1, 2, 4}
    for n, h in got.items():
        assert len(h) == 15 - n and (h[: 8 - n] == h[7:]).all() and len(set(h.tolist())) == 7
    assert list(D.run_hashes(x[:0], 8)) == [] and [k for k, _ in D.run_hashes(x[:3], 8)] == [1, 2]


def test_items_next_to_points():
    """Items of any length are found next to quotes, commas and brackets, and not inside words."""
    found = lambda item, text: [r[1] for r in D.Matcher([(1, item)]).search(text)]
    assert found("2+2=4", "x 2+2=4, y") == [0] and found("2+2=4", "x 2+2=4 y") == [0] and found("2+2=4", "x 12+2=4 y") == []
    assert found("What is the capital of Peru?", '"what is the capital of peru?" he said') == [0]
    assert found("the answer is forty two exactly", "so the answer is forty twoo exactly.") == [1]
    assert found("the answer is forty two exactly", "so the answers is forty twoo exactly.") == []
    assert found("is", "this") == [] and found("is", "this (is)") == [0] and found("+", "a+b") == [0]
    rnd = random.Random(11)
    for n in range(3, 61):
        item = "".join(rnd.choice("abcdefgh ") for _ in range(n)).strip() or "abc"
        for left, right in (('"', '"'), ("(", ")."), ("", ","), ("x", ""), ("¿", "?"), (" ", " ")):
            for k in (0, 1, 2, 4):
                text = f"before {left}{edited(item, k, rnd)}{right} after"
                got = [d for _, d, *_ in D.Matcher([(0, item)]).search(text)]
                assert got == [d for d in [brute(item, text)] if d is not None], (item, text)


def test_memory_of_a_block():
    """What a worker builds for a block of the full size, measured in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource
from folioforge.llm import decontaminate as D
rnd = random.Random(1)
word = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(50_000)]
one = lambda k, n: " ".join(rnd.choices(word, k=n)) + str(k)
n = %d
items = [(k, one(k, %d)) for k in range(n)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m = D.Matcher(items)
assert m.search("so " + items[5][1] + "!")[0][0] == 5
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    for n, words in ((80_000, 75), (250_000, 7)):  # long items and short ones, of 48 M counted characters
        size = n * (words * 6 + D.ITEM_CHARS)
        assert 0.75 * D.BLOCK_CHARS < size < 1.3 * D.BLOCK_CHARS
        out = subprocess.run([sys.executable, "-c", code % (n, words)], capture_output=True, text=True, check=True)
        assert float(out.stdout) < 500


def test_short_items_of_five_to_39_characters(spark):
    rnd = random.Random(9)
    items = [(n, ("".join(rnd.choice("abcdefgh ") for _ in range(200)).strip().replace("  ", " x"))[:n].strip().ljust(n, "z")) for n in range(5, 40)]
    docs = [(n, f"before {t.upper()} after") for n, t in items] + [(100 + n, f"before x{t}x after") for n, t in items]
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(n, n) for n, _ in items} and {r["doc_id"] for r in got if r["doc_id"] >= 100} == {100 + n for n in range(20, 40)}  # inside a word only where edits are allowed


def test_large_benchmarks_take_one_scan(spark):
    rnd = random.Random(4)
    items = [(i, "".join(rnd.choices("abcdefghij ", k=400))) for i in range(2500)]
    b = spark.createDataFrame(items, "item_id long, text string").crossJoin(spark.range(4).withColumnRenamed("id", "k")).selectExpr("item_id + 10000 * k as item_id", "concat(text, k) as text")
    assert len(list(D.blocks(b))) == 1 and len(list(D.blocks(b, 1_000_000))) == 6


def test_place(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    d = spark.createDataFrame([(1, "well  now\n" + item.replace("jumps", "jumpz") + " he said")], "doc_id long, text string")
    r = D.matches(d, spark.createDataFrame([(4, item)], "item_id long, text string")).first()
    assert tuple(r) == (1, 4, 1, 2, 2, 14)


def test_planted_passages(spark, sf):
    docs, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], D.normal(r["text"])) for r in b.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in D.normal(r["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(docs, b).collect()}
    assert want <= got and len(got) <= len(want) + 5


def test_edge_cases(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = edge_docs(spark).selectExpr("*", "1 as item_id", "2 as distance")
    assert D.matches(docs, b).count() == 0 and D.matches(docs, b.limit(0)).count() == 0 and D.matches(docs.limit(0), b).count() == 0
    kept = D.drop_contaminated(docs, b)
    assert kept.columns == docs.columns and kept.count() == docs.count()
