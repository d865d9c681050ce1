import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from cases import EDGE, edge_docs

from folioforge.llm import divergence, queries


def brute(rows, least=30, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    df, tf = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        tf[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = {s: c for (x, s), c in tf.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, ps = p(whole), {s: p(c) for s, c in groups.items()}
        for s, c in groups.items():
            parts = {"pair": [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in groups if o != s], "term": [(ps[s][t] - q[t], t) for t in kept if c[t] > 0 and ps[s][t] > q[t]]}
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return Counter(out)


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{os.path.join(sf, 'documents.parquet')}'")
    got = queries.op12_divergence(spark, sf)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(c.execute(divergence.ORACLE).fetchall()) and rows
    docs = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows == brute(docs)


def invented(n, seed):
    rnd = random.Random(seed)
    words = ["Äpfel", "naïve", "über", "ABC", "abc", "x", "数据", "z"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(6)]
    return [(rnd.choice(["en", "de", None, "e'n"]), rnd.choice(["s0", "s0", "s0", "s1", 'q"', None, "é"]), " ".join(rnd.choices(words, k=rnd.randrange(30))) + rnd.choice(["", " -- 12, a_b`c{d|e}", "é\u0000x"])) for _ in range(n)]


@pytest.mark.parametrize("held, shard_rows", [(400_000, 1_000_000), (5, 7)])
def test_small_shards_and_partial_counts(spark, held, shard_rows):
    rows = [*invented(300, 1), ("only", "one", "w " * 40), ("few", "a", "rare words"), ("few", "b", ""), ("few", "c", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = Counter(map(tuple, divergence.audit(docs, min_docs=8, top=5, held=held, shard_rows=shard_rows).collect()))
    assert got == brute(rows, 8, 5)


def test_defined_cases(spark):
    docs = edge_docs(spark).withColumnsRenamed({"doc_id": "term", "n_chars": "shard"})
    for least in (1, 2, 30):
        got = Counter(map(tuple, divergence.audit(docs, min_docs=least).collect()))
        assert got == brute([(r[2], r[3], r[1]) for r in EDGE], least)
    assert divergence.audit(docs.limit(0)).collect() == []
