import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import pytest

from folioforge.llm import centroids, queries


def brute(rows, k=16, rounds=3, dimensions=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                new = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
                c[j] = new
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found)


def vectors(n, seed, dimensions=64):
    rnd = random.Random(seed)
    return [(i, [rnd.choice([rnd.gauss(0, 1), 0.0, -0.5, 0.015625]) for _ in range(dimensions)]) for i in range(n)]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    plain = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert Counter(map(tuple, centroids.cluster_vectors(df, **options).collect())) == brute(plain, **options)


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{os.path.join(sf, 'embeddings.parquet')}'")
    got = queries.op13_centroids(spark, sf)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(c.execute(centroids.oracle()).fetchall()) and rows
    assert rows == brute([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])


def test_vectors_that_do_not_take_part(spark):
    rows = vectors(60, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [nan] * 64), (106, [1.0] * 63 + [-inf]), (107, [inf] * 64)]
    run(spark, rows)
    run(spark, rows[60:])
    run(spark, [])


def test_ties_repeats_nulls_and_few_vectors(spark):
    one = vectors(3, 2)
    run(spark, one)
    run(spark, [*one, *one, (None, one[0][1]), (None, None), (None, [0.0] * 64)])
    run(spark, [(i, [float(i % 2)] * 64) for i in range(40)])  # equal centroids: ties go to the smaller number, the others stay empty
    run(spark, vectors(50, 3, 4), k=5, rounds=1, dimensions=4)


def test_more_columns_and_doubles(spark):
    rows = [(i, v, i, "x") for i, v in vectors(30, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster long, distance string")
    assert Counter(map(tuple, centroids.cluster_vectors(df).collect())) == brute([r[:2] for r in rows])


def test_values_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="above|overflow|OVERFLOW"):
        centroids.cluster_vectors(df).collect()
