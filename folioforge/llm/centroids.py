"""Centroid clustering: plain Lloyd rounds over integer vectors.

Kept are vectors of exactly DIMENSIONS components, none null, NaN or infinite; each component x becomes floor(SCALE * x).
The first centroids are the K kept vectors with the least SHA-256 of `1:<id>`. In each round the centroids (K x DIMENSIONS
numbers, of fixed size) are broadcast, tasks compute integer squared differences to each of them in NumPy, take the nearest
(ties: the smaller number) and keep integer sums and counts; a task gives one row a cluster and groupBy merges them. Every
round reads the input again, so nothing but K rows reaches the driver and no lineage grows.

Defined cases: vectors that are not kept have no row in the result; null ids come last among the first centroids; of equal
hashes (repeated ids) the smaller vector comes first; repeated rows are vectors of their own; fewer than K kept vectors give
as many centroids; none, or an empty table, gives no rows; only the id and the vector are read, so other columns may have any
names. Integers above LARGEST in size are an error, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import materialise

K = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
LARGEST = 1 << 27


def kept_vectors(df: DataFrame, id_col: str, vector: str, dimensions: int) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dimensions) & finite)


def integers(vectors: pd.Series, scale: int) -> np.ndarray:
    """Rows of floor(scale * x)."""
    x = np.floor(np.stack(vectors.to_numpy()) * float(scale))
    if np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is above {LARGEST} in size after scaling")
    return x.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the squared distance to it."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    k = d.argmin(1)
    return k, d[np.arange(len(x)), k]


def first_centroids(rows: DataFrame, k: int, scale: int) -> np.ndarray:
    """At most k vectors, of the least hashes."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    got = rows.select(order.alias("h"), F.transform("v", lambda x: F.floor(x * float(scale))).alias("v")).sort(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in got], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: exact floors of the means; those without vectors stay."""
    sent, width = rows.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            if len(b):
                x = integers(b["v"], scale)
                k = nearest(x, c)[0]
                np.add.at(total, k, x)
                n += np.bincount(k, minlength=len(c))
        some = np.flatnonzero(n)
        out = pd.DataFrame(total[some], columns=names)
        out.insert(0, "n", n[some])
        out.insert(0, "cluster", some.astype(np.int32))
        yield out

    schema = ", ".join(["cluster int", "n long", *(f"{s} long" for s in names)])
    merged = rows.select("v").mapInPandas(sums, schema).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(s) for s in names)).alias("s")).collect()
    sent.destroy()
    out = centroids.copy()
    for r in merged:  # a row a cluster
        out[r["cluster"]] = [s // r["n"] for s in r["s"]]
    return out


def sha_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = df.sparkSession
    rows = kept_vectors(df, id_col, vector, dimensions)
    centroids = first_centroids(rows, k, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at, d = nearest(integers(b["v"], scale), sent.value)
                yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64"), "cluster": at.astype(np.int32), "distance": d})

    assigned = materialise(rows.mapInPandas(assign, "vec_id long, cluster int, distance long"), "assigned")
    found = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    facts = spark.createDataFrame([(c, s, sum(found.values()), sha_of(centroids[c])) for c, s in found.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    """The same as DuckDB SQL over the table embeddings."""
    parts = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings "
        f"WHERE len(embedding) = {dimensions} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {dimensions})",
        f"dims AS (SELECT r, vec_id, d.i AS i, v[d.i] AS x FROM kept, (SELECT unnest(range(1, {dimensions + 1})) AS i) d)",
        f"seeds AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {k})",
        "c0 AS (SELECT c, d.i AS i, v[d.i] AS x FROM seeds, (SELECT unnest(range(1, %d)) AS i) d)" % (dimensions + 1),
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, c, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS d FROM dims a JOIN c{n} b USING (i) GROUP BY r, c)")
        parts.append(f"a{n} AS (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN dims USING (r) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS (SELECT o.c, o.i, CASE WHEN m.n IS NULL THEN o.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM c{n} o LEFT JOIN m{n} m ON m.c = o.c AND m.i = o.i)")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)")
    last = f"a{rounds}"
    return f"WITH {', '.join(parts)} SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256 FROM {last} a JOIN kept k USING (r) JOIN h USING (c)"
