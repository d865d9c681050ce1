"""Source divergence audit: how far the word use of each source of a language is from each other one and from the language.

Terms are runs of characters other than U+0000..U+0040, U+005B..U+0060 and U+007B..U+007F, with A-Z lower-cased. Each
language keeps the V terms that stand in at least MIN_DOCS of its documents. A group is a (lang, source) that occurs, even
without terms, or a whole language; in a group whose kept terms occur N times a term of `count` occurrences has
p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V)). Part `pair` sums abs(p - q) over all kept terms for each ordered pair
of sources; part `term` ranks the terms that a source uses more than its language does.

(1) Tasks count terms by document and source and pass on bounded partial counts; groupBy merges them by (lang, source, term),
so no key has more rows than tasks. (2) Shards by a hash of (lang, term) hold all sources of a term; each is an in-memory
DuckDB whose SQL counts documents, drops rare terms and totals the language. (3) Spark adds up N and V. (4) The same shards
get the kept counts and the figures of every group, and SQL gives partial sums of pairs and the first TOP terms of each group;
Spark merges sums and ranks. A term that both sources lack has one value for each pair, so pair sums start from V times that
value and shards add only what terms that occur change: work grows with occurrences, not with V times the square of sources.
Shards hold SHARD_ROWS counts at most on average, and the figures of all groups, whose pairs are the result itself.

All arithmetic is in integers (128 bits where products need them). Defined cases: null text, lang and source are ''; repeated rows
are documents of their own; equal values rank by the bytes of the item; a language without kept terms has pairs of value 0;
one without a second source has no pairs; an empty table gives no rows; only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import materialise, release

MIN_DOCS = 30
SCALE = 1_000_000_000
ADD = 5
TOP = 50
#: Partial counts that a task holds at most, and rows of a shard.
HELD = 400_000
SHARD_ROWS = 1_000_000
#: Letters stay (A-Z lower-cased) and so do all bytes of characters above U+007F; every other byte becomes a space.
_TERMS = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def named(docs: DataFrame) -> DataFrame:
    """lang, source and text with '' for null."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def partial_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, a term of a group perhaps more than once."""
    names = ["lang", "source", "term", "n", "d"]

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in groups.items():
            if n:
                size = len(n)
                columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(_TERMS).split(b" ")
                before = len(n)
                n.update(terms)
                if b"" in n:  # between neighbouring separators
                    del n[b""]
                once = set(terms)
                once.discard(b"")
                d.update(once)
                size += len(n) - before
                if size > held:
                    yield from rows(groups)
                    groups, size = {}, 0
        yield from rows(groups)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, d long")


# Shards


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")


def in_shards(rows: DataFrame, shards: int, tables: dict[str, str], query: str, schema: str) -> DataFrame:
    """The query's rows of each shard. rows has columns `shard` and `kind`; tables gives for each kind its columns."""
    columns = [c for c in rows.columns if c not in ("shard", "kind")]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        empty = True
        for b in batches:
            if not b.num_rows:
                continue
            incoming = pa.Table.from_batches([b])  # noqa: F841  read by its name
            for kind, of in tables.items():
                make = f"SELECT {of} FROM incoming WHERE kind = '{kind}'"
                db.execute(f"CREATE TABLE {kind} AS {make}" if empty else f"INSERT INTO {kind} {make}")
            empty = False
        if not empty:
            for out in db.sql(query).fetch_record_batch(50_000):
                yield out.select(names)
        db.close()

    return rows.select("shard", "kind", *columns).repartitionById(shards, F.col("shard")).mapInArrow(run, schema)


#: Terms of a shard that stay, with the count of each source; `first` marks one row of each term.
KEEP = """
WITH kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY lang, term HAVING sum(d) >= {least})
SELECT lang, source, term, n, total, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS INTEGER) AS first
FROM counts JOIN kept USING (lang, term)
"""

_P = "CAST(1 + (CAST({scale} AS HUGEINT) * ({n} + {add})) // ({total} + {add} * g.v) AS BIGINT)"

#: Sums of pairs over the terms that occur in either source, less what Spark has counted for them already; first terms.
SUMS = """
WITH p AS (SELECT k.lang, k.source, k.term, k.n, {p} AS p, {q} AS q, g.z FROM counts k JOIN groups g USING (lang, source)),
alone AS (SELECT p.lang, p.source AS a, g.source AS b, sum(abs(p.p - g.z) - abs(p.z - g.z)) AS value
  FROM p JOIN groups g ON p.lang = g.lang AND p.source <> g.source GROUP BY ALL),
shared AS (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p) - abs(x.p - y.z) - abs(x.z - y.p) + abs(x.z - y.z)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
sums AS (SELECT * FROM alone UNION ALL SELECT lang, b, a, value FROM alone UNION ALL SELECT * FROM shared),
foremost AS (SELECT lang, source, term, p - q AS value FROM p WHERE n > 0 AND p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {top})
SELECT lang, a AS source, 'pair' AS part, b AS item, CAST(sum(value) AS BIGINT) AS value FROM sums GROUP BY lang, a, b
UNION ALL SELECT lang, source, 'term', term, value FROM foremost
"""


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, scale: int = SCALE, add: int = ADD, shard_rows: int = SHARD_ROWS, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank of every group."""
    spark, docs = docs.sparkSession, named(docs)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = partial_counts(docs, held).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = materialise(counts, "counts")
    shards = max(least, -(-counts.count() // shard_rows))
    kept = in_shards(counts.select(shard_of(shards).alias("shard"), F.lit("counts").alias("kind"), "*"), shards, {"counts": "lang, source, term, n, d"}, KEEP.format(least=int(min_docs)), "lang string, source string, term string, n long, total long, first int")
    kept = materialise(kept, "kept")
    release(counts)

    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("nl"), F.sum("first").cast("long").alias("v"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "nl", "v"])
    z = F.when(F.col("v") > 0, F.expr(f"1 + ({scale * add}L div (n + {add} * v))"))  # of a term that the group lacks
    groups = materialise(groups.withColumn("z", z), "groups")

    none = F.lit(None)
    facts = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit("groups").alias("kind"), "lang", "source", none.cast("string").alias("term"), "n", F.col("nl").alias("total"), "v", "z")
    rows = kept.select(shard_of(shards).alias("shard"), F.lit("counts").alias("kind"), "lang", "source", "term", "n", "total", none.cast("long").alias("v"), none.cast("long").alias("z"))
    sql = SUMS.format(p=_P.format(scale=scale, add=add, n="k.n", total="g.n"), q=_P.format(scale=scale, add=add, n="k.total", total="g.nl"), top=int(top))
    tables = {"counts": "lang, source, term, n, total", "groups": "lang, source, n, total AS nl, v, z"}
    partial = in_shards(rows.unionByName(facts), shards, tables, sql, "lang string, source string, part string, item string, value long")
    partial = materialise(partial, "partial")

    one, two = groups.alias("one"), groups.alias("two")
    start = one.join(two, F.col("one.lang") == F.col("two.lang")).where("one.source <> two.source")
    start = start.select("one.lang", "one.source", F.col("two.source").alias("item"), F.coalesce(F.col("one.v") * F.abs(F.col("one.z") - F.col("two.z")), F.lit(0)).alias("value"))
    pairs = partial.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(start)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = [("pair", pairs.withColumn("rank", F.row_number().over(w))), ("term", partial.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))]
    a, b = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in out)
    return a.unionByName(b)


#: The same as DuckDB SQL over the table documents, every term against every group.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
of_lang AS (SELECT lang, CAST(sum(total) AS BIGINT) AS nl, count(*) AS v FROM kept GROUP BY lang),
of_group AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS ng FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source, coalesce(ng, 0) AS ng, nl, v FROM docs JOIN of_lang USING (lang) LEFT JOIN of_group USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + {ADD})) // (g.ng + {ADD} * g.v) AS p,
    1 + (CAST({SCALE} AS HUGEINT) * (k.total + {ADD})) // (g.nl + {ADD} * g.v) AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
    FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
