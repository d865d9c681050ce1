"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.tables import materialise, release, shared_dir, spread  # noqa: F401

#: Rows up to which a two-column table of keys may be broadcast (about 64 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, read through Spark so that any store works."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (compared as Spark does, ignoring case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The strings of a column, null as the empty string."""
    return (x if x is not None else "" for x in batch.column(column).to_pylist())


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that are run inside pass this many rows to Python at once, for rows with whole sets in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def hash_fraction(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the values of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_sample(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """One row of each of the `rows` distinct values of the columns whose hashes are least, of all where there are fewer.

    It depends on which values there are, not on how often. An estimate of their number bounds what is grouped; it has
    no part in the result, as twice as many as are asked for pass it."""
    h = hash_fraction(*(F.col(c) for c in cols))
    seen = df.agg(F.approx_count_distinct(F.xxhash64(*cols), 0.02)).first()[0]
    few = df.where(h < F.lit(2.0 * rows / seen)) if seen > 2 * rows else df
    whole = few.groupBy(h.alias("_h"), F.xxhash64(*cols).alias("_x")).agg(F.min(F.struct(*df.columns)).alias("_r"))
    return whole.orderBy("_h", "_x").limit(rows).select("_r.*").repartition(df.sparkSession.sparkContext.defaultParallelism)
