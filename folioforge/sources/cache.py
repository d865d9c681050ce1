"""A key-value table with versions: values are put and dropped, readers see whole versions, and old ones are merged.

The folder holds `base-<version>` and `delta-<version>` tables of Parquet. A version is written beside them and takes its
name at once, so a reader never sees a part of one, a job that is stopped leaves none, and of two writers of one version
the second fails. A dropped key is a row without a value (a tombstone) until the deltas are merged into a new base.

Defined cases: a folder that is not there is an empty table; null keys and null or blank values are not kept; of a key that
one version puts more than once the greatest value stays, and a key both put and dropped is put."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"(base|delta)-(\d+)")
SCHEMA = "key string, value string"


class Cache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def tables(self) -> list[tuple[int, str]]:
        """(version, kind) of the tables that readers use: the newest base and all deltas after it."""
        if not self._fs.exists(self._at("")):
            return []
        found = sorted((int(m[2]), m[1]) for s in self._fs.listStatus(self._at("")) if (m := _NAME.fullmatch(s.getPath().getName())))
        base = max((v for v, k in found if k == "base"), default=0)
        return [(v, k) for v, k in found if v == base and k == "base" or v > base and k == "delta"]

    def version(self) -> int:
        return max((v for v, _ in self.tables()), default=0)

    def _commit(self, rows: DataFrame, kind: str, version: int) -> None:
        beside = f"_new-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{beside}")
        files = self._hadoop.FileContext.getFileContext(self._at("").toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            files.rename(self._at(beside), self._at(f"{kind}-{version:012d}"), plain)  # fails if the version is there
        except Exception:
            self._fs.delete(self._at(beside), True)
            raise

    def read(self) -> DataFrame:
        """(key, value) of all keys that were put last."""
        rows = self._rows()
        return rows.groupBy("key").agg(F.max_by(F.struct("value"), "version")["value"].alias("value")).where("value is not null")

    def _rows(self) -> DataFrame:
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{k}-{v:012d}").select("key", "value", F.lit(v).alias("version")) for v, k in self.tables()]
        if not parts:
            return self.spark.createDataFrame([], f"{SCHEMA}, version int")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def apply(self, put: DataFrame | None = None, drop: DataFrame | None = None, version: int | None = None) -> int:
        """A new version that puts (key, value) and drops (key); its number. With `version`, one that is there stays as it is."""
        if version is not None and self.version() >= version:
            return version
        none = self.spark.createDataFrame([], SCHEMA)
        good = (put if put is not None else none).select("key", "value").where("key is not null and value is not null and trim(value) != ''")
        gone = (drop if drop is not None else none).select("key", F.lit(None).cast("string").alias("value")).where("key is not null")
        new = version or self.version() + 1
        self._commit(good.unionByName(gone).groupBy("key").agg(F.max("value").alias("value")), "delta", new)
        return new

    def compact(self) -> int:
        """Merges all versions into a base without tombstones; readers of the old tables are not disturbed."""
        now = self.version()
        if now and (now, "base") not in self.tables():
            self._commit(self.read(), "base", now)
        return now

    def vacuum(self) -> int:
        """Deletes tables that no reader needs since the newest base, and leavings of writers that were stopped; their number."""
        keep = {f"{k}-{v:012d}" for v, k in self.tables()}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []
        old = [n for n in names if n not in keep and (_NAME.fullmatch(n) or n.startswith("_new-"))]
        for n in old:
            self._fs.delete(self._at(n), True)
        return len(old)
