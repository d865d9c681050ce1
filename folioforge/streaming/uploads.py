"""Files as they arrive: each is registered once, the oldest leave when there are too many, unfit ones are turned away.

The registry is a versioned table (sources.cache) whose key is the file's id; a micro-batch makes one version, numbered as
the batch, so a batch that is run again after a failure changes nothing. What was turned away is kept with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.sources.cache import Cache

# Files that stay registered, and the most bytes of one.
KEEP, MOST_BYTES = 30, 200 * 1024 * 1024
ENTRY = "name string, uploaded_at timestamp, size long"


def files(spark: SparkSession, folder: str, a_batch: int = 100) -> DataFrame:
    """(file_id, name, uploaded_at, size) of files landing in a folder, as a stream; the id is a hash of the content."""
    read = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("maxFilesPerTrigger", a_batch).load(folder)
    return read.select(F.sha1("content").alias("file_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("uploaded_at"), F.col("length").alias("size"))


def judged(uploads: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """uploads with `reason`, null for those that may be registered; the first that holds."""
    reason = F.when(F.coalesce(F.col("file_id"), F.lit("")) == "", "no id").when(~F.lower(F.coalesce("name", F.lit(""))).endswith(".pdf"), "not a PDF")
    return uploads.withColumn("reason", reason.when(F.coalesce("size", F.lit(0)) <= 0, "empty").when(F.col("size") > most, "too large"))


def changes(registry: DataFrame, uploads: DataFrame, keep: int = KEEP) -> DataFrame:
    """(file_id, name, uploaded_at, size, was, stays): all files known or new, each under its first upload, and which stay.

    registry: as registered() gives it. The newest `keep` stay, of equal times those of lesser ids."""
    fresh = uploads.groupBy("file_id").agg(F.min(F.struct("uploaded_at", "name", "size")).alias("x")).select("file_id", "x.name", "x.uploaded_at", "x.size").join(registry.select("file_id"), "file_id", "left_anti")
    both = registry.select("file_id", "name", "uploaded_at", "size", F.lit(True).alias("was")).unionByName(fresh.withColumn("was", F.lit(False)))
    newest = both.orderBy(F.desc("uploaded_at"), "file_id").limit(keep).select("file_id", F.lit(True).alias("stays"))
    return both.join(F.broadcast(newest), "file_id", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))  # at most `keep` rows


def registered(cache: Cache) -> DataFrame:
    """(file_id, name, uploaded_at, size) of the registry."""
    return cache.read().select(F.col("key").alias("file_id"), F.from_json("value", ENTRY).alias("x")).select("file_id", "x.*")


def register(cache: Cache, uploads: DataFrame, version: int | None = None, keep: int = KEEP, most: int = MOST_BYTES) -> int:
    """One version of the registry: fit uploads put, those that are too many dropped."""
    fit = judged(uploads, most).where("reason is null")
    rows = changes(registered(cache), fit, keep)
    value = F.to_json(F.struct("name", "uploaded_at", "size"))
    put = rows.where("stays and not was").select(F.col("file_id").alias("key"), value.alias("value"))
    return cache.apply(put, rows.where("was and not stays").select(F.col("file_id").alias("key")), version)


def follow(stream: DataFrame, registry: str, refused: str, checkpoint: str, keep: int = KEEP, most: int = MOST_BYTES, once: bool = False) -> StreamingQuery:
    """Registers a stream (file_id, name, uploaded_at, size); what is turned away goes to `refused`, a folder a batch."""

    def batch(uploads: DataFrame, number: int) -> None:
        spark = uploads.sparkSession
        uploads.persist()
        try:
            judged(uploads, most).where("reason is not null").write.mode("overwrite").parquet(f"{refused}/batch={number}")
            register(Cache(spark, registry), uploads, number + 1, keep, most)
        finally:
            uploads.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
