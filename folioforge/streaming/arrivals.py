"""Documents as they arrive: files landing in a folder, repeated paragraphs dropped while a watermark remembers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.functions import text as T


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """The Parquet files of a folder as a stream, this many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def fresh_paragraphs(stream: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """(doc_id, at, key, line): non-blank lines whose key has not come within the delay; state ends with the watermark."""
    keyed = stream.withWatermark(at, delay).select("doc_id", at, F.explode(F.split("text", "\n")).alias("line"))
    keyed = keyed.withColumn("key", T.match_key(F.col("line"))).where("key != ''")
    return keyed.dropDuplicatesWithinWatermark(["key"]).select("doc_id", at, "key", "line")
