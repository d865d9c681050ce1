"""The source contract of parsed pages: spans of text with their place and style, and pages.

Spans and pages come from any parser as JSON or Parquet; columns that are missing or null get their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T

#: Columns with their types and defaults.
SPANS = {
    "file_id": ("string", ""), "page": ("int", 0), "block": ("int", 0), "line": ("int", 0), "span": ("int", 0), "text": ("string", ""),
    "x0": ("double", 0.0), "y0": ("double", 0.0), "x1": ("double", 0.0), "y1": ("double", 0.0), "font": ("string", ""), "size": ("double", 10.0),
    "flags": ("int", 0), "color": ("int", 0), "dir_x": ("double", 1.0), "dir_y": ("double", 0.0), "wmode": ("int", 0), "origin_y": ("double", None),
}
PAGES = {"file_id": ("string", ""), "page": ("int", 0), "width": ("double", 595.0), "height": ("double", 842.0), "rotation": ("int", 0)}


def conform(rows: DataFrame, columns: dict) -> DataFrame:
    """rows with exactly these columns, cast, defaults where they are null or missing."""
    there = {c.lower(): c for c in rows.columns}
    return rows.select(*(F.coalesce(F.col(there[n]).cast(t) if n in there else F.lit(None).cast(t), F.lit(d).cast(t)).alias(n) for n, (t, d) in columns.items()))


def read_spans(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Spans of a folder, with a declared schema so that JSON is not read twice."""
    return conform(_read(spark, path, form, SPANS), SPANS)


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return conform(_read(spark, path, form, PAGES), PAGES)


def _read(spark: SparkSession, path: str, form: str, columns: dict) -> DataFrame:
    if form == "json":
        return spark.read.schema(", ".join(f"{n} {t}" for n, (t, _) in columns.items())).json(path)
    return spark.read.format(form).load(path)


#: The column that holds a record that could not be read.
BROKEN = "_broken"
WARNING = "page {} could not be read"


def read_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Spans of a folder of JSON lines, and the records that are no spans: (file, record), by the file they stand in."""
    kind = ", ".join([*(f"{n} {t}" for n, (t, _) in SPANS.items()), f"{BROKEN} string"])
    read = spark.read.text(path).where("trim(value) != ''").select("value", F.col("_metadata.file_name").alias("file"), F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("s"))
    broken = F.col("s").isNull() | F.col(f"s.{BROKEN}").isNotNull()
    return conform(read.where(~broken).select("s.*"), SPANS), read.where(broken).select("file", F.col("value").alias("record"))


def parsed(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, pages, warnings) of pages as a parser gives them: file_id, page, body, a JSON object with width, height,
    rotation and spans. A page whose body cannot be read is a page of the usual size without text, with a warning; it does
    not stop its file. Null bodies count as such; null spans are none."""
    span = ",".join(f"{n}:{t}" for n, (t, _) in SPANS.items() if n not in ("file_id", "page"))
    kind = f"width double, height double, rotation int, spans array<struct<{span}>>, {BROKEN} string"
    read = documents.select("file_id", "page", F.from_json(F.coalesce("body", F.lit("")), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("b"), (F.trim(F.coalesce("body", F.lit(""))) == "").alias("_none"))
    failed = F.col("b").isNull() | F.col(f"b.{BROKEN}").isNotNull() | F.col("_none")
    good = lambda c: F.when(~failed, F.col(f"b.{c}")).alias(c)
    pages = conform(read.select("file_id", "page", good("width"), good("height"), good("rotation")), PAGES)
    spans = conform(read.where(~failed).select("file_id", "page", F.explode("b.spans").alias("s")).select("file_id", "page", "s.*"), SPANS)
    text = F.concat(F.lit(WARNING.split("{}")[0]), (F.col("page") + 1).cast("string"), F.lit(WARNING.split("{}")[1]))
    return spans, pages, read.where(failed).select("file_id", "page", text.alias("warning"))


def lines(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of spans: text in order of spans, box within the page's height, mean size by characters, leading style, direction.

    Empty spans and lines that are blank after cleaning are dropped. The style of a line is that of most characters, of
    equals the one that comes first; it is bold if half of its characters are."""
    weight = F.greatest(F.lit(1), F.length(T.clean_text(F.col("text"))))
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.contains(F.lower("font"), F.lit("bold"))
    chars = F.greatest(F.lit(1), F.length("text"))
    key = ["file_id", "page", "block", "line"]
    # one shuffle by page, which all that follows on pages, blocks and lines can use; as many tasks as the session has partitions
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    real = spans.where("text != ''").repartition(tasks, "file_id", "page").withColumns({"_w": weight, "_b": bold, "_n": chars})
    edges = lambda: (F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    styled = real.groupBy(*key, "font", "size", "color").agg(
        *edges(), F.sum("_w").alias("_w"), F.sum(F.when(F.col("_b"), F.col("_w")).otherwise(0)).alias("_bw"), F.sum(F.col("size") * F.col("_n")).alias("_sn"), F.sum("_n").alias("_n"),
        F.min("span").alias("_first"), F.min_by(F.struct("dir_x", "dir_y", "wmode", "origin_y"), "span").alias("_d"), F.collect_list(F.struct("span", "text")).alias("_t"),
    )
    whole = styled.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("_t"))), lambda s: s["text"]), "").alias("text"), *edges(),
        F.max_by(F.struct("font", "size", "color"), F.struct("_w", -F.col("_first"))).alias("style"), (F.sum("_sn") / F.sum("_n")).alias("mean_size"),
        (F.sum("_bw") >= F.sum("_w") * 0.5).alias("bold"), F.min_by("_d", "_first").alias("_d"),
    )
    placed = whole.where(T.clean_text(F.col("text")) != "").join(pages.select("file_id", "page", "width", "height"), ["file_id", "page"], "left")
    clamped = placed.withColumns({"y0": F.greatest(F.lit(0.0), "y0"), "y1": F.least(F.coalesce("height", F.lit(842.0)), "y1")})
    return clamped.select(*key, "text", "x0", "y0", "x1", "y1", "mean_size", "bold", "style.*", "_d.*", F.coalesce("width", F.lit(595.0)).alias("width"), F.coalesce("height", F.lit(842.0)).alias("height"))
