"""The translation cache as a table, settings, and the history of tasks."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """(key, value) of both, fresh values over cached ones (of repeated keys the greatest value); blank values are not kept."""
    rows = cache.select("key", "value", F.lit(0).alias("_at")).unionByName(fresh.select("key", "value", F.lit(1).alias("_at")))
    rows = rows.where("key is not null and value is not null and trim(value) != ''")
    return rows.groupBy("key").agg(F.max(F.struct("_at", "value"))["value"].alias("value"))


def lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """items (with key) and `value`, null where the cache has none."""
    return items.join(cache.select("key", "value"), "key", "left")


def merged_settings(defaults: Mapping, stored: Mapping) -> dict:
    """Defaults overlaid with stored settings: mappings by key, all else replaced, None ignored."""
    out = dict(defaults)
    for k, v in stored.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged_settings(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def history(tasks: DataFrame, keep: int = 50) -> DataFrame:
    """The newest row (finished_at) of each task_id, newest first, this many."""
    last = tasks.groupBy("task_id").agg(F.max_by(F.struct(*tasks.columns), "finished_at").alias("x"))
    return last.select("x.*").orderBy(F.desc("finished_at"), F.desc("task_id")).limit(keep)


def load_settings(path: str, defaults: Mapping) -> dict:
    """Defaults overlaid with the settings of a JSON file; a missing or damaged file leaves the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
    except (OSError, ValueError):
        stored = {}
    return merged_settings(defaults, stored if isinstance(stored, Mapping) else {})


def save_settings(path: str, settings: Mapping) -> None:
    """Write settings of the driver as JSON: to a file beside it first, which then takes its place at once."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(settings, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def kept_tasks(tasks: DataFrame, most: int = 50) -> DataFrame:
    """tasks (task_id, status, created_at) without the oldest finished ones that are too many; running ones always stay."""
    finished = F.col("status").isin("done", "error", "cancelled")
    running = tasks.where(~finished)
    newest = Window.orderBy(F.desc("created_at"), F.desc("task_id"))  # over `most` rows at most
    last = tasks.where(finished).orderBy(F.desc("created_at"), F.desc("task_id")).limit(most).withColumn("_n", F.row_number().over(newest))
    room = running.agg((F.lit(most) - F.count("*")).alias("_room"))
    return running.unionByName(last.join(F.broadcast(room), F.col("_n") <= F.col("_room")).drop("_n", "_room"))


def registered(uploads: DataFrame, keep: int = 30) -> DataFrame:
    """The parsed uploads (file_id, name, uploaded_at) that stay registered: each file once, under its first upload, the newest `keep`."""
    pdf = uploads.where(F.lower("name").endswith(".pdf"))
    once = pdf.groupBy("file_id").agg(F.min(F.struct("uploaded_at", "name")).alias("x")).select("file_id", "x.name", "x.uploaded_at")
    return once.orderBy(F.desc("uploaded_at"), "file_id").limit(keep)


def recent_logs(logs: DataFrame, keep: int = 200) -> DataFrame:
    """The newest `keep` lines (task_id, at, message) of each task."""
    newest = Window.partitionBy("task_id").orderBy(F.desc("at"), F.desc("message"))
    return logs.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def manifest(files: DataFrame) -> DataFrame:
    """(task_id, name, kind, label, size, url) of files (task_id, path, kind, label, size)."""
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    label = F.when(F.coalesce("label", F.lit("")) == "", F.col("kind")).otherwise(F.col("label"))
    return files.select("task_id", name.alias("name"), "kind", label.alias("label"), F.coalesce("size", F.lit(0)).alias("size"), F.concat(F.lit("/api/download/"), F.col("task_id"), F.lit("/"), name).alias("url"))


def run_statistics(paragraphs: DataFrame, by: str) -> DataFrame:
    """Counts of a run's paragraphs (by, translatable, target, cached, tokens, retries, numbers_missing)."""
    sent, there = F.col("translatable"), F.coalesce(F.col("target"), F.lit("")) != ""
    return paragraphs.groupBy(by).agg(
        F.count_if(sent).alias("paragraphs"), F.count_if(sent & there).alias("translated"), F.count_if(sent & ~there).alias("failed"), F.count_if(~sent).alias("skipped"),
        F.coalesce(F.sum(F.when(sent, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count_if(sent & F.col("cached")).alias("cache_hits"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.count_if(sent & (F.col("numbers_missing") > 0)).alias("numeric_mismatched"),
    )
