"""Expired caches: inventory and cascaded removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import or_null, title_of


def expired_inventory(files: DataFrame, entries: DataFrame, results: DataFrame, as_of: str,
                      days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """Requests whose newest activity is older than `days`.

    `files`: todo_id, length, modified (null length for a directory itself).
    `entries`: todo_id, name, apply_unit, title, fetched_at. `results`: todo_id, name.
    The keys of all three kinds count; a request without any date is never expired.
    """
    if days < 0:
        raise ValueError("days must not be negative")
    now = F.lit(as_of).cast("timestamp")
    per_key = files.groupBy("todo_id").agg(
        F.max("modified").alias("newest_file"), F.count("length").alias("file_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
    named = results.groupBy("todo_id").agg(F.max("name").alias("result_name"))
    joined = (entries.join(per_key, "todo_id", "full_outer").join(named, "todo_id", "left")
              .filter(F.col("todo_id").cast("string").rlike(fixed.ID_PATTERN)))
    newest = F.greatest("fetched_at", "newest_file")
    label = F.coalesce(*[or_null(F.col(c)) for c in ("name", "result_name", "apply_unit", "title")])
    return (joined.withColumn("cached_at", newest)
            .filter(F.col("cached_at") < now - F.make_dt_interval(days=F.lit(days)))
            .select("todo_id", F.coalesce(title_of(label), F.concat(
                        F.lit("未知供应商（"), F.col("todo_id").cast("string"), F.lit("）"))).alias("name"),
                    "cached_at",
                    F.floor((F.unix_timestamp(now) - F.unix_timestamp("cached_at")) / 86400).cast("int").alias("age_days"),
                    F.coalesce("file_count", F.lit(0)).alias("file_count"),
                    F.coalesce("size_bytes", F.lit(0)).alias("size_bytes")))


def in_order(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy("cached_at", "name")


def purge(tables: dict[str, DataFrame], expired: DataFrame) -> dict[str, DataFrame]:
    """A10: every keyed table without the expired keys (to be written to a new location)."""
    keys = expired.select("todo_id").distinct()
    return {name: df.join(keys, "todo_id", "left_anti") for name, df in tables.items()}


def purge_registry_cache(cache: DataFrame, expired: DataFrame) -> DataFrame:
    """The registry cache is keyed 'name/part'; its quota counters and the audit log stay."""
    names = expired.select(F.col("name").alias("__name")).distinct()
    return (cache.withColumn("__name", F.regexp_extract("key", "^(.*)/[^/]*$", 1))
            .join(names, "__name", "left_anti").drop("__name"))


def purge_progress(lines: DataFrame, expired: DataFrame, column: str = "value") -> DataFrame:
    """Progress lines of other requests; lines that are no JSON objects are kept as they are."""
    key = F.get_json_object(column, "$.todoId")
    keys = expired.select(F.col("todo_id").cast("string").alias("__key")).distinct()
    return lines.withColumn("__key", key).join(keys, "__key", "left_anti").drop("__key")
