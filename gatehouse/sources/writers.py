"""Results written as tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import safe_name


def append_progress(results: DataFrame, path: str, at: str) -> None:
    """One record per decided request; undecided ones are retried by the next run."""
    decided = results.filter(F.col("decision").isin(fixed.DECISIONS))
    decided.select(F.col("todo_id").cast("string").alias("todoId"), "name", "decision",
                   F.lit(at).alias("ts")).write.mode("append").json(path)


def write_decisions(results: DataFrame, path: str, mode: str) -> None:
    """Only the partition of this backend is replaced."""
    (results.withColumn("ocr_mode", F.lit(mode)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("ocr_mode").parquet(path))


def opinion_files(opinions: DataFrame) -> DataFrame:
    """File name and text of each opinion; names carry no illegal characters."""
    name = F.concat(F.lit("最终审批意见_"), F.col("todo_id").cast("string"), F.lit("_"),
                    safe_name(F.col("name"), 30), F.lit(".txt"))
    return opinions.select("todo_id", name.alias("file"), F.col("final_opinion").alias("text"))


def write_opinions(opinions: DataFrame, path: str) -> None:
    """One row per request with its file name; a folder per request does not scale, so the
    rows are split by a hash of the request into a bounded number of folders."""
    files = opinion_files(opinions).withColumn("bucket", F.pmod(F.xxhash64("todo_id"), F.lit(256)))
    files.write.mode("overwrite").partitionBy("bucket").json(path)


def write_review(table: DataFrame, path: str) -> None:
    """One row per request and item."""
    table.write.mode("overwrite").parquet(path)
