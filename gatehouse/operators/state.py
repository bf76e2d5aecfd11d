"""Keyed state, resuming, validity of earlier results, request lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def list_requests(df: DataFrame, query: str = "", bill: str = "", decision: str = "") -> DataFrame:
    """Search by name or id, filter by business type and decision."""
    if query:
        word = query.lower()
        df = df.filter(F.lower("name").contains(word) | F.lower(F.col("todo_id").cast("string")).contains(word))
    if bill:
        df = df.filter(F.col("bill_type") == bill)
    if decision:
        df = df.filter(F.col("decision") == decision)
    return df


def page(df: DataFrame, page_no: int, page_size: int, newest: str = "apply_time") -> DataFrame:
    """L1: a page of requests, newest first (kept as a top-k per partition)."""
    return df.orderBy(F.desc(newest), "todo_id").offset((page_no - 1) * page_size).limit(page_size)


def pending(apps: DataFrame, progress: DataFrame) -> DataFrame:
    """Requests without a recorded decision."""
    return apps.join(progress.select("todo_id").distinct(), "todo_id", "left_anti")


def missing_requested(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Requested keys that are not stored."""
    return keys.select("todo_id").distinct().join(cache.select("todo_id").distinct(), "todo_id", "left_anti")


def latest_state(log: DataFrame, keys: list[str], order: Column | None = None,
                 deleted_prefix: str | None = None) -> DataFrame:
    """Last record per key; keys with a deleted prefix are left out."""
    order = F.col("seq") if order is None else order
    if deleted_prefix is not None:
        log = log.filter(~F.col(keys[-1]).cast("string").startswith(deleted_prefix))
    values = [c for c in log.columns if c not in keys]
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v"))
            .select(*keys, *[F.col(f"v.{c}").alias(c) for c in values]))


def for_backend(tasks: DataFrame, mode: str) -> DataFrame:
    """Records of one backend; records without one belong to `online`."""
    return tasks.filter(F.coalesce("ocr_mode", F.lit("online")) == mode)


def task_overview(log: DataFrame, mode: str) -> DataFrame:
    """Last task state per request, shown for the active backend only."""
    return for_backend(latest_state(log, ["todo_id"]), mode).select(
        "todo_id", "status", "step", "error", F.coalesce("progress", F.lit(0)).alias("progress"))


def valid_results(results: DataFrame, ocr_keys: DataFrame) -> DataFrame:
    """Results whose backend has certificate results for the same request."""
    keys = ["todo_id", "ocr_mode"]
    return results.join(ocr_keys.select(*keys).distinct(), keys, "left_semi")


def has_valid_result(results: DataFrame, tasks: DataFrame, mode: str) -> DataFrame:
    """Decided requests of a backend without a running or failed task of it."""
    busy = for_backend(latest_state(tasks, ["todo_id"]), mode).filter(
        F.col("status").isin("running", "error")).select("todo_id")
    return (results.filter(F.col("decision").isin(fixed.DECISIONS)).join(busy, "todo_id", "left_anti"))


def merge_results(previous: DataFrame, new: DataFrame, qualified: DataFrame) -> DataFrame:
    """Earlier results that still qualify, with the re-decided keys replaced."""
    kept = (previous.join(qualified.select("todo_id").distinct(), "todo_id", "left_semi")
            .join(new.select("todo_id"), "todo_id", "left_anti"))
    return kept.unionByName(new, allowMissingColumns=True)


def call_counts(log: DataFrame, at: str = "at", endpoint: str = "kind") -> DataFrame:
    """Calls per day, in total (endpoint null) and by endpoint."""
    return (log.rollup(F.to_date(at).alias("day"), F.col(endpoint).alias("endpoint"))
            .agg(F.count(F.lit(1)).alias("calls"), F.grouping_id().alias("level"))
            .filter("level < 3").drop("level"))


def first_claims(attempts: DataFrame, key: str = "key", at: str = "at", seq: str = "seq") -> DataFrame:
    """Every attempt marked as the first of its key or a repeat.

    The first is a partial aggregate; the attempts of a hot key stay spread over
    the tasks of the (skew-split) join instead of meeting in one window.
    """
    first = attempts.groupBy(key).agg(F.min(F.struct(at, seq))[seq].alias("__first"))
    return (attempts.join(first, key).withColumn("accepted", F.col(seq) == F.col("__first")).drop("__first"))


def identity_violations(df: DataFrame, ids: list[str]) -> DataFrame:
    """What is wrong with the identity of a write: ids, business type, operation."""
    wrong = [F.when(~F.coalesce(F.col(c).cast("string").rlike(fixed.ID_PATTERN), F.lit(False)), F.lit(c)) for c in ids]
    wrong.append(F.when(~F.coalesce(F.col("bill_type").isin(fixed.BILL_TYPES), F.lit(False)), F.lit("bill_type")))
    wrong.append(F.when(~F.coalesce(F.col("oper_code").isin(fixed.OPER_CODES), F.lit(False)), F.lit("oper_code")))
    return (df.withColumn("violations", F.array_compact(F.array(*wrong)))
            .filter(F.size("violations") > 0))


FRESH_COLUMNS = ["business_bill_id", "task_id", "proc_inst_id", "act_inst_id", "bill_type"]


def verify_fresh(planned: DataFrame, fresh: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Planned writes with the columns that no longer agree with the current task."""
    columns = FRESH_COLUMNS if columns is None else columns
    now = fresh.select("todo_id", F.lit(True).alias("__found"), F.col("work_item_status").alias("__status"),
                       *[F.col(c).alias(f"__{c}") for c in columns])
    differs = [F.when(~F.coalesce("__found", F.lit(False)), F.lit("todo_id"))]
    differs += [F.when(F.col("__found") & ~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]
    differs.append(F.when(F.col("__found") & ~F.coalesce(
        F.col("__status").cast("string") == "0", F.lit(False)), F.lit("work_item_status")))
    return (planned.join(now, "todo_id", "left").withColumn("mismatches", F.array_compact(F.array(*differs)))
            .select(*planned.columns, "mismatches"))


def live_cache(log: DataFrame, as_of: str, ttl_seconds: int = 86400) -> DataFrame:
    """T4 as a batch view: entries younger than their time to live; undated ones never count."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))
    return log.filter(F.col("at").isNotNull() & (F.col("at") >= limit))
