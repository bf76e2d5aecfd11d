"""Two engines compared, and samples to compare them on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import split_ordinal, unnested
from ..functions.text import compare_form

KEYS = ["doc_id", "doc_type"]


def compare_engines(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per (document, kind, key) that both engines give, with agreement.

    Fields count only where both sides are not empty; checks are three-valued.
    The maps of one document meet in one row, so nothing is paired across documents.
    """
    left = a.select(*KEYS, F.col("fields").alias("fa"), F.col("checks").alias("ca"))
    both = left.join(b.select(*KEYS, F.col("fields").alias("fb"), F.col("checks").alias("cb")), KEYS)
    fields = F.filter(
        F.array_intersect(F.map_keys("fa"), F.map_keys("fb")),
        lambda k: (F.coalesce(F.col("fa")[k], F.lit("")) != "") & (F.coalesce(F.col("fb")[k], F.lit("")) != ""))
    checks = F.array_intersect(F.map_keys("ca"), F.map_keys("cb"))
    rows = F.concat(
        F.transform(fields, lambda k: F.struct(
            F.lit("field").alias("kind"), k.alias("key"),
            (compare_form(F.col("fa")[k]) == compare_form(F.col("fb")[k])).alias("same"))),
        F.transform(checks, lambda k: F.struct(
            F.lit("check").alias("kind"), k.alias("key"), F.col("ca")[k].eqNullSafe(F.col("cb")[k]).alias("same"))))
    return unnested(both, KEYS, rows, "r").select(*KEYS, "r.*")


def passes(checks: Column, issues: Column) -> Column:
    return ((F.size(F.map_keys(checks)) > 0) & F.forall(F.map_values(checks), lambda v: F.coalesce(v, F.lit(False)))
            & (F.size(issues) == 0))


def engine_agreement(a: DataFrame, b: DataFrame, low: DataFrame | None = None) -> DataFrame:
    """Agreement by document type and in total (doc_type null)."""
    compared = compare_engines(a, b)
    per_doc = compared.groupBy(*KEYS).agg(
        F.count_if(F.col("kind") == "field").alias("fields"),
        F.count_if((F.col("kind") == "field") & F.col("same")).alias("same_fields"),
        F.count_if(F.col("kind") == "check").alias("checks"),
        F.count_if((F.col("kind") == "check") & F.col("same")).alias("same_checks"))
    verdicts = (a.select(*KEYS, passes(F.col("checks"), F.col("issues")).alias("pass_a"))
                .join(b.select(*KEYS, passes(F.col("checks"), F.col("issues")).alias("pass_b")), KEYS))
    rows = verdicts.join(per_doc, KEYS, "left")
    rows = rows.join(low, "doc_id", "left") if low is not None else rows.withColumn("is_low", F.lit(False))
    return rows.rollup("doc_type").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("fields"), F.lit(0)).alias("comparable_fields"),
        F.coalesce(F.sum("same_fields"), F.lit(0)).alias("matching_fields"),
        F.coalesce(F.sum("checks"), F.lit(0)).alias("comparable_checks"),
        F.coalesce(F.sum("same_checks"), F.lit(0)).alias("matching_checks"),
        F.count_if(F.col("pass_a") == F.col("pass_b")).alias("same_pass_decision"),
        F.count_if("pass_a").alias("auto_pass_a"), F.count_if("pass_b").alias("auto_pass_b"),
        F.count_if(F.coalesce("is_low", F.lit(True))).alias("low_confidence_documents"))


def mismatch_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """How often each `type:field` or `type:check` differs."""
    return (compare_engines(a, b).filter(~F.col("same"))
            .groupBy("kind", F.concat_ws(":", "doc_type", "key").alias("item"))
            .agg(F.count(F.lit(1)).alias("mismatches")))


def stratified_sample(files: DataFrame, per_type: int, kind: str, order: list[Column],
                      cells: list[Column]) -> DataFrame:
    """Of each type, ordered by size, every k-th file up to `per_type` of them."""
    ranked = split_ordinal(files, [kind], order, cells, "__rank", total="__total")
    step = F.greatest(F.lit(1), F.floor(F.col("__total") / per_type))
    place = F.col("__rank") - 1
    return (ranked.filter((place % step == 0) & (place / step < per_type))
            .withColumn("pick", (place / step).cast("int") + 1).drop("__rank", "__total"))
