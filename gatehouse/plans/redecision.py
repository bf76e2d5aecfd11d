"""The whole review as one lazy plan over tables keyed by request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import or_null
from ..operators.checklist import checklist_items, long_form, verify_items
from ..functions.fixed import ISO_CODES
from ..operators.classify import conflict_of, material_facts, material_summary, typed_flags
from ..operators.decide import OPINION_COLUMNS, append_issues, opinion_items
from ..operators.ocr import enrich_ocr, ocr_documents
from ..operators.profile import display_name, with_inspection
from ..operators.registry import enrich_registry, match_registry, registry_facts
from ..operators.routing import route_rule_sets, route_stage1, route_stage2
from ..operators.rules import Rule

STRINGS = "array<string>"


def prepare_suppliers(applications: DataFrame, suppliers: DataFrame, materials: DataFrame,
                      texts: bool = True) -> DataFrame:
    """Profiles with request columns, rule sets and what their uploads show, one row per request.

    Without `texts` the names of proof files are left empty (enough for a decision).
    """
    profile = with_inspection(schemas.conform(suppliers, schemas.SUPPLIER)).drop("bill_type")
    request = applications.select("todo_id", "bill_type", "bill_name", "apply_unit", "title")
    routed = route_rule_sets(profile.join(request, "todo_id", "left"))
    return add_uploads(routed, materials, texts)


def add_uploads(routed: DataFrame, materials: DataFrame, texts: bool = True) -> DataFrame:
    """Facts of the uploads joined to routed requests: one pass over the uploads and one row per request.

    Where no texts are wanted, only fixed-width values are aggregated.
    """
    if "slot_code" not in materials.columns:
        materials = typed_flags(materials)
    own_conflicts = "iso_conflicts" in routed.columns
    summary = material_summary(materials) if texts else material_facts(materials)
    summary = summary.withColumnRenamed("certifications", "uploaded_certifications")
    joined = routed.join(summary.drop(*[c for c in ["classified_materials", "iso_conflicts"] if c in routed.columns]), "todo_id", "left")
    if not texts:
        joined = (joined.withColumn("performance_files", F.when(F.col("has_performance"), ""))
                  .withColumn("transport_files", F.when(F.col("has_transport"), "")))
        if not own_conflicts:
            none = F.lit("")
            joined = joined.withColumn("iso_conflicts", F.array(*[
                F.when(F.col(f"clash_{code}"), conflict_of(none, none, F.lit(code), none)) for code in ISO_CODES]))
    submitted = F.coalesce("financial_submitted", F.lit(False))
    return joined.withColumns({
        "financial_submitted": submitted, "has_financial_report": submitted,
        "financial_years": F.coalesce("financial_years", F.array().cast("array<int>"))})


def licence_names(extractions: DataFrame) -> DataFrame:
    """Name on the (single) licence of each request."""
    return (extractions.filter("doc_type = 'business_license'").groupBy("todo_id")
            .agg(F.count(F.lit(1)).alias("n"), F.first(F.col("fields")["名称"], ignorenulls=True).alias("name"))
            .select("todo_id", F.when(F.col("n") == 1, F.col("name")).alias("ocr_name")))


def review_stage1(applications: DataFrame, suppliers: DataFrame, materials: DataFrame,
                  rules: list[Rule], as_of: str) -> DataFrame:
    """First decision of new requests, from profile and uploads only."""
    prepared = prepare_suppliers(applications, suppliers, materials)
    staged = route_stage1(prepared)
    kept = ["todo_id", "name", "bill_name", "route_decision", "route_opinion", *OPINION_COLUMNS]
    ruled = opinion_items(checklist_items(staged, rules, as_of, kept))
    return ruled.select(
        "todo_id", F.coalesce(or_null(F.col("name")), F.col("todo_id").cast("string")).alias("name"),
        "bill_name", "type_desc", F.coalesce("route_decision", "decision").alias("decision"),
        F.coalesce("route_opinion", "opinion").alias("opinion"))


KEPT = ["todo_id", "name", "bill_name", "title", "apply_unit", "route_decision", "route_type", "route_opinion",
        "legal_person", *OPINION_COLUMNS]


def redecide(applications: DataFrame, suppliers: DataFrame, materials: DataFrame, rules: list[Rule],
             registry: DataFrame, extractions: DataFrame, as_of: str, ocr_mode: str = "online") -> DataFrame:
    """The offline re-decision: one row per request with its result and its `items`.

    Everything meets once, on the request: uploads, registry record and certificate
    results are reduced to one row per request and joined on the same key; the
    checklist, its enrichment, the decision and the opinion are projections of that
    row. Write the result once and take `results_of` and `checklist_of` from the table.
    """
    staged = route_stage2(prepare_suppliers(applications, suppliers, materials))
    names = schemas.conform(suppliers, schemas.SUPPLIER).select("todo_id", "social_credit_code", "name").join(
        applications.select("todo_id", "apply_unit"), "todo_id", "left")
    matched = match_registry(names, registry, ["social_credit_code", "name", "apply_unit"])
    listed = checklist_items(staged, rules, as_of, KEPT)
    joined = (listed.join(registry_facts(matched), "todo_id", "left")
              .join(ocr_documents(extractions), "todo_id", "left")
              .join(licence_names(extractions), "todo_id", "left"))
    decided = opinion_items(verify_items(enrich_ocr(enrich_registry(joined, as_of))))

    def issues(items: Column) -> Column:
        return F.transform(items, lambda i: i["issue"])

    registry_issues = F.transform(F.filter(
        "items", lambda i: i["registry_issue"].isNotNull()), lambda i: i["registry_issue"])
    ocr_issues = issues(F.array_sort(F.flatten(F.transform("items", lambda i: i["ocr_issues"]))))
    ruled = F.col("route_decision").isNull()
    none = F.array().cast("array<string>")
    staged = decided.select(
        *KEPT, "ocr_name", "opinion", F.coalesce("route_decision", "decision").alias("decision"),
        F.when(ruled, F.col("items")).otherwise(F.filter("items", lambda i: F.lit(False))).alias("items"),
        F.when(ruled, registry_issues).otherwise(none).alias("qcc_issues"),
        F.when(ruled, ocr_issues).otherwise(none).alias("ocr_issues"))
    name = F.coalesce(or_null(display_name(
        F.col("ocr_name"), F.col("title"), F.col("apply_unit"), F.col("name"))), F.col("todo_id").cast("string"))
    return staged.select(
        "todo_id", name.alias("name"), F.coalesce("bill_name", F.lit("")).alias("bill_name"),
        F.coalesce("route_type", "type_desc").alias("type_desc"), "decision",
        F.when(ruled, append_issues(F.col("opinion"), F.col("decision"), F.col("qcc_issues"), F.col("ocr_issues")))
        .otherwise(F.col("route_opinion")).alias("opinion"),
        F.when(F.col("route_decision") == "skip", F.regexp_extract(
            "route_opinion", "^不适用。(.*)。$", 1)).alias("skip_reason"),
        "qcc_issues", "ocr_issues", F.lit(ocr_mode).alias("ocr_mode"),
        F.lit(as_of).cast("date").alias("decided_on"), "items")


def results_of(reviewed: DataFrame) -> DataFrame:
    return reviewed.drop("items")


def checklist_of(reviewed: DataFrame) -> DataFrame:
    return long_form(reviewed)
