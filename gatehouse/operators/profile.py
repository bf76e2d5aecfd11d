"""Supplier profile: region, age, scope flags, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import CONFLICT
from ..functions.text import blank, first_word, has_any, or_null, trim


def years_since(found: Column, as_of: Column) -> Column:
    """Difference of the years; 0 where the founding year cannot be read."""
    year = F.substring(blank(found), 1, 4).try_cast("int")
    return F.coalesce(F.year(as_of) - year, F.lit(0)).cast("int")


def with_region(df: DataFrame, hmt_words: list[str] | None = None) -> DataFrame:
    """Overseas / HMT / foreign. Only the overseas flag decides, the country splits it."""
    words = fixed.HMT_WORDS if hmt_words is None else hmt_words
    overseas = F.coalesce(F.col("is_overseas"), F.lit(False))
    hmt = overseas & has_any(blank(F.col("country_name")), words)
    return (df.withColumn("is_overseas", overseas)
            .withColumn("is_hmt", hmt).withColumn("is_foreign", overseas & ~hmt))


def license_need(scope: Column) -> Column:
    """struct(needed, reason) from the scope with its negated parts removed."""
    plain = blank(scope)
    for word in fixed.SCOPE_NEGATIONS:
        plain = F.regexp_replace(plain, word + r"[^；;，,）)]*", "")
    licence = first_word(plain, [(w, f"生产许可证（经营范围涉及「{w}」）") for w in fixed.LICENSE_SCOPE_WORDS])
    ccc = first_word(plain, [(w, f"3C强制认证证书（经营范围涉及「{w}」）") for w in fixed.CCC_SCOPE_WORDS])
    reason = F.coalesce(licence, ccc)
    return F.struct(reason.isNotNull().alias("needed"), blank(reason).alias("reason"))


def with_license_need(df: DataFrame) -> DataFrame:
    """A licence is needed by manufacturers only, whatever the scope says."""
    need = license_need(F.col("busi_scope"))
    maker = F.coalesce(F.col("is_manufacturer"), F.lit(False))
    return (df.withColumn("needs_production_license", maker & need["needed"])
            .withColumn("production_license_reason", F.when(maker, need["reason"]).otherwise("")))


def inspection_flag(name: Column, scope: Column) -> Column:
    return (has_any(blank(name), fixed.INSPECTION_NAME_WORDS)
            | has_any(blank(scope), fixed.INSPECTION_SCOPE_WORDS))


def with_inspection(df: DataFrame) -> DataFrame:
    """Fill the inspection flags of rows written before they existed."""
    types = F.coalesce("classified_materials", F.array().cast("array<string>"))
    return (df.withColumn("is_inspection", F.coalesce(
                "is_inspection", inspection_flag(F.col("name"), F.col("busi_scope"))))
            .withColumn("has_inspection_cert", F.coalesce(
                "has_inspection_cert", F.array_contains(types, "inspection_cert"))))


def with_domestic_tip(df: DataFrame) -> DataFrame:
    """Marked overseas although the country is China."""
    suspect = F.coalesce("is_overseas", F.lit(False)) & F.trim(
        blank(F.col("country_name"))).isin(fixed.DOMESTIC_COUNTRIES)
    return df.withColumn("domestic_tip", F.when(suspect, F.lit(fixed.DOMESTIC_TIP)).otherwise(""))


def infer_types(scope: Column, type_desc: Column) -> Column:
    """Kinds of business the scope hints at; a carrier verdict is kept."""
    text = F.concat_ws(" ", blank(scope), blank(type_desc))
    kinds = F.array_compact(F.array(
        F.when(has_any(text, fixed.INFER_TRADE), F.lit("贸易商/经销商")),
        F.when(has_any(text, fixed.INFER_MAKE), F.lit("生产/制造商")),
        F.when(has_any(text, fixed.INFER_SERVICE), F.lit("服务商"))))
    return F.when(blank(type_desc).contains("运输/承运商"), F.lit("运输/承运商")).otherwise(
        F.array_join(kinds, "、"))


def title_name(title: Column) -> Column:
    return or_null(trim(F.split(blank(title), "/")[0]))


def is_department(name: Column) -> Column:
    return name.isin(fixed.DEPARTMENT_NAMES) | has_any(name, fixed.DEPARTMENT_WORDS)


def display_name(ocr_name: Column, title: Column, apply_unit: Column, short: Column) -> Column:
    """Name on the licence, else title, else a unit that is no department, else short name."""
    unit = or_null(trim(blank(apply_unit)))
    return F.coalesce(
        or_null(trim(ocr_name)), title_name(title), F.when(~is_department(unit), unit),
        trim(blank(short)))


def with_full_name(df: DataFrame) -> DataFrame:
    """Legal name for comparisons, from registry, title or unit; kept only if longer than 4."""
    unit = or_null(trim(blank(F.col("apply_unit"))))
    found = F.coalesce(
        or_null(trim(F.col("registry_name"))), title_name(F.col("title")),
        F.when(~has_any(unit, fixed.NOT_SUPPLIER_WORDS), unit))
    return df.withColumn("full_name", F.coalesce(
        or_null(F.col("full_name")), F.when(F.length(found) > 4, found)))


TYC = (
    "supName string, creditCode string, penaltyCount int, litigationCount int, "
    "taxCreditRating string, dishonestyCount int"
)


def with_tyc(df: DataFrame, column: str = "tyc_info") -> DataFrame:
    """Registry summary held as JSON text; malformed text counts as absent."""
    text = or_null(F.trim(F.col(column)))
    keys = F.json_object_keys(text)
    parsed = F.from_json(text, TYC, {"mode": "PERMISSIVE"})
    return (df.withColumn("tyc", parsed)
            .withColumn("tyc_checked", F.coalesce(F.size(keys) > 0, F.lit(False)))
            .withColumn("has_violation_3y", F.coalesce(F.col("tyc.penaltyCount"), F.lit(0)) > 0)
            .withColumn("is_dishonest", F.coalesce(F.col("tyc.dishonestyCount"), F.lit(0)) > 0))


def supplier_profile(base: DataFrame, rollup: DataFrame, as_of: str) -> DataFrame:
    """Profile of each request from its base info (with tyc_info) and what its uploads show
    (`material_summary`; a roll-up without conflicts counts as having none)."""
    day = F.lit(as_of).cast("date")
    none = F.array().cast("array<string>")
    if "iso_conflicts" not in rollup.columns:
        rollup = rollup.withColumn("iso_conflicts", F.lit(None).cast(f"array<{CONFLICT}>"))
    joined = with_tyc(base.join(rollup, "todo_id", "left"))

    def has_type(kind: str) -> Column:
        return F.array_contains(F.coalesce("classified_materials", none), kind)

    sup_type = blank(F.col("sup_type"))
    code = F.coalesce(*[or_null(c) for c in (
        F.col("credit_code"), F.col("tyc.creditCode"), F.col("org_code"))], F.lit(""))
    shaped = joined.select(
        "todo_id", "bill_type",
        F.coalesce(or_null(F.col("sup_short")), F.col("tyc.supName"), F.lit("")).alias("name"),
        F.lit(None).cast("string").alias("full_name"),
        code.alias("social_credit_code"),
        F.coalesce(F.col("reg_capl").try_cast("double"), F.lit(0.0)).alias("registered_capital"),
        F.coalesce(F.col("fact_capl").try_cast("double"), F.lit(0.0)).alias("actual_capital"),
        blank(F.col("legal_person")).alias("legal_person"),
        blank(F.col("found_time")).alias("found_time"),
        years_since(F.col("found_time"), day).alias("established_years"),
        blank(F.col("company_type")).alias("company_type"),
        sup_type.alias("sup_type"),
        blank(F.col("state")).alias("state"),
        (F.coalesce(F.col("is_in_indy"), F.lit(0)) != 0).alias("in_blacklist"),
        blank(F.col("money_type")).alias("money_type"),
        blank(F.col("busi_scope")).alias("busi_scope"),
        F.coalesce(or_null(F.col("office_addr")), F.col("home_addr"), F.lit("")).alias("business_address"),
        (F.coalesce(F.col("overseas_code"), F.lit(0)) == 1).alias("is_overseas"),
        blank(F.col("country_name")).alias("country_name"),
        (F.col("bill_type") == "P0704").alias("is_cooperation"),
        has_any(sup_type, fixed.MANUFACTURER_TYPE_WORDS).alias("is_manufacturer"),
        F.coalesce("certifications", none).alias("certifications"),
        F.coalesce("iso_conflicts", F.array().cast(f"array<{CONFLICT}>")).alias("iso_conflicts"),
        F.coalesce("classified_materials", none).alias("classified_materials"),
        has_type("business_license").alias("has_business_license"),
        has_type("legal_person_id").alias("has_legal_id_material"),
        has_type("production_license").alias("has_production_license"),
        has_type("authorization").alias("has_authorization"),
        has_type("after_sales_cert").alias("has_after_sales_cert"),
        has_type("tax_cert").alias("has_tax_cert_material"),
        has_type("tax_credit").alias("tax_credit_rating_ok"),
        has_type("financial_report").alias("has_financial_report"),
        has_type("inspection_cert").alias("has_inspection_cert"),
        F.lit(None).cast("boolean").alias("is_inspection"),
        F.lit(False).alias("qcc_finance_ok"),
        "tyc_checked", "has_violation_3y", "is_dishonest",
    )
    return with_inspection(with_license_need(with_region(shaped)))
