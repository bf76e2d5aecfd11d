"""The review table: basis, material state and verification result of every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ordering import joined_text, unnested
from ..functions.outcome import say
from ..functions.text import blank, shown
from .rules import Rule


def required_of(rule_id: Column) -> Column:
    """struct(type, label) of the material a rule needs."""
    return F.coalesce(*[
        F.when(rule_id == rule, F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label")))
        for rule, (kind, label) in fixed.REQUIRED_MATERIALS.items()])


def missing_materials(requests: DataFrame) -> DataFrame:
    """Required but not uploaded, one row per (request, rule, label).

    `requests` carry items, classified_materials and financial_submitted, so what is
    required meets what is uploaded in one row. Items that do not apply are left out.
    """
    kept = ["todo_id", "classified_materials", "financial_submitted"]
    rows = unnested(requests, kept, F.col("items"), "i").select(
        "todo_id", "classified_materials", "financial_submitted", "i.rule_id", "i.name", "i.status", "i.has_files")
    rows = rows.filter("status <> 'skip' and rule_id not like 'D2%'")
    need = required_of(F.col("rule_id"))
    types = F.coalesce("classified_materials", F.array().cast("array<string>"))
    label = (
        F.when(F.col("rule_id") == "E2", F.when(~F.col("has_files"), "过往业绩证明"))
        .when(F.col("rule_id") == "A08", F.when(~F.col("financial_submitted"), "经审计的上年度财报"))
        .when(~F.array_contains(types, need["type"]), need["label"]))
    return rows.select("todo_id", "rule_id", "name", label.alias("label")).filter("label is not null")


def _described() -> Column:
    """Whether the validity line of an ISO certificate already says that it is in force."""
    return F.coalesce(F.col("doc_type").isin(fixed.ISO_TYPES) & F.col("own_fields")["有效期至"].isNotNull()
                      & F.col("own_checks")["在有效期内"], F.lit(False))


def passed_checks(attachments: DataFrame) -> DataFrame:
    """Passed checks per (request, type), grouped by attachment, as one text.

    Works on single attachments (see combine_attachments), so each row already is
    a group; the short texts are joined in attachment order. A check that another line describes is left out.
    """
    names = F.map_keys(F.map_filter("own_checks", lambda k, v: v))
    names = F.when(_described(), F.array_remove(names, "在有效期内")).otherwise(names)
    group = F.when(F.col("documents") > 1, say("附件", F.col("ordinal").cast("string"), " ")).otherwise("")
    rows = attachments.select(
        "todo_id", "doc_type", "ordinal", F.concat(group, F.array_join(names, "、")).alias("part"),
        F.size(names).alias("n")).filter("n > 0")
    text = joined_text(rows, ["todo_id", "doc_type"], F.struct("ordinal", "part"), F.col("part"),
                       F.floor(F.col("ordinal") / 512), "；", "passed")
    return text.withColumn("passed", say("核验通过：", F.col("passed")))


def verification(attachments: DataFrame) -> DataFrame:
    """Fields and issues per (request, type) as shown in the review table.

    `attachments` may carry `system_person`, the legal person of the system record.
    """
    iso = F.col("doc_type").isin(fixed.ISO_TYPES)
    licence = F.col("doc_type") == "business_license"
    f, c = F.col("own_fields"), F.col("own_checks")
    person = F.col("system_person") if "system_person" in attachments.columns else F.lit(None).cast("string")

    def pair(label: str, value: Column) -> Column:
        return say(label, "=", F.nullif(value, F.lit("")))

    until, valid = f["有效期至"], c["在有效期内"]
    iso_parts = F.array(
        pair("获证组织", f["获证组织"]), pair("认证机构", f["认证机构"]),
        F.when(until.isNull(), "未识别到有效期").when(valid, say("有效期至 ", until, "，在有效期内"))
        .when(~valid, say("有效期至 ", until, "，已过期")).otherwise(say("有效期至 ", until)))
    licence_parts = F.array(
        pair("统一社会信用代码", f["统一社会信用代码"]), pair("名称", f["名称"]),
        pair("法定代表人", f["法定代表人"]), say("注册资本=", f["注册资本_万"], "万"),
        F.when(~c["法人一致"], say("法定代表人：执照「", blank(f["法定代表人"]), "」vs 系统「", blank(person), "」不一致")),
        F.when(~c["信用代码一致"], F.lit("信用代码：执照与系统不一致")),
        F.when(~c["经营范围一致"], F.lit("经营范围与系统不一致")))
    wrong = F.size(F.map_keys(F.map_filter("own_checks", lambda k, v: ~v)))
    others = F.concat(
        F.transform(F.slice(F.map_entries("own_fields"), 1, 3), lambda e: F.concat(e["key"], F.lit("="), shown(F.coalesce(e["value"], F.lit("None"))))),
        F.array(F.when((F.size("own_issues") == 0) & (wrong > 0), say(wrong.cast("string"), " 项不符"))))
    shown_issues = F.when(iso, F.slice("own_issues", 1, 2)).when(licence, F.slice("own_issues", 1, 3)).otherwise(F.col("own_issues"))
    parts = F.concat(F.array_compact(F.when(iso, iso_parts).when(licence, licence_parts).otherwise(others)), shown_issues)
    # a reading that failed shows its error and nothing else
    part = F.coalesce(F.col("error"), F.array_join(parts, "；"))
    rows = attachments.select("todo_id", "doc_type", "ordinal", part.alias("part"),
                              f["姓名"].isNotNull().alias("has_name"), until.isNotNull().alias("has_term"))
    flags = rows.groupBy("todo_id", "doc_type").agg(
        F.max("has_name").alias("has_name"), F.max("has_term").alias("has_term"))
    texts = joined_text(rows, ["todo_id", "doc_type"], F.struct("ordinal", "part"), F.col("part"),
                        F.floor(F.col("ordinal") / 512), "；", "found")
    passed = passed_checks(attachments)
    return (texts.join(flags, ["todo_id", "doc_type"]).join(passed, ["todo_id", "doc_type"], "left")
            .select("todo_id", "doc_type", "has_name", "has_term",
                    F.concat_ws("；", F.nullif("found", F.lit("")), "passed").alias("verified")))


def review_table(checklist: DataFrame, uploaded: DataFrame, attachments: DataFrame,
                 rules: list[Rule]) -> DataFrame:
    """One row per request and item with basis, material state and verification result."""
    if "legal_person" in uploaded.columns:
        attachments = attachments.join(uploaded.select("todo_id", F.col("legal_person").alias("system_person")), "todo_id", "left")
        uploaded = uploaded.drop("legal_person")
    rule = F.col("rule_id")
    basis = F.coalesce(*[F.when(rule == r.id, F.lit(r.requirement or r.verify or r.name)) for r in rules], F.col("name"))
    kind = F.coalesce(*[F.when(rule == r.id, F.lit(r.check_type)) for r in rules], F.lit(""))
    need = required_of(rule)
    rows = (checklist.filter("not (rule_id = 'A13' and status = 'skip')")
            .join(uploaded, "todo_id", "left")
            .withColumn("__type", need["type"]).withColumn("__label", need["label"]))
    rows = rows.join(verification(attachments).withColumnRenamed("doc_type", "__type"), ["todo_id", "__type"], "left")
    given = F.array_contains(F.coalesce("classified_materials", F.array().cast("array<string>")), F.col("__type"))
    given = F.coalesce(given, F.lit(False))
    status, detail = F.col("status"), blank(F.col("detail"))
    note = (
        F.when(F.col("__type") == "legal_person_id", F.when(F.col("has_name") & F.col("has_term"), "已脱敏")
               .when(F.col("has_name"), "已脱敏，仅正面缺背面").when(F.col("has_term"), "已脱敏，仅背面缺正面")
               .otherwise("未脱敏，打码识别失败"))
        .when(F.col("verified").isNull(), "原样+未OCR").otherwise("原样"))
    material = (
        F.when(rule == "E2", F.when(F.col("has_files"), "已提交（仅文件名核查）").otherwise("材料未上传"))
        .when(rule == "A08", F.when(F.col("financial_submitted"), "已提交（年度及审计情况待人工核查）")
              .when(~F.col("financial_submitted"), "材料未上传").otherwise("上传状态未确认"))
        .when(F.col("__type").isNull(), "无需提交材料")
        .when(given, say("✓已提交：", F.col("__label"), "（", note, "）"))
        .when(status == "manual", "上传异常（见核验结果列）")
        .when((status == "skip") & (detail != ""), detail).otherwise("材料未上传"))
    seen = F.when(given, F.nullif("verified", F.lit("")))
    why = F.coalesce(F.nullif(F.regexp_extract(detail, "【(.+?)】", 1), F.lit("")), detail)
    result = (
        F.when(rule == "A08", F.when(F.col("financial_submitted"), detail).when(
            ~F.col("financial_submitted"), "缺少经审计的上年度财报；请补交后转人工核查，不以公开财务数据替代。").otherwise(detail))
        .when(status == "manual", F.coalesce(seen, detail))
        .when(status == "skip", detail)
        .when((status == "fail") & (detail != "") & seen.isNull(), why)
        .when(kind == "qichacha", F.coalesce(F.nullif(detail, F.lit("")), F.lit("无核验数据")))
        .when(kind.isin("auto", "skip"), F.coalesce(F.nullif(detail, F.lit("")), F.lit("无需核验")))
        .otherwise(F.coalesce(seen, F.lit("无核验数据"))))
    return rows.select("todo_id", "rule_id", "position", "name", "status", basis.alias("basis"),
                       material.alias("material"), result.alias("verification"))
