"""The checklist: one row per request and applicable rule.

A request has at most as many items as the catalogue has rules, so the list is
built as one array per request in the same projection that evaluates the rules,
and exploded after it. The explode keeps the partitioning by request, so every
later step per request needs no further shuffle of the checklist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import short_number
from ..functions.ordering import unnested
from ..functions.outcome import say
from ..functions.text import blank
from .financial import assessment_detail, year_status
from .routing import applies, in_review_order, rule_position
from .rules import Rule, with_verdicts


def _financial_item(as_of: Column) -> tuple[Column, Column]:
    """Status and detail from the titles of the uploads."""
    submitted = F.coalesce("financial_submitted", F.lit(False))
    years = F.coalesce("financial_years", F.array().cast("array<int>"))
    state = year_status(submitted, years, as_of)
    required = (F.year(as_of) - 1).cast("string")
    shown = F.array_join(F.transform(years, lambda y: F.concat(y.cast("string"), F.lit("年"))), "、")
    detail = (
        F.when(state == "mismatch", say(
            "财报材料标题显示", shown, "，非应提交的上年度", required, "年；缺少经审计的上年度财报"))
        .when(state == "missing", assessment_detail(
            F.array().cast("array<string>"), F.lit(False), as_of))
        .when(state == "matched", say(
            "财报材料标题年度为上年度", required, "年；仍需人工核验三表完整性及审计意见"))
        .otherwise(say("已提交财报材料，但标题未显示明确年度，无法确认是否为上年度", required,
                       "年；转人工核验三表完整性及审计意见")))
    return F.when(state.isin("mismatch", "missing"), "fail").otherwise("manual"), detail


def _file_item(files: Column, found: str, note: str, missing: str) -> tuple[Column, Column]:
    return (F.when(files.isNotNull(), "manual").otherwise("fail"),
            F.coalesce(say(found, files, note), F.lit(missing)))


def _conflict(rule_id: str) -> Column:
    code = fixed.ISO_CODE_BY_RULE.get(rule_id)
    if code is None:
        return F.lit(None).cast("string")
    hit = F.try_element_at(F.filter(
        "iso_conflicts", lambda c: c["expected_code"] == code), F.lit(1))
    return say("上传异常：文件「", hit["file"], "」被传到「", hit["position"], "」位置（文件名编号 ",
               hit["actual_code"], " 与位置 ", hit["expected_code"], " 不符），疑似重复上传/传错位置，需人工核验")


def _material_item(rule: Rule) -> tuple[Column, Column]:
    ok = F.col(f"ok_{rule.id}")
    lacking = F.lit("缺少" + (rule.requirement or f"{rule.id} {rule.name}"))
    if rule.id == "C1_05":
        why = blank(F.col("production_license_reason"))
        lacking = F.concat(lacking, F.when(why != "", say("【", why, "】")).otherwise(""))
    conflict = _conflict(rule.id)
    present = ("pending", f"材料已上传；待核验：{rule.verify}") if rule.verify else ("pass", "材料已上传")
    status = F.when(ok, present[0]).when(conflict.isNotNull(), "manual").otherwise("fail")
    detail = F.when(ok, present[1]).otherwise(F.coalesce(conflict, lacking))
    skip = {
        "A13": (F.coalesce("is_inspection", F.lit(False)), "非检验检测类供应商，不需要检验检测资质"),
        "C1_05": (F.coalesce("needs_production_license", F.lit(False)),
                  "无需生产许可证（经营范围不涉及强制许可/认证产品）"),
    }.get(rule.id)
    if skip:
        needed, reason = skip
        return F.when(needed, status).otherwise("skip"), F.when(needed, detail).otherwise(reason)
    return status, detail


def _auto_item(rule: Rule) -> tuple[Column, Column]:
    ok = F.col(f"ok_{rule.id}")
    good, bad = F.lit("通过"), F.lit("未达标")
    if rule.id == "C1_01":
        capital = short_number(F.coalesce("registered_capital", F.lit(0.0)))
        good = say("注册资本", capital, "万元，达到500万元要求")
        bad = say("注册资本", capital, "万元，未达到500万元要求")
    return F.when(ok, "pass").otherwise("fail"), F.when(ok, good).otherwise(bad)


def _registry_item(rule: Rule) -> tuple[Column, Column]:
    ok, seen = F.col(f"ok_{rule.id}"), F.coalesce("tyc_checked", F.lit(False))
    return (
        F.when(ok, "pass").when(seen, "fail").otherwise("pending"),
        F.when(ok, "天眼查初判通过（无处罚/失信记录）").when(seen, "天眼查显示存在处罚/失信记录，需人工复核")
        .otherwise(f"天眼查无数据；待核验：{rule.verify or rule.name}"))


def _item(rule: Rule, as_of: Column) -> tuple[Column, Column]:
    if rule.id == "A08":
        return _financial_item(as_of)
    if rule.id == "E2":
        return _file_item(F.col("performance_files"), "已提交疑似过往业绩证明：",
                          "；仅按文件名确认提交，材料真实性及业绩内容转人工核查",
                          "缺少过往业绩证明（如运输/承运合同、业绩清单或履约证明）")
    if rule.id == "E1":
        return _file_item(F.col("transport_files"), "已提交疑似道路运输许可证或无船承运证明：",
                          "；需OCR核验证书类型和有效期，无法识别时转人工核查", "缺少道路运输许可证或无船承运证明")
    return {"auto": _auto_item, "qichacha": _registry_item}.get(rule.check_type, _material_item)(rule)


def _verify_text(rule: Rule, status: Column, detail: Column) -> Column:
    """What this item adds to the points to verify at stage 1 (null: nothing)."""
    if rule.id in ("A08", "E1", "E2"):
        return F.when(status == "manual", detail)
    if rule.check_type == "qichacha":
        return (F.when(status == "fail", F.concat(F.lit(rule.name + "："), detail))
                .when(status == "pending", F.lit(rule.verify or rule.name)))
    if rule.check_type == "material" and rule.verify:
        return F.when(status == "pending", F.lit(rule.verify))
    return F.lit(None).cast("string")


def checklist_items(suppliers: DataFrame, rules: list[Rule], as_of: str,
                    keep: list[str] | None = None) -> DataFrame:
    """K1-K3 over routed suppliers (the profile plus rule_sets, dropped_rules, financial_submitted,
    financial_years, performance_files, transport_files): `items`, one array per request.

    `role` says how a failed item counts: auto (hard rule), missing (material
    lacking) or neither; `verify` is the point to verify, if any.
    """
    day = F.lit(as_of).cast("date")
    judged = with_verdicts(suppliers, rules)
    items = []
    for rule in in_review_order(rules):
        if rule.check_type in ("skip", ""):
            continue
        status, detail = _item(rule, day)
        role = ("auto" if rule.check_type == "auto"
                else "missing" if rule.id in ("A08", "E1", "E2") or rule.check_type == "material" else None)
        files = {"E1": "transport_files", "E2": "performance_files"}.get(rule.id)
        items.append(F.when(applies(rule), F.struct(
            F.lit(rule.id).alias("rule_id"),
            rule_position(rule, rules).cast("int").alias("position"),
            F.lit(rule.name).alias("name"),
            F.lit(rule.check_type).alias("check_type"),
            F.lit(rule.review_order if rule.review_order is not None else 99).alias("review_order"),
            F.lit(rule.requirement or f"{rule.id} {rule.name}").alias("requirement"),
            status.alias("status"),
            detail.alias("detail"),
            F.when(status == "fail", F.lit(role).cast("string")).alias("role"),
            _verify_text(rule, status, detail).alias("verify"),
            (F.col(files).isNotNull() if files else F.lit(False)).alias("has_files"),
        )))
    return judged.select(*(keep or ["todo_id"]), F.array_compact(F.array(*items)).alias("items"))


def checklist_flags(suppliers: DataFrame, rules: list[Rule], as_of: str, keep: list[str]) -> DataFrame:
    """What the checklist decides, without its texts: `reject`, `manual`, and how many items are `failed` and `to_check`.

    Statuses are plain conditions, so everything stays in generated code and no item is built.
    """
    day = F.lit(as_of).cast("date")
    judged = with_verdicts(suppliers, rules)
    no, zero = F.lit(False), F.lit(0)
    reject, manual, failed, to_check = no, no, zero, zero
    for rule in in_review_order(rules):
        if rule.check_type in ("skip", ""):
            continue
        status, here = _item(rule, day)[0], applies(rule)
        fails, asks = here & (status == "fail"), here & (status == "manual")
        if rule.check_type in ("auto", "material") or rule.id in ("A08", "E1", "E2"):
            reject = reject | F.coalesce(fails, no)
        if rule.id in ("A08", "E1", "E2"):
            manual = manual | F.coalesce(asks, no)
        elif rule.check_type == "qichacha":
            manual = manual | F.coalesce(here & status.isin("fail", "pending"), no)
        elif rule.check_type == "material" and rule.verify:
            manual = manual | F.coalesce(here & (status == "pending"), no)
        failed = failed + F.coalesce(fails.cast("int"), zero)
        to_check = to_check + F.coalesce(asks.cast("int"), zero)
    return judged.select(*keep, reject.alias("reject"), manual.alias("manual"), failed.alias("failed"), to_check.alias("to_check"))


def checklist_statuses(suppliers: DataFrame, rules: list[Rule], as_of: str, keep: list[str]) -> DataFrame:
    """`items` with rule_id, name, status and has_files only: enough for what is missing."""
    day = F.lit(as_of).cast("date")
    judged = with_verdicts(suppliers, rules)
    items = []
    for rule in in_review_order(rules):
        if rule.check_type in ("skip", ""):
            continue
        files = {"E1": "transport_files", "E2": "performance_files"}.get(rule.id)
        items.append(F.when(applies(rule), F.struct(
            F.lit(rule.id).alias("rule_id"), F.lit(rule.name).alias("name"), _item(rule, day)[0].alias("status"),
            (F.col(files).isNotNull() if files else F.lit(False)).alias("has_files"))))
    return judged.select(*keep, F.array_compact(F.array(*items)).alias("items"))


def build_checklist(suppliers: DataFrame, rules: list[Rule], as_of: str) -> DataFrame:
    """The checklist in long form, one row per (request, rule)."""
    return long_form(checklist_items(suppliers, rules, as_of))


def verify_items(requests: DataFrame) -> DataFrame:
    """Missing items and points to verify, derived again after enrichment.

    A missing rule counts only while its item is still `fail`.
    """
    mark = "；待核验："

    def derived(item: Column) -> Column:
        status, detail = item["status"], item["detail"]

        def after(text: str) -> Column:
            return F.substr(detail, F.instr(detail, text) + len(text))

        point = (
            F.when(status == "pending", F.when(detail.contains(mark), after(mark)).otherwise(detail))
            .when((status == "partial") & detail.contains("；"), after("；"))
            .when(status.isin("fail", "manual"), detail))
        cured = (item["role"] == "missing") & (status != "fail")
        return (item.withField("verify", F.nullif(point, F.lit("")))
                .withField("role", F.when(cured, F.lit(None).cast("string")).otherwise(item["role"])))

    return requests.withColumn("items", F.transform("items", derived))


def long_form(requests: DataFrame) -> DataFrame:
    """The checklist as one row per (request, rule)."""
    return unnested(requests, ["todo_id"], F.col("items"), "item").select("todo_id", "item.*")
