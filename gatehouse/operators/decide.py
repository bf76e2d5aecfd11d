"""Decision and opinion of each request, folded from its checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import short_number
from ..functions.outcome import say
from ..functions.text import blank, numbered, squeeze


def decide(checklist: DataFrame) -> DataFrame:
    """A1: a failed hard rule or a missing material rejects; else any point to verify is manual."""
    return checklist.groupBy("todo_id").agg(
        F.bool_or(F.coalesce(F.col("role").isin("auto", "missing"), F.lit(False))).alias("__reject"),
        F.bool_or(F.col("verify").isNotNull()).alias("__manual"),
    ).select("todo_id", verdict(F.col("__reject"), F.col("__manual")).alias("decision"))


def decide_items(requests: DataFrame) -> DataFrame:
    """A1 on requests that still carry their items as an array: no explode, no shuffle."""
    reject = F.exists("items", lambda i: F.coalesce(i["role"].isin("auto", "missing"), F.lit(False)))
    manual = F.exists("items", lambda i: i["verify"].isNotNull())
    return requests.withColumn("decision", verdict(reject, manual))


def verdict(reject: Column, manual: Column) -> Column:
    return F.when(reject, "reject").when(manual, "manual").otherwise("recommend")


def opinion_stage2(checklist: DataFrame, suppliers: DataFrame) -> DataFrame:
    """A2 + W4: decision and numbered opinion text of each request, from the long checklist.

    `suppliers` gives todo_id, type_desc, registered_capital, has_financial_report
    and production_license_reason, one row per request. What is collected per
    request are checklist items (at most one per rule), never uploads.
    """
    folded = checklist.groupBy("todo_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "rule_id", "name", "review_order", "requirement", "role", "verify"))).alias("items"))
    joined = folded.join(suppliers.select("todo_id", *OPINION_COLUMNS), "todo_id", "left")
    return opinion_items(joined).select("todo_id", "decision", "opinion")


OPINION_COLUMNS = ["type_desc", "registered_capital", "has_financial_report", "production_license_reason"]


def opinion_items(requests: DataFrame) -> DataFrame:
    """Adds decision and opinion to requests that carry their items as an array."""
    def where(test) -> Column:
        return F.filter("items", lambda i: F.coalesce(test(i), F.lit(False)))

    def ordered(items: Column) -> Column:
        return F.array_sort(F.transform(items, lambda i: F.struct(
            i["review_order"].alias("review_order"), i["position"].alias("position"), i["name"].alias("name"),
            i["rule_id"].alias("rule_id"), i["requirement"].alias("requirement"))))

    joined = requests.select(
        "*", where(lambda i: i["role"] == "auto").alias("hard"),
        ordered(where(lambda i: (i["role"] == "missing") & i["name"].contains("ISO"))).alias("iso"),
        ordered(where(lambda i: (i["role"] == "missing") & ~i["name"].contains("ISO"))).alias("other"),
        where(lambda i: i["verify"].isNotNull()).alias("points"))
    lacks = (F.size("iso") > 0) | (F.size("other") > 0)
    reject, manual = lacks | (F.size("hard") > 0), F.size("points") > 0
    lacks_a08 = F.exists("other", lambda r: r["rule_id"] == "A08")
    asks = F.exists("points", lambda r: r["verify"].contains("经审计") | r["verify"].contains("A08"))
    capital = short_number(F.coalesce("registered_capital", F.lit(0.0)))
    why = blank(F.col("production_license_reason"))
    asks_report = ~F.coalesce("has_financial_report", F.lit(False)) & ~lacks_a08 & asks
    problems = F.transform("hard", lambda r: F.when(
        r["rule_id"] == "C1_01", say("注册资本", capital, "万元，未达到500万元要求")).otherwise(
        say(r["rule_id"], " ", r["name"], "未达标")))
    numbers = F.array_distinct(F.transform("iso", lambda r: F.concat(
        F.lit("ISO "), F.regexp_extract(r["name"], "(9001|14001|45001)", 1))))
    trader = blank(F.col("type_desc")).contains("贸易")
    iso_line = say(F.array_join(numbers, "、"), " 认证证书", F.when(
        trader, "（ISO 9001可上传代理厂家的认证，14001/45001须为贵司自己的认证；均须在有效期内）"
    ).otherwise("（须为贵司认证且在有效期内）"))
    others = F.transform("other", lambda r: (
        F.when(r["rule_id"] == "A08", F.lit(fixed.A08_MISSING))
        .when((r["rule_id"] == "C1_05") & (why != ""), say(r["requirement"], "【", why, "】"))
        .otherwise(r["requirement"])))
    supplements = F.concat(
        F.array_compact(F.array(F.when(F.size("iso") > 0, iso_line))), others,
        F.array_compact(F.array(F.when(lacks & asks_report,
                                       F.lit("上年度经审计的财报（2026年须提交2025年财报）")))))
    none = F.array().cast("array<string>")
    reject_lines = F.concat(
        F.array(F.lit("退回。")),
        F.when(F.size("hard") > 0, F.concat(F.array(F.lit("存在问题：")), numbered(problems))).otherwise(none),
        F.when(lacks, F.concat(
            F.array(F.lit("请补充资质文件：")), numbered(supplements, start=F.size("hard") + 1))).otherwise(none))
    points = F.array_distinct(F.transform("points", lambda r: r["verify"]))
    manual_lines = F.concat(
        F.array(F.lit("转人工复核。材料齐全，以下核验点需人工/后续自动核验：")),
        F.when(asks_report, F.array(F.lit("  0. 需补充：经审计的上年度财报（2026年须提交2025年财报）"))).otherwise(none),
        numbered(points))
    decision = verdict(reject, manual)
    opinion = (F.when(decision == "reject", F.array_join(reject_lines, "\n"))
               .when(decision == "manual", F.array_join(manual_lines, "\n"))
               .otherwise(fixed.OPINION_RECOMMEND))
    return joined.select(*requests.columns, decision.alias("decision"), opinion.alias("opinion"))


def append_issues(opinion: Column, decision: Column, registry_issues: Column, ocr_issues: Column) -> Column:
    """Registry findings are added only to a rejection, OCR findings always."""
    registry = F.when((decision == "reject") & (F.size(registry_issues) > 0), F.concat(
        F.lit("另经企查查核验发现（请一并核实）：\n"), F.array_join(numbered(registry_issues), "\n")))
    ocr = F.when(F.size(ocr_issues) > 0, F.concat(
        F.lit("另经资质文件OCR核验发现：\n"), F.array_join(numbered(ocr_issues), "\n")))
    return F.concat_ws("\n\n", opinion, registry, ocr)


def decision_summary(results: DataFrame) -> DataFrame:
    """A4: requests per decision with their issue totals."""
    return results.groupBy("decision").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.size(F.coalesce("qcc_issues", F.array().cast("array<string>")))).alias("registry_issues"),
        F.sum(F.size(F.coalesce("ocr_issues", F.array().cast("array<string>")))).alias("ocr_issues"))


def opinion_final(requests: DataFrame) -> DataFrame:
    """A3: the text sent back, as a projection of the reviewed request.

    Needs todo_id, items, decision, opinion, skip_reason, domestic_tip and
    financial_status (matched / mismatch / missing / unknown).
    """
    def lacks(item: Column) -> Column:
        return F.coalesce(squeeze(item["detail"]).rlike(fixed.MISSING_DETAIL), F.lit(False))

    def where(test) -> Column:
        return F.filter("items", lambda i: F.coalesce(test(i), F.lit(False)))

    def plain(items: Column) -> Column:
        return F.transform(items, lambda i: F.struct(
            i["rule_id"].alias("rule_id"), i["name"].alias("name"), blank(i["detail"]).alias("detail")))

    joined = requests.select(
        "todo_id", "decision", "opinion", "skip_reason", "domestic_tip", "financial_status",
        F.coalesce(F.size("items") > 0, F.lit(False)).alias("has_items"),
        plain(where(lambda i: (i["status"] == "fail") & lacks(i))).alias("lacking"),
        plain(where(lambda i: (i["status"] == "fail") & ~lacks(i))).alias("other"),
        plain(where(lambda i: i["status"].isin("pending", "partial", "manual"))).alias("open"),
        F.exists("items", lambda i: (i["rule_id"] == "A08") & (i["status"] != "skip")).alias("has_a08"))
    needs_report = F.coalesce("has_a08", F.lit(False)) & F.coalesce(
        F.col("financial_status").isin("missing", "mismatch"), F.lit(False))
    none = F.array().cast("array<string>")
    iso_rules = list(fixed.ISO_CODE_BY_RULE)
    iso_names = F.array_distinct(F.transform(
        F.filter("lacking", lambda r: r["rule_id"].isin(iso_rules)),
        lambda r: F.coalesce(*[F.when(r["rule_id"] == rule, F.lit(f"ISO {code}"))
                               for rule, code in fixed.ISO_CODE_BY_RULE.items()])))

    def supplement(r: Column) -> Column:
        template = F.coalesce(*[F.when(r["rule_id"] == rule, F.lit(text))
                                for rule, text in fixed.SUPPLEMENTS.items()])
        fallback = F.coalesce(F.nullif(F.trim(r["detail"]), F.lit("")), F.concat(r["name"], F.lit("相关材料")))
        return (F.when(r["rule_id"] == "A07", "缺少" + fixed.SUPPLEMENTS["A07"])
                .when(r["detail"].startswith("缺少"), r["detail"])
                .otherwise(F.concat(F.lit("缺少"), F.coalesce(template, fallback))))

    def tagged(r: Column) -> Column:
        return say("[", r["rule_id"], "]", r["name"], "：")

    def clipped(r: Column) -> Column:
        text = F.coalesce(F.nullif(r["detail"], F.lit("")), F.lit("需人工核验"))
        return F.concat(tagged(r), F.when(F.length(text) > 100, F.concat(
            F.substring(text, 1, 100), F.lit("…"))).otherwise(text))

    def without_report(items: str) -> Column:
        return F.filter(items, lambda r: ~(needs_report & (r["rule_id"] == "A08")))

    supplements = F.array_distinct(F.concat(
        F.when(F.size(iso_names) > 0, F.array(F.concat(
            F.array_join(iso_names, "、"), F.lit(" 体系认证证书（须为你公司认证且在有效期内）")))).otherwise(none),
        F.transform(F.filter(without_report("lacking"), lambda r: ~r["rule_id"].isin(iso_rules)), supplement),
        F.when(needs_report, F.array(F.lit(fixed.A08_MISSING))).otherwise(none),
        F.transform(without_report("other"), lambda r: F.concat(
            tagged(r), r["detail"], F.lit("；请整改并提交符合要求的材料")))))
    joined = joined.select("*", supplements.alias("__supplements"), F.transform(
        without_report("open"), clipped).alias("__open"), F.concat(
        F.transform("other", clipped), F.transform("open", clipped)).alias("__reasons"))
    supplements, open_items = F.col("__supplements"), F.col("__open")
    back = F.concat_ws(
        "\n",
        F.when(F.size(supplements) > 0, F.concat(
            F.lit("退回。"), F.array_join(numbered(supplements, indent=""), "；"), F.lit("。补充后重新提交。"))
        ).otherwise("退回。具体见上方审查报告。"),
        F.when(F.size(open_items) > 0, F.concat(
            F.lit("另需整改/核实："), F.array_join(open_items, "；"), F.lit("。"))))
    reasons = F.when(F.size("__reasons") > 0, F.col("__reasons")).otherwise(F.array(F.lit("部分审核项需人工核验")))
    manual = F.concat_ws("\n", F.when(needs_report, "需补充：经审计的上年度财报。"),
                         F.concat(F.lit("转人工。"), F.array_join(reasons, "；")))
    decision = F.coalesce("decision", F.lit("manual"))
    text = (
        F.when((F.size("lacking") > 0) | needs_report | (decision == "reject"), back)
        .when((F.size("other") > 0) | (F.size("open") > 0) | (decision == "manual"), manual)
        .otherwise("同意。各项审核均通过，建议后续常规管理。"))
    tip = F.nullif(F.col("domestic_tip"), F.lit(""))
    stage2 = F.nullif(F.col("opinion"), F.lit(""))
    final = (
        F.when(decision == "skip", F.concat_ws("\n\n", F.coalesce(
            stage2, F.col("skip_reason"), F.lit("该供应商不适用标准审批流程")), tip))
        .when(~F.col("has_items"), F.when(decision == "manual", F.coalesce(
            stage2, F.lit("转人工。缺少核验清单，无法确认审核完成。"))).otherwise(
            "转人工。缺少核验清单，无法确认审核完成。"))
        .otherwise(F.concat_ws("\n\n", text, tip)))
    return joined.select("todo_id", "decision", final.alias("final_opinion"))
