"""Rules, routing, classification, checklist, enrichment and opinions."""

import pytest
from pyspark.sql import functions as F

from gatehouse import schemas
from gatehouse.operators import checklist, classify, decide, financial, ocr, profile, review, routing
from gatehouse.operators import rules as rule_ops
from gatehouse.plans.redecision import checklist_of, prepare_suppliers, redecide, results_of, review_stage1

from .conftest import AS_OF
from .helpers import applications, frame, materials, suppliers


def by(rows, key="todo_id"):
    return {r[key]: r for r in rows}


# --- rules --------------------------------------------------------------------------
def test_rule_predicates(spark):
    rows = suppliers(spark, [{"todo_id": "a", "registered_capital": 499.99}, {"todo_id": "b", "registered_capital": 500.0},
                             {"todo_id": "c", "registered_capital": 500.01}, {"todo_id": "d"}])
    texts = ["registered_capital >= 500", "no_such_column = 1", "reflect('java.lang.System', 'exit', 1) = ''",
             "1/0 > 0", "java_method('a', 'b') = ''", "registered_capital", "((", "(select 1) = 1", "cast('x' as int) = 1",
             "coalesce(has_violation_3y, true) <=> false"]
    catalogue = [rule_ops.Rule("p", "domestic", i, f"R{i}", "", None, "auto", t, None, None, None) for i, t in enumerate(texts)]
    got = {(r.todo_id, r.rule_id): r.ok for r in rule_ops.evaluate_rules(rows, catalogue).collect()}
    assert [got[k, "R0"] for k in "abcd"] == [False, True, True, False]
    assert not any(ok for (_, rule), ok in got.items() if rule != "R0")


def test_catalogue_audit(spark, rules):
    table = rule_ops.rules_table(spark, rules)
    assert table.count() == len(rules) == 34
    columns = suppliers(spark, []).columns
    assert rule_ops.audit_rules(table, columns).count() == 0
    bad = table.filter("id = 'A01'").unionByName(table.filter("id in ('A01', 'A02')")).withColumn(
        "predicate", F.when(F.col("id") == "A02", F.lit(None)).otherwise("has_nothing = 1"))
    faults = {(r.id, r.fault) for r in rule_ops.audit_rules(bad, columns).collect()}
    assert faults == {("A01", "duplicate id"), ("A02", "missing predicate"), ("A01", "unknown column")}


# --- routing ------------------------------------------------------------------------
ROUTES = {
    "carrier": ("承运商", "", {"A01", "E1", "E2"}, {"A07"}),
    "carriers": ("运输商/承运商", "", {"E1", "E2"}, {"A07"}),
    "dealer_carrier": ("经销商/承运商", "", {"D1_03", "A07"}, {"E1", "E2"}),
    "mixed": ("服务商/代理商/承运商", "", {"D1_03", "A07"}, {"E1"}),
    "service": ("服务商", "", {"A01", "A07"}, {"E2", "D1_03"}),
    "service_trade": ("服务商", "景观规划、造价咨询、工期管理；仪表选型、仪表采购；仪表和备件进出口；销售照明电器", {"D1_03"}, {"E1"}),
    "maker_trade": ("其他", "水泵生产、装配、销售；技术进出口", {"C1_01", "C1_02", "C1_03", "C1_04", "D1_06"}, {"D1_03", "D1_04", "D1_05"}),
    "solar": ("其他服务商", "储能柜制造；逆变器制造；电子元件销售；货物进出口", {"C1_02"}, {"D1_03"}),
    "freight_service": ("服务商", "国际货运代理；恒温库房出租；无船承运。", {"A01", "E1", "E2"}, {"A07", "D1_03"}),
    "freight_agent": ("代理商", "国际货运代理；恒温库房出租；无船承运。", {"A01", "E1", "E2"}, {"A07", "D1_03"}),
    "freight_other": ("其他", "国际货运代理；恒温库房出租；无船承运。", {"A01", "E1", "E2"}, {"A07", "D1_03"}),
    "freight_blank": ("", "国际货运代理；恒温库房出租；无船承运。", {"A01", "E1", "E2"}, {"A07", "D1_03"}),
    "phrase1": ("服务商", "国际货物运输代理；国内集装箱货物运输代理", {"E1", "E2"}, set()),
    "phrase2": ("服务商", "道路货物运输；普通货运", {"E1", "E2"}, set()),
    "phrase3": ("服务商", "网络货运；仓储服务", {"E1", "E2"}, set()),
    "logistics": ("物流服务商", "海上国际货物运输代理；国内贸易代理；茶叶销售；无船承运业务", {"E1", "E2"}, {"A07", "D1_03"}),
    "warehouse_logistics": ("仓储服务商、物流服务商", "代办空运、海运国际运输代理业务", {"E1", "E2"}, {"A07", "D1_03"}),
    "warehouse": ("仓储服务商", "仓储服务；货架租赁", {"A07"}, {"E1"}),
    "bidding": ("服务商", "招标代理；网站维护；技术服务", set(), {"E1", "E2"}),
    "agent": ("代理商", "灯具销售代理；货物进出口", {"D1_03"}, {"E1"}),
    "explicit": ("物流服务商/经销商", "国际货运代理；无船承运", {"D1_03"}, {"E1"}),
}


def test_rule_set_routing(spark, rules):
    rows = suppliers(spark, [{"todo_id": k, "sup_type": t, "busi_scope": s} for k, (t, s, *_) in ROUTES.items()]
                     + [{"todo_id": "abroad", "sup_type": "贸易商", "is_foreign": True, "is_overseas": True}])
    routed = routing.route_rule_sets(rows)
    found = {}
    for r in routing.applicable_rules(routed, rules).orderBy("position").collect():
        found.setdefault(r.todo_id, []).append(r.rule_id)
    for case, (_, _, wanted, unwanted) in ROUTES.items():
        ids = found[case]
        assert wanted <= set(ids) and not unwanted & set(ids), (case, ids)
        assert len(ids) == len(set(ids))
    assert set(found["abroad"]) == {"B01", "D2_01", "D2_02", "D2_03", "D2_04"}
    desc = by(routed.collect())
    assert desc["service_trade"].type_desc == "境内·经销商/服务商（经营范围补充识别）"
    assert "厂家" in desc["maker_trade"].type_desc
    assert desc["freight_service"].type_desc == "境内·运输/承运商（经营范围识别）"
    assert desc["logistics"].type_desc == "境内·运输/承运商"
    inferred = by(routed.select("todo_id", profile.infer_types(F.col("busi_scope"), F.col("type_desc")).alias("t")).collect())
    assert inferred["service_trade"].t == "贸易商/经销商、服务商" and inferred["logistics"].t == "运输/承运商"


def test_stage_routes(spark):
    rows = suppliers(spark, [
        {"todo_id": "f1", "is_foreign": True, "is_hmt": False}, {"todo_id": "f2", "is_foreign": True, "is_hmt": False},
        {"todo_id": "h", "is_foreign": False, "is_hmt": True},
        {"todo_id": "s", "sup_type": "云服务商", "is_foreign": False, "is_hmt": False},
        {"todo_id": "n", "sup_type": "厂家", "is_foreign": False, "is_hmt": False}]).withColumn(
        "bill_type", F.when(F.col("todo_id") == "f1", "P0701").otherwise("P0704")).withColumn("bill_name", F.lit("合作意向审批"))
    one = by(routing.route_stage1(rows).collect())
    two = by(routing.route_stage2(rows).collect())
    assert [one[k].route_decision for k in ("f1", "f2", "h", "s", "n")] == ["reject", "manual", "manual", "manual", None]
    assert [two[k].route_decision for k in ("f1", "f2", "h", "s", "n")] == ["skip", "skip", "manual", "skip", None]
    assert one["f2"].route_opinion == "转人工复核。国外供应商（审查类型：合作意向审批），需人工审核。"
    assert two["s"].route_opinion == "不适用。该供应商属于集团独有类别（云服务商），审查标准复杂，需转人工处理。"


def test_profile(spark):
    base = spark.createDataFrame([
        ("1", "P0704", "短名", None, None, "1500", None, "厂家", "销售（不含危险化学品）；电梯制造", 1, "中国香港", '{"penaltyCount": 2, "creditCode": "X"}', "2015-03-01"),
        ("2", "P0701", "", None, None, "bad", "3", "经销商", "食品销售", 0, "China", "{broken", "x"),
    ], "todo_id string, bill_type string, sup_short string, credit_code string, org_code string, reg_capl string, fact_capl string, "
       "sup_type string, busi_scope string, overseas_code int, country_name string, tyc_info string, found_time string")
    for name in ("legal_person", "company_type", "state", "money_type", "office_addr", "home_addr"):
        base = base.withColumn(name, F.lit(None).cast("string"))
    base = base.withColumn("is_in_indy", F.lit(0))
    mats = materials(spark, [{"todo_id": "1", "file_name": "营业执照.png"}, {"todo_id": "1", "file_name": "CMA证书.pdf"}])
    rollup = classify.material_rollup(classify.with_type_flags(mats)).withColumn(
        "iso_conflicts", F.array().cast(f"array<{schemas.CONFLICT}>"))
    got = by(profile.supplier_profile(base, rollup, AS_OF).collect())
    one, two = got["1"], got["2"]
    assert (one.registered_capital, one.established_years, one.social_credit_code) == (1500.0, 11, "X")
    assert (one.is_hmt, one.is_foreign, one.is_cooperation, one.has_business_license, one.has_inspection_cert) == (True, False, True, True, True)
    assert (one.needs_production_license, one.production_license_reason) == (True, "生产许可证（经营范围涉及「电梯」）")
    assert (one.tyc_checked, one.has_violation_3y, one.is_dishonest) == (True, True, False)
    assert (two.registered_capital, two.established_years, two.tyc_checked, two.needs_production_license) == (0.0, 0, False, False)
    tip = by(profile.with_domestic_tip(spark.createDataFrame(
        [("1", True, "中国"), ("2", False, "中国")], "todo_id string, is_overseas boolean, country_name string")).collect())
    assert tip["1"].domestic_tip.startswith("提示：") and tip["2"].domestic_tip == ""


# --- classification ------------------------------------------------------------------
UPLOADS = {
    "alias1": ("环境管理.jpg", "环境管理体系认证证书图片", ["iso14001"]),
    "alias2": ("环境管理.jpg", " 环境管理体系认证证书 图片 ", ["iso14001"]),
    "alias3": ("环境管理.jpg", "其他文件", ["iso14001"]),
    "alias4": ("scan-07.png", "环境管理体系认证证书扫描件", ["iso14001"]),
    "tax": ("纳税等级证明（云泽）.pdf", "其他文件", ["tax_credit"]),
    "rating": ("AA级信用等级证书.pdf", "其他文件", []),
    "rating2": ("企业信用等级证明.pdf", "其他文件", []),
    "cnas1": ("云泽仪表厂-质量管理体系认证证书（CNAS认可）.png", "质量管理体系认证证书", ["iso9001"]),
    "cnas2": ("云泽仪表厂-职业健康安全管理体系认证证书（CNAS认可）.jpg", "健康安全管理体系认证证书图片", ["iso45001"]),
    "cma": ("检验检测机构资质 CMA.pdf", "其他", ["inspection_cert"]),
    "clash": ("ISO14001.png", "职业健康安全管理体系认证证书", ["iso14001"]),
    "slot_words": ("执照.png", "生产许可证图片", []),
    "wide": ("ＩＳＯ９００１证书.png", "其他", ["iso9001"]),
}


def test_classification(spark):
    mats = materials(spark, [{"todo_id": k, "file_name": n, "type_name": s} for k, (n, s, _) in UPLOADS.items()])
    got = by(classify.classify_materials(mats).collect())
    for case, (_, _, types) in UPLOADS.items():
        assert got[case].types == types, (case, got[case].types)
    assert (got["clash"].slot_code, got["clash"].name_code) == ("45001", "14001")
    # the readable form with a theta join gives the same keyword types
    words = classify.keyword_dimension(spark)
    text = F.lower(F.concat_ws(" ", "file_name"))
    joined = (mats.join(words, text.contains(F.lower("keyword"))).groupBy("todo_id")
              .agg(F.array_sort(F.collect_set("type")).alias("t")))
    compiled = by(classify.classify_by_keyword(mats).select("todo_id", F.array_sort("keyword_types").alias("t")).collect())
    for row in joined.collect():
        assert compiled[row.todo_id].t == row.t
    slots = by(classify.classify_by_slot(mats).collect())
    assert slots["clash"].slot_types == ["iso45001"] and slots["rating"].slot_types == []
    names = by(classify.classify_by_name(mats).collect())
    assert names["slot_words"].name_type == "business_license" and names["tax"].name_type == "tax_credit"


def test_file_matching(spark):
    from gatehouse.operators.masking import looks_like_id_card, mask_outcomes, public_subset, with_public_flag

    mats = materials(spark, [
        {"todo_id": "a", "file_name": "旧 营业执照.jpg", "type_name": "组织机构代码证图片", "types": ["business_license"]},
        {"todo_id": "a", "file_name": "营业执照.jpg", "type_name": "营业执照副本图片", "types": ["business_license"]},
        {"todo_id": "b", "file_name": "旧 营业执照.jpg", "type_name": "组织机构代码证图片", "types": ["business_license"]},
        {"todo_id": "c", "file_name": "环境管理.jpg", "type_name": "环境管理体系认证证书图片", "types": []},
        {"todo_id": "d", "file_name": "环境管理.jpg", "type_name": "环境管理体系认证证书图片", "types": [], "file_desc": "含身份证"},
        {"todo_id": "e", "file_name": "张三.gif", "type_name": "法人代表身份证", "types": ["legal_person_id"]},
        {"todo_id": "e", "file_name": "李四.pdf", "type_name": "法人代表身份证", "types": ["legal_person_id"]},
    ])
    files = spark.createDataFrame([
        ("a", "1_旧 营业执照.jpg"), ("a", "2_营业执照.jpg"), ("b", "3_旧 营业执照.jpg"), ("c", "10_环境管理.jpg"),
        ("d", "10_环境管理.jpg"), ("e", "张三.gif"), ("e", "9_李四.pdf"), ("f", "x.png")], "todo_id string, file string")
    got = {(r.todo_id, r.file): (r.types, r.is_public) for r in with_public_flag(classify.match_files(files, mats)).collect()}
    assert got["a", "1_旧 营业执照.jpg"] == ([], False)
    assert got["a", "2_营业执照.jpg"] == (["business_license"], True)
    assert got["b", "3_旧 营业执照.jpg"] == (["business_license"], True)
    assert got["c", "10_环境管理.jpg"] == (["iso14001"], True)
    assert got["d", "10_环境管理.jpg"] == (["iso14001", "sensitive"], False)
    assert got["f", "x.png"] == ([], False)
    assert public_subset(files, mats).count() == 3
    cards = frame(spark, schemas.CARD, [{"todo_id": "e", "file": "9_李四.pdf", "card_index": 1}])
    outcomes = {r.file: r.outcome for r in mask_outcomes(files, cards, mats).collect()}
    assert outcomes == {"张三.gif": "unsupported", "9_李四.pdf": "cards"}
    looks = spark.createDataFrame([("张三.jpg",), ("0012_张三丰.png",), ("营业执照.jpg",), ("张三.pdf",)], "n string")
    assert [r.x for r in looks.select(looks_like_id_card(F.col("n")).alias("x")).collect()] == [True, True, False, False]
    sets = by(classify.id_name_sets(mats).collect(), "file_name")
    assert sets["张三.gif"].is_id_card and not sets["张三.gif"].is_other and sets["营业执照.jpg"].is_other


def test_hydrate(spark):
    mats = materials(spark, [{"todo_id": "1", "file_name": "环境管理.jpg", "type_name": "环境管理体系认证证书图片", "types": []}])
    _, sups = classify.hydrate(mats, suppliers(spark, [{"todo_id": "1", "certifications": ["ISO9001"]}]))
    row = sups.collect()[0]
    assert row.certifications == ["ISO14001", "ISO9001"] and row.classified_materials == ["iso14001"]


# --- financial -----------------------------------------------------------------------
def test_financial(spark):
    report = ["financial_report"]
    mats = materials(spark, [
        {"todo_id": "ok", "file_name": "2025年度审计报告（云泽）.pdf", "types": report}, {"todo_id": "old", "file_name": "2024年财报.pdf", "types": report},
        {"todo_id": "none", "file_name": "经审计财务报告（无年份）.pdf", "types": report},
        {"todo_id": "two", "file_name": "2024年对照财务数据.pdf", "types": report}, {"todo_id": "two", "file_name": "2025年度审计报告（云泽）.pdf", "types": report},
        {"todo_id": "title", "file_name": "财务附件.pdf", "file_title": "2024年财报", "types": report},
        {"todo_id": "far", "file_name": "2081年财报.pdf", "types": report},
        {"todo_id": "other", "file_name": "营业执照2025.png"}])
    requests = spark.createDataFrame([(k,) for k in ("ok", "old", "none", "two", "title", "far", "other", "empty")], "todo_id string")
    got = {r.todo_id: (r.status, r.title_years) for r in financial.financial_title_check(mats, requests, AS_OF).collect()}
    assert got == {"ok": ("matched", [2025]), "old": ("mismatch", [2024]), "none": ("unknown", []), "two": ("matched", [2024, 2025]),
                   "title": ("mismatch", [2024]), "far": ("mismatch", [2081]), "other": ("missing", []), "empty": ("missing", [])}
    data = spark.createDataFrame([
        ("a", "{}", None), ("b", '{"财务数据信息": [{"报告期": "2020", "资产负债率": 10}]}', True),
        ("c", '{"balance_sheet": {"result": [{"报告期": "2025-12-31"}]}, "cash_flow": {"result": []}}', True), ("d", None, False)],
        "key string, financial string, submitted boolean")
    seen = by(financial.assess_financial(data, AS_OF).collect(), "key")
    assert seen["a"].assessment.startswith("财报上传状态未确认；未取得带报告期的公开财务数据；")
    assert seen["b"].assessment.startswith("公开数据非上年度，报告期：2020；")
    assert seen["c"].periods == ["2025-12-31"] and seen["c"].assessment.startswith("已取得上年度公开财务数据")
    assert seen["d"].assessment.startswith("缺少经审计的上年度财报")


# --- checklist and opinions -----------------------------------------------------------
E2 = {
    "过往业绩证明.pdf": ("", "manual"), "运输合同.jpg": ("", "manual"), "物流服务合同.pdf": ("", "manual"),
    "履约证明.docx": ("", "manual"), "2025年业绩清单.pdf": ("", "manual"),
    "委托代理合同-某-某  双签.pdf": ("合作业绩证明文件", "manual"), "售后服务承诺书.pdf": ("合作业绩证明文件", "fail"),
    "材料.pdf": ("过往业绩证明", "fail"), "无需业绩证明声明.pdf": ("", "fail"), "运输合同模板.pdf": ("", "fail"),
}


@pytest.fixture(scope="module")
def carriers(spark, rules):
    ids = [str(i) for i in range(len(E2))] + ["none"]
    mats = materials(spark, [{"todo_id": str(i), "file_name": n, "type_name": s} for i, (n, (s, _)) in enumerate(E2.items())]
                     + [{"todo_id": "0", "file_name": "道路运输经营许可证.pdf", "types": ["transport_license"]}])
    prepared = prepare_suppliers(applications(spark, [{"todo_id": i} for i in ids]),
                                 suppliers(spark, [{"todo_id": i, "sup_type": "承运商"} for i in ids]), mats)
    return checklist.build_checklist(prepared, rules, AS_OF)


def test_proof_items(carriers):
    rows = {(r.todo_id, r.rule_id): r for r in carriers.collect()}
    for i, (name, (_, status)) in enumerate(E2.items()):
        row = rows[str(i), "E2"]
        assert row.status == status, name
        assert (name in row.detail) is (status == "manual")
    assert rows["none", "E2"].detail == "缺少过往业绩证明（如运输/承运合同、业绩清单或履约证明）"
    assert rows["none", "E1"].status == "fail" and rows["none", "E1"].detail == "缺少道路运输许可证或无船承运证明"
    assert rows["0", "E1"].status == "manual" and "道路运输经营许可证.pdf" in rows["0", "E1"].detail


def test_checklist_items(spark, rules):
    apps = applications(spark, [{"todo_id": k} for k in "ab"])
    sups = suppliers(spark, [
        {"todo_id": "a", "sup_type": "厂家", "registered_capital": 499.99, "has_business_license": True, "social_credit_code": "9",
         "needs_production_license": True, "production_license_reason": "生产许可证（经营范围涉及「水泥」）",
         "iso_conflicts": [("ISO14001.png", "职业健康安全管理体系认证证书", "45001", "14001")]},
        {"todo_id": "b", "sup_type": "厂家", "registered_capital": 1234567.0, "tyc_checked": True, "has_violation_3y": False,
         "is_dishonest": False, "certifications": ["ISO9001"]}])
    mats = materials(spark, [{"todo_id": "a", "file_name": "2024年财报.pdf", "types": ["financial_report"]}])
    prepared = prepare_suppliers(apps, sups, mats)
    rows = {(r.todo_id, r.rule_id): r for r in checklist.build_checklist(prepared, rules, AS_OF).collect()}
    a = {k[1]: r for k, r in rows.items() if k[0] == "a"}
    assert a["A01"].status == "pending" and a["A01"].detail.startswith("材料已上传；待核验：")
    assert a["A08"].status == "fail" and "2024年" in a["A08"].detail and "2025年" in a["A08"].detail
    assert a["A10"].status == "pending" and a["A13"].status == "skip"
    assert a["C1_01"].detail == "注册资本499.99万元，未达到500万元要求"
    assert a["C1_04"].status == "manual" and "传错位置" in a["C1_04"].detail
    assert a["C1_05"].detail == "缺少生产许可证或强制认证证明（须在有效期内）【生产许可证（经营范围涉及「水泥」）】"
    assert rows["b", "C1_01"].detail == "注册资本1.23457e+06万元，达到500万元要求"
    assert rows["b", "A10"].status == "pass" and rows["b", "C1_02"].status == "pending" and rows["b", "C1_05"].status == "skip"
    stage1 = by(review_stage1(apps, sups, mats, rules, AS_OF).collect())
    assert stage1["a"].decision == "reject" and stage1["a"].opinion.startswith("退回。\n存在问题：\n  1. 注册资本499.99万元，未达到500万元要求\n请补充资质文件：\n  2. ISO 9001、ISO 14001 认证证书（须为贵司认证且在有效期内）")
    items = checklist.checklist_items(prepared, rules, AS_OF, ["todo_id", "classified_materials", "financial_submitted"])
    lacking = {(r.rule_id, r.label) for r in review.missing_materials(items).filter("todo_id = 'a'").collect()}
    assert ("C1_05", "生产许可证/强制认证") in lacking and ("A08", "经审计的上年度财报") not in lacking


def _items(spark, cases):
    rows = [{"todo_id": k, "rule_id": r, "position": i, "name": n, "status": s, "detail": d}
            for k, items in cases.items() for i, (r, n, s, d) in enumerate(items)]
    return frame(spark, schemas.CHECKLIST, rows)


def test_final_opinion(spark):
    items = _items(spark, {
        "missing": [("A03", "纳税信用等级", "fail", "缺少纳税信用等级证明（须为正规文件，C级及以上）"), ("X99", "新增资质", "fail", "缺少新增专项资质证明")],
        "after": [("A07", "售后服务", "fail", "缺少售后服务五星认证或厂家出具的售后服务证明函；贸易商/经销商也需提交")],
        "fields": [("A01", "法律主体资格", "fail", "OCR核验发现问题：营业执照识别不完整，缺少字段：名称、法定代表人"),
                   ("A03", "纳税信用等级", "fail", "缺少纳税信用等级证明")],
        "iso": [("C1_02", "ISO 9001", "fail", "缺少ISO 9001"), ("C1_04", "ISO 45001", "fail", "缺少ISO 45001"), ("A10", "商业信誉", "pending", "x" * 101)],
        "report": [("A08", "资金财务状况", "manual", "转人工")],
        "open": [("A01", "法律主体资格", "partial", "身份证有效期仍需人工核验")],
        "good": [("A01", "法律主体资格", "pass", "通过")],
    })
    states = {"missing": "reject", "after": "reject", "fields": "reject", "iso": "reject", "report": "manual", "open": "manual",
              "good": "recommend", "empty": "manual", "skip": "skip", "hmt": "manual"}
    results = spark.createDataFrame([(k, d, {"hmt": "转人工复核。港澳台地区供应商需人工审批。", "skip": "不适用。x。"}.get(k, ""), None)
                                     for k, d in states.items()], "todo_id string, decision string, opinion string, skip_reason string")
    extra = spark.createDataFrame([(k, "提示" if k == "skip" else "", "mismatch" if k == "report" else "matched") for k in states],
                                  "todo_id string, domestic_tip string, financial_status string")
    grouped = items.groupBy("todo_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "rule_id", "name", "status", "detail"))).alias("items"))
    reviewed = results.join(extra, "todo_id").join(grouped, "todo_id", "left")
    got = {r.todo_id: r.final_opinion for r in decide.opinion_final(reviewed).collect()}
    assert got["missing"] == "退回。1. 缺少纳税信用等级证明（须为正规文件，C级及以上）；2. 缺少新增专项资质证明。补充后重新提交。"
    assert got["after"] == "退回。1. 缺少售后服务五星认证或售后服务承诺函。补充后重新提交。"
    assert "缺少营业执照副本" not in got["fields"] and "[A01]法律主体资格：OCR核验发现问题" in got["fields"]
    assert got["iso"] == ("退回。1. ISO 9001、ISO 45001 体系认证证书（须为你公司认证且在有效期内）。补充后重新提交。\n另需整改/核实：[A10]商业信誉："
                          + "x" * 100 + "…。")
    assert got["report"].startswith("退回。1. 缺少经审计的上年度财报（须为上一年度") and "[A08]" not in got["report"]
    assert got["open"] == "转人工。[A01]法律主体资格：身份证有效期仍需人工核验"
    assert got["good"] == "同意。各项审核均通过，建议后续常规管理。"
    assert got["empty"] == "转人工。缺少核验清单，无法确认审核完成。"
    assert got["skip"] == "不适用。x。\n\n提示" and "同意" not in got["hmt"]


def _reading(todo, kind, checks, issues=(), fields=None, position=0, error=None, file="a.png"):
    return {"todo_id": todo, "doc_type": kind, "doc_id": f"{todo}/{kind}/{position}", "position": position, "file": file,
            "fields": fields or {}, "checks": checks, "issues": list(issues), "error": error}


def _checklist_frame(spark, cases):
    rows = _items(spark, cases)
    return rows.select("*", F.lit("material").alias("check_type"), F.lit(None).cast("string").alias("role"),
                       F.lit(None).cast("string").alias("verify"), (F.col("status") == "manual").alias("has_files"))


def test_certificate_enrichment(spark):
    licence = [("C1_05", "生产许可证", "pending", "待核验")]
    carrier = [("E1", "运输承运资质", "manual", "已提交")]
    after = [("A07", "售后服务", "pending", "待核验")]
    cases = {
        "conflict": [("A01", "法律主体资格", "fail", "企查查法人冲突")], "expired": licence, "legacy": licence, "good": licence,
        "untyped": licence, "wrong": licence, "road": carrier, "road_old": carrier, "road_legacy": carrier, "stale": [("E1", "运输承运资质", "fail", "缺少")],
        "graver": after, "many": licence, "mixed": [("A03", "纳税信用等级", "pending", "待核验")], "four": [("A03", "纳税信用等级", "pending", "")],
    }
    ok = {"材料类型正确": True, "在有效期内": True}
    readings = [
        _reading("conflict", "business_license", {"名称一致": True}),
        _reading("expired", "production_license", {"材料类型正确": True, "持证主体一致": None, "在有效期内": False},
                 ["未能确认持证主体", "特种设备生产许可证已过期（2026-05-16）"]),
        _reading("legacy", "production_license", {"在有效期内": True}, fields={"有效期至": "2099-12-31"}),
        _reading("good", "production_license", ok, fields={"证书类型": "工业产品生产许可证", "有效期至": "2099-12-31"}),
        _reading("untyped", "production_license", {"材料类型正确": None}),
        _reading("wrong", "production_license", {"材料类型正确": False, "在有效期内": None}, ["上传材料实际为ISO 9001证书"]),
        _reading("road", "transport_license", ok), _reading("road_old", "transport_license", {"材料类型正确": True, "在有效期内": False}),
        _reading("road_legacy", "transport_license", {"在有效期内": True}), _reading("stale", "transport_license", ok),
        _reading("graver", "after_sales_cert", {"a": False}), _reading("graver", "after_sales_statement", {"b": True}),
        _reading("many", "production_license", ok, file="a"), _reading("many", "production_license", None, position=1, error="x", file="b"),
        _reading("mixed", "tax_credit", {"C级及以上": True, "评价年度=2025": None}),
        _reading("four", "tax_credit", {"k": False, "y": True}, ["一", "二", "三"]),
    ]
    rows = _checklist_frame(spark, cases)
    requests = rows.groupBy("todo_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", *[c for c in rows.columns if c not in ("todo_id", "position")]))).alias("items"))
    joined = requests.join(ocr.ocr_documents(frame(spark, schemas.EXTRACTION, readings)), "todo_id", "left")
    got = by(checklist.long_form(ocr.enrich_ocr(joined)).collect())
    expected = {"conflict": "fail", "expired": "fail", "legacy": "manual", "good": "pass", "untyped": "manual", "wrong": "fail", "road": "pass",
                "road_old": "fail", "road_legacy": "manual", "stale": "fail", "graver": "fail", "many": "manual", "mixed": "partial", "four": "fail"}
    assert {k: r.status for k, r in got.items()} == expected
    assert "企查查法人冲突" in got["conflict"].detail
    assert "2026-05-16" in got["expired"].detail and "ISO 9001" in got["wrong"].detail
    assert got["stale"].detail == "缺少" and got["stale"].ocr_issues == []
    assert got["good"].detail == "OCR核验通过：证书类型=工业产品生产许可证，有效期至=2099-12-31"
    assert got["four"].detail == "OCR核验发现问题：一；二；三（另有1项）"
    assert got["mixed"].detail == "OCR核验：自动确认1项，1项需人工核验（评价年度=2025）"
    assert got["graver"].detail == "OCR核验发现问题：a=False"


def test_attachments_must_all_pass(spark):
    rows = frame(spark, schemas.EXTRACTION, [
        _reading("1", "tax_credit", {"valid": True}, fields={"x": "1"}, file="b", position=1),
        _reading("1", "tax_credit", None, error="failed", file="a"), _reading("2", "tax_credit", {"valid": True}, file="c")])
    got = {(r.todo_id, r.ordinal): r for r in ocr.combine_attachments(rows).collect()}
    assert got["1", 1].checks == {"附件1(a) 核验完成": None} and got["1", 1].issues == ["附件1(a)：识别失败，需人工核验"]
    assert got["1", 2].checks == {"附件2(b) valid": True} and got["1", 2].fields == {"附件2(b) x": "1"}
    assert got["2", 1].checks == {"valid": True}
    text = {(r.todo_id): r.passed for r in review.passed_checks(ocr.combine_attachments(rows)).collect()}
    assert text == {"1": "核验通过：附件2 valid", "2": "核验通过：valid"}


def test_redecision(spark, rules):
    ids = ["reg", "none", "error", "related", "hmt", "foreign", "cloud", "off"]
    apps = applications(spark, [{"todo_id": k, "title": f"合成{k}有限公司/1", "bill_name": "注册审批"} for k in ids])
    common = {"sup_type": "服务商", "legal_person": "张三", "registered_capital": 1000.0, "social_credit_code": "C",
              "has_business_license": True, "has_legal_id_material": True, "tax_credit_rating_ok": True, "has_after_sales_cert": True}
    sups = suppliers(spark, [{**common, "todo_id": k, "social_credit_code": f"C-{k}", "is_hmt": k == "hmt", "is_foreign": k == "foreign",
                              "sup_type": "云服务商" if k == "cloud" else "服务商"} for k in ids])
    mats = materials(spark, [{"todo_id": k, "file_name": "2025年财报.pdf", "types": ["financial_report"]} for k in ids])
    full = {"company_name": "x", "legal_person": "张三", "registered_capital": "1000万元", "reg_status": "存续（在营）", "accuracy": "一致"}
    registry = frame(spark, schemas.REGISTRY + ", has_reg_info boolean", [
        {"key": "C-reg", **full, "shareholders": [("甲", "60%"), ("乙", None)], "controllers": ["丙"]},
        {"key": "C-error", "has_reg_info": True},
        {"key": "C-related", **full, "shareholders": [("中交某公司", None)]},
        {"key": "C-off", **full, "legal_person": "李四", "reg_status": "注销"}])
    good = {k: True for k in ("信用代码一致", "名称一致")}
    readings = frame(spark, schemas.EXTRACTION, [
        _reading("reg", "business_license", good, fields={"名称": "执照上的有限公司"}),
        _reading("none", "tax_credit", {"C级及以上": False}, ["纳税信用等级为D级，低于C级要求"])])
    reviewed = redecide(apps, sups, mats, rules, registry, readings, AS_OF).cache()
    results, items = results_of(reviewed), checklist_of(reviewed)
    got, lines = by(results.collect()), {(r.todo_id, r.rule_id): r for r in items.collect()}
    assert {k: got[k].decision for k in ids} == {
        "reg": "manual", "none": "manual", "error": "manual", "related": "manual", "hmt": "manual", "foreign": "skip", "cloud": "skip", "off": "manual"}
    assert len(got) == len(ids)
    assert got["reg"].name == "执照上的有限公司" and got["none"].name == "合成none有限公司"
    assert lines["reg", "A01"].status == "pass" and lines["reg", "A02"].status == "partial"
    assert lines["reg", "A02"].detail.endswith("（股东：甲(60%)、乙()，实际控制人丙）；身份证有效期仍需人工核验")
    assert lines["error", "A01"].status == "manual" and lines["none", "A01"].status == "pending"
    assert lines["related", "A02"].detail == "企查查股权穿透发现中交系统关联：股东「中交某公司」（持股?）"
    assert lines["off", "A01"].detail == "企查查核验发现问题：法人不一致（审批系统:张三 / 工商登记:李四）；工商登记状态异常：「注销」"
    assert lines["off", "A10"].status == "fail" and lines["none", "A10"].status == "manual"
    assert lines["reg", "A08"].status == "manual"
    assert lines["none", "A03"].status == "fail"
    assert got["none"].ocr_issues == ["纳税信用等级：纳税信用等级为D级，低于C级要求；C级及以上=False"]
    assert "另经资质文件OCR核验发现：\n  1. 纳税信用等级：" in got["none"].opinion
    assert got["foreign"].skip_reason == "境外供应商不适用中国大陆合规审查"
    assert len(got["off"].qcc_issues) == 3 and got["off"].qcc_issues[0].startswith("法律主体资格：")
    summary = {r.decision: r.requests for r in decide.decision_summary(results).collect()}
    assert summary == {"manual": 6, "skip": 2}
    uploaded = spark.createDataFrame([(k, ["business_license", "tax_credit"], True) for k in ids],
                                     "todo_id string, classified_materials array<string>, financial_submitted boolean")
    table = {(r.todo_id, r.rule_id): r for r in review.review_table(
        items, uploaded, ocr.combine_attachments(readings), rules).collect()}
    assert table["reg", "A01"].material == "✓已提交：营业执照副本（原样）"
    assert table["reg", "A01"].verification == "名称=执照上的有限公司；核验通过：信用代码一致、名称一致"
    assert table["none", "A03"].verification.startswith("纳税信用等级为D级")
    assert table["reg", "A08"].material == "已提交（年度及审计情况待人工核查）"
    assert ("reg", "A13") not in table
