"""Certificate texts: expected fields, checks and issues of known layouts."""

import pytest

from .helpers import extract

# Every text is invented for the difficulty its name states; codes, places and numbers belong to nobody.
LICENCE = {
    "inline": ("business_license",
               "统一社会信用代码 91999900TESTA0001X\n名 称 云泽测绘仪器有限公司\n注册资本 叁仟万元整\n"
               "法定代表人 钱某一 住 所 星河市东港区望潮路第三弄18号\n经营范围 测绘仪器销售\n登记机关 星河市市场监督管理局",
               {"social_credit_code": "91999900TESTA0001X", "full_name": "云泽测绘仪器有限公司",
                "legal_person": "钱某一", "registered_capital": 3000.0, "busi_scope": "测绘仪器销售"}),
    "columns": ("business_license",
                "经营范围 法定代表人孙某二 类 名 91999900TESTB0002Y 统一社会信用代码\n型其他有限责任公司 称青梧标识（云泽）有限公司\n"
                "登记机关 2021年03月09日 800万元整",
                {"full_name": "青梧标识（云泽）有限公司", "legal_person": "孙某二", "social_credit_code": "91999900TESTB0002Y"}),
    "sideways": ("business_license",
                 "法定代表人 类 名 91999900TESTC0003Z 统一社会信用代码\n称 阀门、管件及密封件 设计、 李某三 有限责任公司（自然人独资）\n"
                 "云泽流体控制有限公司\n", {"legal_person": "李某三", "social_credit_code": "91999900TESTC0003Z"}),
    "wrapped": ("business_license", "名称 北斗岭照明有限公司\n法定代表人强 住\n周某四\n经营范围 灯具组装\n",
                {"full_name": "北斗岭照明有限公司", "legal_person": "周某四"}),
    "unseen": ("business_license", "法定代表人 类 名 91999900TESTC0003Z 统一社会信用代码", {"legal_person": "李某三"}),
    "dash": ("business_license",
             "经营范围 法定代表人吴某五— 米\n名 91999900TESTD0004P 统一社会信用代码\n型有限责任公司（自然人投资或控股) 望潮文具有限公司 称",
             {"full_name": "望潮软件开发有限公司", "legal_person": "吴某五", "social_credit_code": "91999900TESTE0005Q"}),
    "orphan": ("business_license",
               "统一社会信用代码 91999900TESTF0006R\n名称 青梧门窗制造有限公司\n法定代表人 郑某六 所星河市西郊镇柳浪大道9号B座\n住\n经营范围 门窗加工",
               {"full_name": "青梧门窗制造有限公司", "legal_person": "郑某六", "social_credit_code": "91999900TESTF0006R"}),
    "reversed": ("business_license",
                 "法定代表人 吴某五\n统一社会信用代码 91999900TESTD0004P\n型 有限责任公司（自然人投资或控股） 望潮文具有限公司 称\n"
                 "注册资本 贰佰万元整\n经营范围 文具零售；纸张批发",
                 {"social_credit_code": "91999900TESTE0005Q", "full_name": "望潮软件开发有限公司", "legal_person": "吴某五",
                  "registered_capital": 200.0, "busi_scope": "软件测试；文具零售"}),
    "stars": ("business_license", "| 营业期限 | **2011-04-03 至 ********** |\n| 名称 | 云泽玻璃科技股份有限公司 |", {}),
    "wide_stars": ("business_license", "| 营业期限 | **2011-04-03 至 ＊＊＊＊＊＊＊＊** |\n| 名称 | 云泽玻璃科技股份有限公司 |", {}),
    "half": ("business_license", "营业期限：2011-04-03 至", {}),
    "future": ("business_license", "营业期限：2013-02-01 至 2095-11-30", {}),
    "past": ("business_license", "营业期限：2011-04-03 至 2019-04-02", {}),
    "single": ("business_license", "营业期限：2095-11-30", {}),
}


@pytest.fixture(scope="module")
def licence(spark):
    return extract(spark, LICENCE)


def test_licence_layouts(licence):
    def field(case, name):
        return licence[case]["fields"][name]

    assert field("inline", "名称") == "云泽测绘仪器有限公司"
    assert field("inline", "法定代表人") == "钱某一"
    assert field("inline", "住所") == "星河市东港区望潮路第三弄18号"
    assert field("inline", "注册资本_万") == "3000.0"
    assert licence["inline"]["checks"]["注册资本一致"] is True
    assert field("columns", "法定代表人") == "孙某二"
    assert field("sideways", "法定代表人") == "李某三"
    assert field("wrapped", "法定代表人") == "周某四"
    assert field("unseen", "法定代表人") is None
    assert "法人一致" not in licence["unseen"]["checks"]
    assert field("dash", "法定代表人") == "吴某五"
    assert field("orphan", "法定代表人") == "郑某六"
    for case in ("inline", "columns", "sideways", "wrapped", "dash", "orphan"):
        assert licence[case]["checks"]["法人一致"] is True, case
    assert field("reversed", "名称") == "望潮文具有限公司"
    assert licence["reversed"]["checks"]["名称一致"] is False
    assert "执照名称「望潮文具有限公司」与系统「望潮软件开发有限公司」不一致" in licence["reversed"]["issues"]
    assert licence["reversed"]["checks"]["注册资本一致"] is True


def test_licence_terms(licence):
    key = "营业期限长期或有效"
    assert licence["stars"]["checks"][key] is True
    assert licence["wide_stars"]["checks"][key] is True
    assert licence["half"]["checks"].get(key) is not False
    assert not any("已到期" in i for i in licence["half"]["issues"])
    assert licence["future"]["checks"][key] is True
    assert licence["past"]["checks"][key] is False
    assert any("2019-04-02" in i for i in licence["past"]["issues"])
    assert licence["single"]["checks"][key] is True


LONG_SCOPE = "；".join(f"第{i}类仪表的检修" for i in range(120))
SCOPES = {
    "lines": ("**经营范围**\n\n说明：\n\n一般项目：园林灌溉设备安装；\n温室大棚配件批发。\n注册资本：300万元",
              "一般项目：园林灌溉设备安装；温室大棚配件批发。", True),
    "order": ("经营范围：广告设计；会务组织\n登记机关：市场监督管理局", "会务组织；广告设计", True),
    "brackets": ("经营范围：一般项目：广告设计；食品批发（不含散装、现制）\n成立日期：2018年05月06日",
                 "一般项目:广告 设计;食品批发(不含散装现制)", True),
    "footer": ("经营范围：广告设计（除依法须经批准的项目外，凭营业执照依法自主开展经营活动）", "广告设计", True),
    "long": ("经营范围：" + LONG_SCOPE + "\n注册资本：300万元", LONG_SCOPE, True),
    "address": ("经营范围 一般项目：水质化验、河道清淤及其它水体治理的咨询服务，湿地植被养护服 住 所 星河市北桥区石榴巷7号1-5 "
                "务，湿地观测站运营服务，水泵销售、阀门配件、过滤器芯销售、滤芯村料加工 登记机关 -->",
                "水质化验、河道清淤及其它水体治理的咨询服务，湿地植被养护服务，湿地观测站运营服务，水泵销售、阀门配件、过滤器芯销售、滤芯材料加工", True),
    "empty": ("经营范围\n说明：\n注册资本：300万元", "广告设计；会务组织", None),
    "no_system": ("经营范围：广告设计", "", None),
    "short": ("经营范围：广告设计", "广告设计；会务组织；礼品包装销售；舞台搭建服务", None),
    "added": ("经营范围：广告设计；会务组织；翻译服务；舞台搭建", "广告设计；会务组织；翻译服务；舞台搭建；礼品批发零售", None),
    "qualifier": ("经营范围：食品批发销售（不含散装食品）", "食品批发销售（含散装食品）", None),
    "different": ("经营范围：广告设计；会务组织", "养殖鱼苗；造纸原料", False),
}


def test_scope_comparison(spark):
    got = extract(spark, {k: ("business_license", t, {"busi_scope": s}) for k, (t, s, _) in SCOPES.items()})
    for case, (_, _, expected) in SCOPES.items():
        assert got[case]["checks"]["经营范围一致"] is expected, (case, got[case])
        if expected is None:
            assert any("经营范围" in i for i in got[case]["issues"]), case
    assert got["long"]["fields"]["经营范围"] == LONG_SCOPE
    assert "说明：" not in got["lines"]["fields"]["经营范围"]
    address = got["address"]["fields"]
    assert "住所" not in address["经营范围"] and "登记机关" not in address["经营范围"]
    assert 98 <= float(address["经营范围相似度"].rstrip("%")) < 100


ISO = {
    "spaced": ("iso9001", "管理体系认证证书\n注册有效日期：2029 年 03 月 05 日", {}),
    "seal": ("iso14001", "环境管理体系认证证书\n望潮铸件科技有限公司\n发证日期：2025年02月11日 有效期：2025年02月 2028年02月10日\n11 日至",
             {"full_name": "望潮铸件科技有限公司"}),
    "declared": ("iso9001", "质量管理体系认证证书\n注册号：TEST25Q00001R0\n兹证明\n青梧紧固件制造有限公司\n统一社会信用代码：91999900TESTG0007S\n"
                 "ISO9001:2015\n证书有效期：2024年06月02日至2027年06月01日\n获证组织须按期接受监督审核，证书方为有效。",
                 {"full_name": "青梧紧固件制造有限公司"}),
    "footer": ("iso9001", "质量管理体系认证证书\n获证组织须按期接受监督审核。\n有效期至：2027年06月01日", {"full_name": "青梧紧固件制造有限公司"}),
    "recognised": ("iso45001", "北斗岭检验认证有限公司\nNORTHERN RIDGE TESTING LTD\n职业健康安全管理体系认证证书\nOHSMS CERTIFICATE\n"
                   "我公司认定下列组织的职业健康安全管理体系\n云泽开关设备有限公司\n统一社会信用代码91999900TESTH0008T\n生效日期：2025-05-20 终止日期：2028-05-19",
                   {"full_name": "云泽开关设备有限公司"}),
    "split_title": ("iso45001", "青梧联合认证中心\n职业健康安全管理体系\n认证证书\n注册号：TEST25S00002R0\n云泽道桥设计有限公司\n"
                    "统一社会信用代码：91999900TESTK0009U\nGB/T45001-2020/ISO45001:2018\n证书有效期：2024年09月15日至2027年09月14日",
                    {"full_name": "云泽道桥设计有限公司"}),
    "wrong": ("iso14001", "营业执照\n有效期至：2096年01月02日", {}),
    "previous": ("iso9001", "质量管理体系认证证书\n上周期有效期至：2023年07月08日\n证书有效日期：2024年07月09日 至 2027年07月08日", {}),
    "soon": ("iso9001", "质量管理体系认证证书\n有效期至：2026年10月20日\n认证状态：有效", {}),
    "suspended": ("iso9001", "质量管理体系认证证书\n有效期至：2027年10月20日\n认证状态：暂停", {}),
}


def test_iso(spark):
    got = extract(spark, ISO)
    assert got["spaced"]["fields"]["有效期至"] == "2029-03-05"
    assert got["spaced"]["checks"]["在有效期内"] is True
    assert got["seal"]["fields"]["有效期至"] == "2028-02-10"
    declared = got["declared"]
    assert declared["fields"]["获证组织"] == "青梧紧固件制造有限公司"
    assert declared["fields"]["获证组织_来源"] == "兹证明"
    assert declared["checks"]["持有人一致"] is True
    assert got["footer"]["fields"]["获证组织"] is None
    assert "持有人一致" not in got["footer"]["checks"]
    recognised = got["recognised"]["fields"]
    assert recognised["获证组织"] == "云泽开关设备有限公司"
    assert recognised["获证组织_来源"] == "我公司认定下列组织"
    assert recognised["认证机构"] == "北斗岭检验认证有限公司"
    split = got["split_title"]["fields"]
    assert (split["获证组织"], split["获证组织_来源"], split["认证机构"]) == (
        "云泽道桥设计有限公司", "证书版面推断（无标签）", "青梧联合认证中心")
    assert got["wrong"]["checks"]["材料类型正确"] is None and got["wrong"]["issues"]
    assert got["previous"]["fields"]["有效期至"] == "2027-07-08"
    assert got["soon"]["checks"]["在有效期内"] is True
    assert any("90天内" in i for i in got["soon"]["issues"])
    assert got["suspended"]["checks"]["证书状态有效"] is False


OTHERS = {
    "tax": ("tax_credit", "国家税务总局\n2025年度评价结果：A", {}),
    "tax_low": ("tax_credit", "纳税信用等级：D\n2024年度", {}),
    "grant": ("authorization", "授权方：某厂有限公司\n被授权方：合成贸易有限公司\n有效期至：2027年01月01日", {"full_name": "合成贸易有限公司"}),
    "unlabelled": ("tax_cert", "开票资料 2018年02月03日", {}),
    "spread": ("tax_cert", "**有** **效** **期：** 2018年02月03日 至 2089年08月08日", {}),
    "production": ("production_license", "全国工业产品生产许可证 许可证编号：XK07-002-00417 持证单位 云泽桥隧配件有限公司 有效期至：2091年10月30日",
                   {"full_name": "云泽桥隧配件有限公司"}),
    "ccc": ("production_license", "中国国家强制性产品认证证书 CCC认证 证书编号：2024010203000777 持证单位 云泽桥隧配件有限公司 有效期至：2091年10月30日",
            {"full_name": "云泽桥隧配件有限公司"}),
    "production_old": ("production_license", "全国工业产品生产许可证 持证单位 云泽桥隧配件有限公司 有效期至：2018年02月03日",
                       {"full_name": "云泽桥隧配件有限公司"}),
    "production_mix": ("production_license", "营业执照\n质量管理体系认证证书\n有效期至：2093年03月15日", {"full_name": "云泽桥隧配件有限公司"}),
    "road": ("transport_license", "道路运输经营许可证\n有效期至：2093年03月15日", {}),
    "road_old": ("transport_license", "道路运输经营许可证\n有效期至：2019年03月15日", {}),
    "road_bare": ("transport_license", "道路运输经营许可证", {}),
    "road_issue": ("transport_license", "道路运输经营许可证\n发证日期：2026年05月11日", {}),
    "road_early": ("transport_license", "道路运输经营许可证\n有效期：2092年03月15日至2093年03月15日", {}),
    "road_other": ("transport_license", "营业执照\n有效期至：2093年03月15日", {}),
    "road_pages": ("transport_license", "", {}),
    "promise": ("after_sales_cert", "售后服务证明函\n本厂对所售水泵负责售后服务。\n日期：2026年07月30日", {}),
    "promise_old": ("after_sales_statement", "售后服务承诺\n日期：2026年01月01日", {}),
    "stars": ("after_sales_cert", "售后服务评价体系认证\n售后服务认证证书 四星级 有效期至：2091年10月30日", {}),
    "unrelated": ("after_sales_cert", "营业执照 注册资本640万元", {}),
    "card": ("legal_person_id", "姓名 张三\n性别 男\n有效期限 2017.03.09-2037.03.09", {"legal_person": "张三"}),
    "card_close": ("legal_person_id", "姓名 林晟\n性别 男\n有效期限 2015.05.20-长期", {"legal_person": "林成"}),
    "card_front": ("legal_person_id", "姓名 张三\n性别 男", {"legal_person": "李四"}),
    "report": ("financial_report", "资产负债表", {}),
}
DETAIL = [
    {"doc_id": "production_mix", "page_id": 1, "line_no": 0, "text": "营业执照 名称 云泽桥隧配件有限公司"},
    {"doc_id": "production_mix", "page_id": 2, "line_no": 1, "text": "质量管理体系认证证书 ISO 9001 有效期至：2093年03月15日"},
    {"doc_id": "road_pages", "page_id": 1, "line_no": 0, "text": "道路运输经营许可证"},
    {"doc_id": "road_pages", "page_id": 2, "line_no": 1, "text": "ISO9001 有效期至：2093年03月15日"},
]


def test_other_certificates(spark):
    got = extract(spark, OTHERS, DETAIL)

    def check(case, name="在有效期内"):
        return got[case]["checks"][name]

    assert got["tax"]["checks"] == {"C级及以上": True, "评价年度=2025": True} and not got["tax"]["issues"]
    assert got["tax_low"]["checks"] == {"C级及以上": False, "评价年度=2025": False}
    assert got["grant"]["checks"] == {"被授权方为本公司": True, "在有效期内": True}
    assert got["grant"]["fields"]["授权方"] == "某厂有限公司"
    assert check("unlabelled") is None
    assert check("spread") is True
    right = {"材料类型正确": True, "持证主体一致": True, "在有效期内": True}
    assert got["production"]["checks"] == right and got["ccc"]["checks"] == right
    assert check("production_old") is False
    assert check("production_mix", "材料类型正确") is False
    assert got["production_mix"]["issues"] == ["上传材料实际为营业执照、ISO 9001证书，应为生产许可证或3C强制认证证明"]
    assert [check(c) for c in ("road", "road_old", "road_bare", "road_issue", "road_early", "road_other", "road_pages")] == [
        True, False, None, None, None, None, None]
    assert check("road_other", "材料类型正确") is None
    assert got["promise"]["fields"]["材料类型"] == "售后服务承诺函"
    assert check("promise", "落款时间在3个月内") is True
    assert check("promise_old", "落款时间在3个月内") is False
    assert check("stars") is True and check("stars", "材料类型正确") is True
    assert check("unrelated", "材料类型正确") is False
    assert got["card"]["checks"] == {"正反面齐全": True, "姓名与法人一致": True, "在有效期内": True}
    assert got["card"]["fields"]["有效期至"] == "2037-03-09"
    assert got["card_close"]["checks"]["姓名与法人一致"] is None and check("card_close") is True
    assert got["card_front"]["checks"] == {"正反面齐全": None, "姓名与法人一致": False}
    assert got["report"]["checks"] == {} and got["report"]["issues"] == []


def test_confidence(spark):
    from gatehouse.operators.extract import confidence_review, extract_all

    from .helpers import documents, lines, suppliers

    text = "质量管理体系认证证书\n云泽泵业有限公司\nGB/T19001-2016 idt ISO9001:2015\n有效期至：2029年04月11日"
    cases = {k: ("iso9001", text) for k in ("good", "weak", "none")}
    cases["tax"] = ("tax_credit", "国家税务总局\n2025年度评价结果：A")
    known = suppliers(spark, [{"todo_id": k, "full_name": "云泽泵业有限公司"} for k in cases])

    def rows(doc, holder):
        scored = [("质量管理体系认证证书", .99), ("云泽泵业有限公司", holder), ("GB/T19001-2016 idt ISO9001:2015", .98),
                  ("有效期至：2029年04月11日", .99), ("IAF", .74), ("（贴花）", .77)]
        return [{"doc_id": doc, "page_id": 1, "line_no": i, "text": t, "confidence": c} for i, (t, c) in enumerate(scored)]

    detail = lines(spark, rows("good", .99) + rows("weak", .82) + [
        {"doc_id": "tax", "page_id": 1, "line_no": 0, "text": "x", "confidence": None}])
    found = extract_all(documents(spark, cases), detail, known, "2026-09-16")
    got = {r.todo_id: r for r in confidence_review(found, detail).collect()}
    key = "OCR文字置信度充足"
    assert got["good"].checks[key] is True and not got["good"].issues
    assert got["weak"].checks[key] is None
    assert "ISO关键字段获证组织文字置信度较低（0.82），转人工核验" in got["weak"].issues
    assert "OCR置信度明细缺失，转人工核验" in got["none"].issues and got["none"].checks[key] is None
    assert "存在低置信度或缺失置信度文字，转人工核验" in got["tax"].issues


def test_cards(spark):
    from gatehouse import schemas
    from gatehouse.operators.extract.identity import idcard_checks

    from .helpers import frame, suppliers

    cards = frame(spark, schemas.CARD, [
        {"todo_id": "1", "doc_id": "d", "file": "a", "card_index": 1, "side": "front", "name": "张三"},
        {"todo_id": "1", "doc_id": "d", "file": "a", "card_index": 2, "side": "back", "valid_until": "2016.01.14-203601.14"},
        {"todo_id": "2", "doc_id": "e", "file": "b", "card_index": 1, "side": "unknown"},
    ])
    got = {r.todo_id: r.result for r in idcard_checks(
        cards, suppliers(spark, [{"todo_id": "1", "legal_person": "张三"}, {"todo_id": "2"}]), "2026-09-16").collect()}
    assert got["1"].fields["有效期至"] == "2036-01-14"
    assert got["1"].checks == {"正反面齐全": True, "姓名与法人一致": True, "在有效期内": True}
    assert got["2"].checks == {"正反面齐全": False}


def test_a_text_reaches_one_reader(spark, monkeypatch):
    """The generic reader gets no text that another one has read, and rows without a text give what an empty text gives."""
    from gatehouse.operators.extract import dispatch

    seen, read = [], dispatch.read_generic
    monkeypatch.setattr(dispatch, "read_generic", lambda rows: seen.append(rows) or read(rows))
    term = "证书有效期：2020-01-01 至 2030-01-02"
    found = extract(spark, {"a": ("iso9001", term), "b": ("product_cert", term), "c": ("iso9001", None), "d": ("iso9001", ""), "e": ("product_cert", None)})
    assert {r.doc_id: r.text for r in seen[0].select("doc_id", "text").collect()} == {"a": None, "b": term, "c": None, "d": None, "e": ""}
    assert found["a"]["fields"]["有效期至"] == found["b"]["fields"]["有效期至"] == "2030-01-02"
    assert [found["c"][k] for k in ("fields", "checks", "issues")] == [found["d"][k] for k in ("fields", "checks", "issues")]
