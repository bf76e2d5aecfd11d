"""The same results as plain SQL for a second engine, one statement per driver query."""

from __future__ import annotations

from .adapters import APPLICATION, AS_OF, HMT_NATIONS, MATERIAL, SUPPLIER
from .driver_queries import CATALOGUE

RULES = {rule.id: rule for rule in CATALOGUE}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


APPS = f"app AS ({APPLICATION})"
SUP = f"sup AS ({SUPPLIER})"
MAT = f"mat AS ({MATERIAL})"
_HMT = ", ".join(text(n) for n in HMT_NATIONS)

# region and route of each supplier
REGION = f"""region2 AS (SELECT *, is_overseas AND country_name IN ({_HMT}) AS is_hmt,
  is_overseas AND country_name NOT IN ({_HMT}) AS is_foreign FROM sup)"""

ROUTED = """routed0 AS (
  SELECT *, CASE WHEN is_foreign THEN '境外' WHEN is_overseas THEN '港澳台' ELSE '境内' END AS area,
    sup_type = '厂家' AS maker, busi_scope LIKE '%生产%' AS makes_scope, busi_scope LIKE '%货运代理%' AS freight
  FROM region2),
routed1 AS (
  SELECT *, CASE
    WHEN sup_type = '仓储服务商、物流服务商' THEN 'carrier'
    WHEN NOT is_foreign AND freight AND sup_type IN ('服务商', '其他') THEN 'scope_carrier'
    WHEN maker THEN 'maker' WHEN sup_type = '经销商' THEN 'trader'
    WHEN sup_type = '服务商' AND (busi_scope LIKE '%销售%' OR busi_scope LIKE '%采购%') THEN 'service_trader'
    WHEN sup_type = '服务商' THEN 'service'
    WHEN NOT is_foreign AND busi_scope LIKE '%销售%' THEN 'guess_trader'
    ELSE 'none' END AS route FROM routed0),
routed2 AS (
  SELECT *, (maker OR makes_scope) AND NOT is_foreign AND route NOT IN ('carrier', 'scope_carrier') AS makes,
    CASE route WHEN 'carrier' THEN '运输/承运商' WHEN 'scope_carrier' THEN '运输/承运商（经营范围识别）'
      WHEN 'maker' THEN CASE WHEN is_foreign THEN '境外厂家' ELSE '境内厂家' END
      WHEN 'trader' THEN CASE WHEN is_foreign THEN '境外贸易商' ELSE '境内贸易商' END
      WHEN 'service_trader' THEN '经销商/服务商（经营范围补充识别）' WHEN 'service' THEN '服务商'
      WHEN 'guess_trader' THEN '境内贸易商（推断自经营范围）' ELSE '' END AS base_label FROM routed1),
routed AS (
  SELECT *, area || CASE WHEN label = '' THEN '' ELSE '·' || label END AS type_desc FROM (
    SELECT *, CASE WHEN makes AND base_label = '' THEN '境内厂家（经营范围识别）'
      WHEN makes AND base_label NOT LIKE '%厂家%' THEN base_label || '/厂家（经营范围补充识别）'
      ELSE base_label END AS label,
      route IN ('carrier', 'scope_carrier') AND NOT is_foreign AS set_carrier,
      route IN ('carrier', 'scope_carrier') AS no_after_sales,
      route IN ('trader', 'service_trader', 'guess_trader') AND NOT is_foreign AS set_trader,
      route IN ('trader', 'service_trader', 'guess_trader') AND is_foreign AS set_trader_abroad,
      route = 'maker' AND is_foreign AS set_maker_abroad
    FROM routed2))"""


def applies(rule_id: str) -> str:
    rule_set = RULES[rule_id].rule_set
    condition = {
        "domestic": "NOT is_foreign", "overseas": "is_foreign", "domestic_carrier": "set_carrier",
        "domestic_trader": "set_trader", "overseas_trader": "set_trader_abroad",
        "domestic_manufacturer": "(makes OR (route = 'maker' AND NOT is_foreign))",
        "overseas_manufacturer": "set_maker_abroad",
    }[rule_set]
    if rule_id == "A07":
        condition += " AND NOT no_after_sales"
    if rule_id in ("D1_03", "D1_04", "D1_05"):
        condition += " AND NOT makes"
    return f"({condition})"


def position(rule_id: str) -> int:
    order = ["domestic", "overseas", "domestic_carrier", "domestic_trader", "overseas_trader",
             "domestic_manufacturer", "overseas_manufacturer"]
    return order.index(RULES[rule_id].rule_set) * 1000 + RULES[rule_id].position


# what the uploads of a request show
FLAGGED = """mat2 AS (
  SELECT *, CASE WHEN file_name LIKE 'ISO9001%' THEN '9001' WHEN file_name LIKE 'ISO14001%' THEN '14001'
      WHEN file_name LIKE 'ISO45001%' THEN '45001' END AS name_no,
    CASE position WHEN 5 THEN '9001' WHEN 6 THEN '14001' WHEN 7 THEN '45001' END AS slot_no FROM mat),
mat3 AS (
  SELECT *, coalesce(name_no <> slot_no, FALSE) AS clash, file_name LIKE '%财报%' AS financial,
    file_name LIKE '%运输合同%' AS performance, file_name LIKE '%道路运输%' AS transport,
    file_name LIKE '%纳税信用%' AS tax_credit FROM mat2),
mat4 AS (
  SELECT *, coalesce(name_no = '9001', FALSE) OR coalesce(slot_no = '9001' AND NOT clash, FALSE) AS iso9001,
    coalesce(name_no = '14001', FALSE) OR coalesce(slot_no = '14001' AND NOT clash, FALSE) AS iso14001,
    coalesce(name_no = '45001', FALSE) OR coalesce(slot_no = '45001' AND NOT clash, FALSE) AS iso45001,
    CASE WHEN financial THEN nullif(regexp_extract(file_name, '(20[0-9][0-9])年', 1), '') END AS title_year FROM mat3)"""

FACTS = """facts AS (
  SELECT todo_id, count(*) AS uploads, bool_or(position = 1) AS licence, bool_or(position = 2) AS id_card,
    bool_or(position = 3) AS tax_cert, bool_or(tax_credit) AS tax_credit, bool_or(iso9001) AS iso9001,
    bool_or(iso14001) AS iso14001, bool_or(iso45001) AS iso45001, bool_or(financial) AS financial,
    bool_or(transport) AS transport, bool_or(performance) AS performance,
    bool_or(title_year = '2000') AS year_ok, bool_or(title_year IS NOT NULL) AS any_year,
    string_agg(DISTINCT title_year, ',' ORDER BY title_year) AS years FROM mat4 GROUP BY todo_id)"""

NAMES = """firsts AS (
  SELECT todo_id, file_name, performance, min(position) AS first_at FROM mat4 WHERE performance OR transport
  GROUP BY todo_id, file_name, performance),
names AS (
  SELECT todo_id, string_agg(file_name, '、' ORDER BY first_at, file_name) FILTER (WHERE performance) AS performance_files,
    string_agg(file_name, '、' ORDER BY first_at, file_name) FILTER (WHERE NOT performance) AS transport_files
  FROM firsts GROUP BY todo_id),
clashes AS (
  SELECT todo_id, slot_no, min(struct_pack(p := position, f := file_name, t := type_name, s := slot_no, n := name_no)) AS c
  FROM mat4 WHERE clash GROUP BY todo_id, slot_no),
clash_wide AS (
  SELECT todo_id, max(w) FILTER (WHERE slot_no = '9001') AS c9001, max(w) FILTER (WHERE slot_no = '14001') AS c14001,
    max(w) FILTER (WHERE slot_no = '45001') AS c45001 FROM (
    SELECT todo_id, slot_no, '上传异常：文件「' || c.f || '」被传到「' || c.t || '」位置（文件名编号 ' || c.n || ' 与位置 ' || c.s
      || ' 不符），疑似重复上传/传错位置，需人工核验' AS w FROM clashes) GROUP BY todo_id)"""

BASE = """base AS (
  SELECT a.todo_id, a.bill_type, s.* EXCLUDE (supplier_id), f.* EXCLUDE (todo_id), n.* EXCLUDE (todo_id),
    w.* EXCLUDE (todo_id),
    CASE WHEN registered_capital = floor(registered_capital) THEN CAST(CAST(registered_capital AS BIGINT) AS VARCHAR)
      ELSE CAST(registered_capital AS VARCHAR) END AS capital_text,
    maker AND busi_scope LIKE '%电梯%' AS needs_licence,
    CASE WHEN NOT coalesce(f.financial, FALSE) THEN 'missing' WHEN f.year_ok THEN 'matched'
      WHEN f.any_year THEN 'mismatch' ELSE 'unknown' END AS year_state
  FROM app a JOIN routed s ON a.supplier_id = s.supplier_id LEFT JOIN facts f ON a.todo_id = f.todo_id
  LEFT JOIN names n ON a.todo_id = n.todo_id LEFT JOIN clash_wide w ON a.todo_id = w.todo_id)"""

OKS = {
    "A01": "(basics_on_file OR coalesce(licence, FALSE)) AND social_credit_code <> ''",
    "A02": "basics_on_file OR coalesce(id_card, FALSE)",
    "A03": "basics_on_file OR coalesce(tax_credit, FALSE)",
    "A07": "basics_on_file", "A08": "FALSE",
    "A10": "tyc_checked AND NOT has_violation_3y AND NOT is_dishonest", "A13": "FALSE",
    "C1_01": "registered_capital >= 500", "C1_05": "NOT needs_licence", "D1_06": "iso_on_file",
    **{r: f"iso_on_file OR coalesce(iso{n}, FALSE)" for r, n in [
        ("C1_02", "9001"), ("C1_03", "14001"), ("C1_04", "45001"),
        ("D1_03", "9001"), ("D1_04", "14001"), ("D1_05", "45001")]},
}


def item(rule_id: str) -> tuple[str, str]:
    """(status, detail) of a rule."""
    rule = RULES[rule_id]
    if rule_id == "A08":
        return ("CASE WHEN year_state IN ('missing', 'mismatch') THEN 'fail' ELSE 'manual' END",
                "CASE year_state WHEN 'mismatch' THEN '财报材料标题显示' || replace(years, ',', '年、') || "
                "'年，非应提交的上年度2000年；缺少经审计的上年度财报' "
                "WHEN 'missing' THEN '缺少经审计的上年度财报；请补交后转人工核查年度、三表完整性及审计意见；公开财务数据不能替代应上传的经审计财报。' "
                "WHEN 'matched' THEN '财报材料标题年度为上年度2000年；仍需人工核验三表完整性及审计意见' "
                "ELSE '已提交财报材料，但标题未显示明确年度，无法确认是否为上年度2000年；转人工核验三表完整性及审计意见' END")
    if rule_id == "E1":
        return ("CASE WHEN transport_files IS NULL THEN 'fail' ELSE 'manual' END",
                "coalesce('已提交疑似道路运输许可证或无船承运证明：' || transport_files || '；需OCR核验证书类型和有效期，无法识别时转人工核查', "
                "'缺少道路运输许可证或无船承运证明')")
    if rule_id == "E2":
        return ("CASE WHEN performance_files IS NULL THEN 'fail' ELSE 'manual' END",
                "coalesce('已提交疑似过往业绩证明：' || performance_files || '；仅按文件名确认提交，材料真实性及业绩内容转人工核查', "
                "'缺少过往业绩证明（如运输/承运合同、业绩清单或履约证明）')")
    ok = OKS[rule_id]
    if rule_id == "C1_01":
        return (f"CASE WHEN {ok} THEN 'pass' ELSE 'fail' END",
                f"'注册资本' || capital_text || CASE WHEN {ok} THEN '万元，达到500万元要求' ELSE '万元，未达到500万元要求' END")
    if rule_id == "A10":
        return (f"CASE WHEN {ok} THEN 'pass' WHEN tyc_checked THEN 'fail' ELSE 'pending' END",
                f"CASE WHEN {ok} THEN '天眼查初判通过（无处罚/失信记录）' WHEN tyc_checked THEN '天眼查显示存在处罚/失信记录，需人工复核' "
                f"ELSE {text('天眼查无数据；待核验：' + rule.verify)} END")
    if rule_id == "A13":
        return "'skip'", "'非检验检测类供应商，不需要检验检测资质'"
    lacking = text("缺少" + rule.requirement)
    pending = text("材料已上传；待核验：" + rule.verify)
    if rule_id == "C1_05":
        return ("CASE WHEN needs_licence THEN 'fail' ELSE 'skip' END",
                f"CASE WHEN needs_licence THEN {lacking} || '【生产许可证（经营范围涉及「电梯」）】' "
                "ELSE '无需生产许可证（经营范围不涉及强制许可/认证产品）' END")
    if rule_id[:3] in ("C1_", "D1_") and "ISO" in rule.name:
        clash = "c" + rule.name.split()[-1]
        return (f"CASE WHEN {ok} THEN 'pending' WHEN {clash} IS NOT NULL THEN 'manual' ELSE 'fail' END",
                f"CASE WHEN {ok} THEN {pending} ELSE coalesce({clash}, {lacking}) END")
    return (f"CASE WHEN {ok} THEN 'pending' ELSE 'fail' END", f"CASE WHEN {ok} THEN {pending} ELSE {lacking} END")


def _item_rows() -> str:
    rows = []
    for rule in CATALOGUE:
        if rule.check_type == "skip":
            continue
        status, detail = item(rule.id)
        role = ("'auto'" if rule.check_type == "auto" else
                "'missing'" if rule.check_type == "material" or rule.id in ("A08", "E1") else "NULL")
        if rule.id in ("A08", "E1", "E2"):
            point = "CASE WHEN status = 'manual' THEN detail END"
        elif rule.id == "A10":
            point = f"CASE status WHEN 'fail' THEN '商业信誉：' || detail WHEN 'pending' THEN {text(rule.verify)} END"
        elif rule.check_type == "material":
            point = f"CASE WHEN status = 'pending' THEN {text(rule.verify)} END"
        else:
            point = "NULL"
        rows.append(
            f"SELECT todo_id, {text(rule.id)} AS rule_id, {text(rule.name)} AS name, {position(rule.id)} AS position, "
            f"{rule.review_order or 99} AS review_order, {text(rule.requirement or '')} AS requirement, status, detail, "
            f"CASE WHEN status = 'fail' THEN {role} END AS role, {point} AS verify "
            f"FROM (SELECT todo_id, {status} AS status, {detail} AS detail FROM base WHERE {applies(rule.id)})")
    return "items AS (" + "\nUNION ALL ".join(rows) + ")"


REQUESTS = ",\n".join([APPS, SUP, REGION, ROUTED, MAT, FLAGGED, FACTS, NAMES, BASE])
ITEMS = REQUESTS + ",\n" + _item_rows()

VERDICTS = """folded AS (
  SELECT todo_id, coalesce(bool_or(role IS NOT NULL), FALSE) AS reject, coalesce(bool_or(verify IS NOT NULL), FALSE) AS manual,
    count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'manual') AS manuals
  FROM items GROUP BY todo_id),
decided AS (
  SELECT b.todo_id, b.type_desc, b.bill_type, CASE WHEN is_foreign AND bill_type = 'P0701' THEN 'reject' WHEN is_foreign OR is_hmt THEN 'manual'
      WHEN coalesce(reject, FALSE) THEN 'reject' WHEN coalesce(manual, FALSE) THEN 'manual' ELSE 'recommend' END AS decision,
    is_foreign, is_hmt, registered_capital, capital_text, year_state,
    coalesce(failed, 0) AS failed, coalesce(manuals, 0) AS manuals
  FROM base b LEFT JOIN folded f ON b.todo_id = f.todo_id)"""

OPINION = f"""parts AS (
  SELECT todo_id,
    list(CASE WHEN rule_id = 'C1_01' THEN replace(detail, '，达到', '，未达到') ELSE rule_id || ' ' || name || '未达标' END
      ORDER BY position) FILTER (WHERE role = 'auto') AS hard,
    list('ISO ' || split_part(name, ' ', 2) ORDER BY review_order, position) FILTER (WHERE role = 'missing' AND name LIKE 'ISO%') AS iso,
    list(CASE rule_id WHEN 'A08' THEN '缺少经审计的上年度财报（须为上一年度，须含资产负债表、利润表、现金流量表及审计意见）'
      WHEN 'C1_05' THEN requirement || '【生产许可证（经营范围涉及「电梯」）】' ELSE requirement END
      ORDER BY review_order, position) FILTER (WHERE role = 'missing' AND name NOT LIKE 'ISO%') AS other,
    list(verify ORDER BY position) FILTER (WHERE verify IS NOT NULL) AS points FROM items GROUP BY todo_id),
lines AS (
  SELECT d.*, coalesce(hard, []) AS hard, coalesce(points, []) AS points,
    list_concat(CASE WHEN len(coalesce(iso, [])) > 0 THEN [list_aggregate(iso, 'string_agg', '、') || ' 认证证书' ||
      CASE WHEN type_desc LIKE '%贸易%' THEN '（ISO 9001可上传代理厂家的认证，14001/45001须为贵司自己的认证；均须在有效期内）'
      ELSE '（须为贵司认证且在有效期内）' END] ELSE [] END, coalesce(other, [])) AS supplements
  FROM decided d LEFT JOIN parts p ON d.todo_id = p.todo_id),
written AS (
  SELECT *, CASE
    WHEN is_foreign AND bill_type = 'P0701' THEN '退回。国外供应商请通过中交海外采购专区进行注册申请。'
    WHEN is_foreign THEN '转人工复核。国外供应商（审查类型：' || bill_type || '），需人工审核。'
    WHEN is_hmt THEN '转人工复核。港澳台地区供应商需人工审批。'
    WHEN decision = 'reject' THEN list_aggregate(list_concat(['退回。'],
      CASE WHEN len(hard) > 0 THEN list_concat(['存在问题：'], list_transform(hard, lambda x, i: '  ' || i || '. ' || x)) ELSE [] END,
      CASE WHEN len(supplements) > 0 THEN list_concat(['请补充资质文件：'],
        list_transform(supplements, lambda x, i: '  ' || (i + len(hard)) || '. ' || x)) ELSE [] END), 'string_agg', chr(10))
    WHEN decision = 'manual' THEN list_aggregate(list_concat(['转人工复核。材料齐全，以下核验点需人工/后续自动核验：'],
      list_transform(points, lambda x, i: '  ' || i || '. ' || x)), 'string_agg', chr(10))
    ELSE '建议同意。该供应商材料齐全、各项核验通过。（初期设置：需人工核实后再执行通过操作）' END AS opinion FROM lines)"""

_ISO_NO = "CASE rule_id WHEN 'C1_02' THEN '9001' WHEN 'C1_03' THEN '14001' WHEN 'C1_04' THEN '45001' WHEN 'D1_03' THEN '9001' WHEN 'D1_04' THEN '14001' WHEN 'D1_05' THEN '45001' END"
FINAL = f"""marked AS (
  SELECT i.*, status = 'fail' AS failed, detail LIKE '缺少%' AS lacking, {_ISO_NO} AS iso_no,
    '[' || rule_id || ']' || i.name || '：' AS tag, year_state IN ('missing', 'mismatch') AS needs_report, b.todo_id AS t
  FROM items i JOIN base b ON i.todo_id = b.todo_id),
grouped AS (
  SELECT todo_id, bool_or(failed) AS any_fail, bool_or(failed AND lacking) AS any_lacking,
    bool_or(role IS NOT NULL) AS reject, bool_or(verify IS NOT NULL) AS manual,
    bool_or(needs_report AND rule_id = 'A08') AS report,
    list(DISTINCT 'ISO ' || iso_no ORDER BY 'ISO ' || iso_no) FILTER (WHERE failed AND lacking AND iso_no IS NOT NULL) AS iso_set,
    list(iso_no ORDER BY position) FILTER (WHERE failed AND lacking AND iso_no IS NOT NULL) AS iso,
    list(CASE WHEN rule_id = 'A07' THEN '缺少售后服务五星认证或售后服务承诺函' ELSE detail END ORDER BY position)
      FILTER (WHERE failed AND lacking AND iso_no IS NULL AND NOT (rule_id = 'A08' AND needs_report)) AS lack,
    list(tag || detail || '；请整改并提交符合要求的材料' ORDER BY position)
      FILTER (WHERE failed AND NOT lacking AND NOT (rule_id = 'A08' AND needs_report)) AS fix,
    list(tag || CASE WHEN length(detail) > 100 THEN left(detail, 100) || '…' ELSE detail END ORDER BY position)
      FILTER (WHERE failed AND NOT lacking) AS fail_notes,
    list(tag || CASE WHEN length(detail) > 100 THEN left(detail, 100) || '…' ELSE detail END ORDER BY position)
      FILTER (WHERE status IN ('pending', 'partial', 'manual')) AS notes,
    list(tag || CASE WHEN length(detail) > 100 THEN left(detail, 100) || '…' ELSE detail END ORDER BY position)
      FILTER (WHERE status IN ('pending', 'partial', 'manual') AND NOT (rule_id = 'A08' AND needs_report)) AS back_notes
  FROM marked GROUP BY todo_id),
supplemented AS (
  SELECT *, list_concat(
    CASE WHEN len(coalesce(iso, [])) > 0 THEN [list_aggregate(list_transform(iso, lambda x: 'ISO ' || x), 'string_agg', '、') || ' 体系认证证书（须为你公司认证且在有效期内）'] ELSE [] END,
    coalesce(lack, []),
    CASE WHEN report THEN ['缺少经审计的上年度财报（须为上一年度，须含资产负债表、利润表、现金流量表及审计意见）'] ELSE [] END,
    coalesce(fix, [])) AS supplements FROM grouped)"""

_TYPES = [("after_sales_cert", None), ("business_license", "licence"), ("financial_report", "financial"),
          ("iso14001", "iso14001"), ("iso45001", "iso45001"), ("iso9001", "iso9001"), ("legal_person_id", "id_card"),
          ("tax_cert", "tax_cert"), ("tax_credit", "tax_credit"), ("transport_license", "transport")]


def types_text(prefix: str = "") -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN {prefix}{column} THEN '{kind}' END" for kind, column in _TYPES if column) + ")"


_MISSING = []
for _rule, (_column, _label) in {
    "A01": ("licence", "营业执照副本"), "A02": ("id_card", "法人身份证正反面"), "A03": ("tax_credit", "纳税信用等级证明"),
    "A07": (None, "售后服务承诺（机构认证证书或厂家/供应商承诺函）"), "A08": ("financial", "经审计的上年度财报"),
    "C1_02": ("iso9001", "ISO9001 体系认证证书"), "C1_03": ("iso14001", "ISO14001 环境管理体系证书"),
    "C1_04": ("iso45001", "ISO45001 职业健康安全证书"), "C1_05": (None, "生产许可证/强制认证"),
    "E1": ("transport", "道路运输许可证/无船承运证明"), "E2": ("performance", "过往业绩证明"),
    "D1_03": ("iso9001", "ISO9001 质量管理体系认证证书"), "D1_04": ("iso14001", "ISO14001 环境管理体系证书"),
    "D1_05": ("iso45001", "ISO45001 职业健康安全证书"), "D1_06": (None, "产品代理协议或销售授权"),
}.items():
    _lack = f"NOT coalesce({_column}, FALSE)" if _column else "TRUE"
    _need = " AND needs_licence" if _rule == "C1_05" else ""
    _MISSING.append(f"SELECT todo_id, '{_rule}' AS rule_id, {text(_label)} AS label FROM base "
                    f"WHERE {applies(_rule)} AND {_lack}{_need}")

READ = """reading AS (
  SELECT todo_id, type_name AS doc_type, part_id AS position, file_name AS file, check_value, valid_until,
    concat_ws('/', lpad(CAST(issuer_id AS VARCHAR), 12, '0'), CAST(CAST(tie_break AS DECIMAL(18,2)) AS VARCHAR), strftime(valid_until, '%Y-%m-%d'),
      CASE check_value WHEN TRUE THEN 'true' WHEN FALSE THEN 'false' ELSE 'none' END) AS doc_id FROM mat)"""

_AT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
CHAIN = f"""ev AS (SELECT user_id AS key, event_id AS seq, event_id // 1024 AS segment, {_AT} AS moment, event_type AS kind, props AS payload, value FROM events),
chains AS (SELECT key, segment, list(moment || kind || payload ORDER BY seq) AS rows FROM ev GROUP BY key, segment)"""
_FOLD = "list_reduce(list_prepend(repeat('0', 64), {rows}), lambda acc, x: sha256(acc || x))"

ENGINES = """docs2 AS (
  SELECT d.doc_id, lang AS doc_type, source AS owner, n_chars AS size, contains(text, 'token') AS secret, quality, toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
pairs AS (
  SELECT doc_id, doc_type, 'field' AS kind, 'owner' AS key, TRUE AS same FROM docs2
  UNION ALL SELECT doc_id, doc_type, 'field', 'size', TRUE FROM docs2 WHERE quality = 1
  UNION ALL SELECT doc_id, doc_type, 'check', 'long', (size > 1000) = (quality = 1) FROM docs2
  UNION ALL SELECT doc_id, doc_type, 'check', 'secret', secret AND toxic = 1 FROM docs2)"""

_DAY = "strftime(valid_until, '%Y-%m-%d')"
_ASOF = f"DATE '{AS_OF}'"
PARTIES = """party AS (
  SELECT m.*, a.supplier_id, m.todo_id || '-' || m.position || '-' || m.part_id || '-' || m.issuer_id || '-' || m.tie_break AS doc_id
  FROM mat m JOIN app a ON m.todo_id = a.todo_id)"""

_CERT = []


def _cert(place: int, kind: str, key: str, value: str, where: str = "TRUE") -> None:
    _CERT.append(f"SELECT doc_id, '{kind}' AS doc_type, {text(key)} AS check_key, {value} AS check_value FROM party "
                 f"WHERE position {'= ' + str(place) if place < 7 else '>= 7'} AND {where}")


_OWN = "CASE WHEN check_value IS NOT NULL THEN 'true' ELSE 'false' END"
_VALID = f"CASE WHEN valid_until >= {_ASOF} THEN 'true' ELSE 'false' END"
for _place, _kind in ((1, "iso9001"), (2, "iso14001")):
    _cert(_place, _kind, "材料类型正确", "'true'")
    _cert(_place, _kind, "持有人一致", _OWN)
    _cert(_place, _kind, "在有效期内", _VALID)
_cert(3, "tax_credit", "C级及以上", "CASE WHEN part_id % 4 = 3 THEN 'false' ELSE 'true' END")
_cert(3, "tax_credit", "评价年度=2000", "CASE WHEN year(valid_until) = 2000 THEN 'true' ELSE 'false' END", "year(valid_until) >= 2000")
_cert(4, "authorization", "被授权方为本公司", _OWN)
_cert(4, "authorization", "在有效期内", _VALID)
_cert(5, "after_sales_statement", "材料类型正确", "'true'")
_cert(5, "after_sales_statement", "落款时间在3个月内",
      f"CASE WHEN date_diff('day', valid_until, {_ASOF}) BETWEEN 0 AND 92 THEN 'true' ELSE 'false' END")
_cert(6, "transport_license", "材料类型正确", "'true'")
_cert(6, "transport_license", "在有效期内", _VALID)
_cert(7, "tax_cert", "在有效期内", _VALID)

_K = "CAST(user_id AS VARCHAR) || '-' || json_extract_string(props, '$.k')"

ORACLES: dict[str, str] = {
    "request_page": f"""WITH {APPS}, {SUP} SELECT todo_id, name, bill_type, strftime(apply_date, '%Y-%m-%d') AS apply_date
FROM app JOIN sup ON app.supplier_id = sup.supplier_id
WHERE (lower(name) LIKE '%99%' OR CAST(todo_id AS VARCHAR) LIKE '%99%') AND bill_type = 'P0702'
ORDER BY app.apply_date DESC, todo_id LIMIT 50 OFFSET 50""",
    "region_routing": f"""WITH {APPS}, {SUP}, {REGION} SELECT todo_id, is_overseas, is_hmt, is_foreign,
CASE WHEN is_foreign AND bill_type = 'P0701' THEN 'reject' WHEN is_foreign OR is_hmt THEN 'manual' ELSE 'rules' END AS route
FROM app JOIN region2 r ON app.supplier_id = r.supplier_id""",
    "rule_set_routing": f"""WITH {APPS}, {SUP}, {REGION}, {ROUTED}, pairs AS (
{" UNION ALL ".join(f"SELECT supplier_id, '{r.id}' AS rule_id, {position(r.id)} AS position FROM routed WHERE {applies(r.id)}" for r in CATALOGUE)}),
listed AS (SELECT supplier_id, count(*) AS rule_count, string_agg(rule_id, ',' ORDER BY position) AS rule_ids FROM pairs GROUP BY supplier_id)
SELECT todo_id, type_desc, CAST(rule_count AS INTEGER) AS rule_count, rule_ids FROM app JOIN routed s ON app.supplier_id = s.supplier_id
JOIN listed l ON s.supplier_id = l.supplier_id""",
    "rule_eval": f"WITH {REQUESTS} " + " UNION ALL ".join(
        f"SELECT todo_id, '{rule}' AS rule_id, {ok} AS ok FROM base" for rule, ok in OKS.items()),
    "material_keyword": f"""WITH {MAT}, {FLAGGED}, {FACTS} SELECT todo_id, uploads, {types_text()} AS types,
concat_ws(',', CASE WHEN iso14001 THEN 'ISO14001' END, CASE WHEN iso45001 THEN 'ISO45001' END, CASE WHEN iso9001 THEN 'ISO9001' END) AS certifications
FROM facts""",
    "material_first_match": f"""WITH {MAT}, named AS (SELECT todo_id, CASE WHEN file_name LIKE '%道路运输%' THEN 'transport_license'
WHEN file_name LIKE '%财报%' THEN 'financial_report' WHEN file_name LIKE '%纳税%' THEN 'tax_credit' WHEN file_name LIKE '%9001%' THEN 'iso9001'
WHEN file_name LIKE '%14001%' THEN 'iso14001' WHEN file_name LIKE '%45001%' THEN 'iso45001' ELSE 'none' END AS name_type FROM mat)
SELECT todo_id, name_type, count(*) AS uploads FROM named GROUP BY ALL""",
    "slot_conflicts": f"""WITH {MAT}, {FLAGGED} SELECT todo_id, position, file_name AS file, type_name AS slot, slot_no AS expected_code,
name_no AS actual_code FROM mat4 WHERE clash""",
    "public_gate": f"""WITH {MAT}, {FLAGGED}, owners AS (SELECT todo_id, bool_or(position = 1) AS has_licence FROM mat4 GROUP BY todo_id),
named AS (SELECT todo_id, file_name, bool_or(position = 1) AS licence, bool_or(position = 2) AS id_card, bool_or(position = 3) AS tax_cert,
bool_or(tax_credit) AS tax_credit, bool_or(iso9001) AS iso9001, bool_or(iso14001) AS iso14001, bool_or(iso45001) AS iso45001,
bool_or(financial) AS financial, bool_or(transport) AS transport, bool_or(financial OR position = 2) AS sensitive FROM mat4 GROUP BY ALL),
files AS (SELECT DISTINCT todo_id, file_name, issuer_id || '_' || file_name AS file FROM mat4),
typed AS (SELECT f.todo_id, f.file, concat_ws(',', CASE WHEN licence THEN 'business_license' END, CASE WHEN financial THEN 'financial_report' END,
CASE WHEN iso14001 THEN 'iso14001' END, CASE WHEN iso45001 THEN 'iso45001' END, CASE WHEN iso9001 THEN 'iso9001' END,
CASE WHEN id_card THEN 'legal_person_id' END, CASE WHEN sensitive THEN 'sensitive' END, CASE WHEN tax_cert THEN 'tax_cert' END,
CASE WHEN tax_credit THEN 'tax_credit' END, CASE WHEN transport THEN 'transport_license' END) AS types,
NOT (financial OR id_card OR sensitive) AS allowed FROM files f JOIN named n ON f.todo_id = n.todo_id AND f.file_name = n.file_name)
SELECT todo_id, file, types, allowed AND types <> '' AS is_public FROM typed""",
    "proof_texts": f"""WITH {MAT}, {FLAGGED}, {NAMES} SELECT todo_id, performance_files, transport_files FROM names""",
    "title_years": f"""WITH {REQUESTS} SELECT todo_id, coalesce(financial, FALSE) AS submitted, year_state AS status, 2000 AS required_year,
coalesce(years, '') AS title_years FROM base""",
    "missing_materials": f"WITH {REQUESTS} " + " UNION ALL ".join(_MISSING),
    "checklist": f"WITH {ITEMS} SELECT todo_id, rule_id, status, detail FROM items",
    "decision": f"WITH {ITEMS}, {VERDICTS} SELECT todo_id, type_desc, decision FROM decided",
    "decision_summary": f"""WITH {ITEMS}, {VERDICTS} SELECT decision, count(*) AS requests, CAST(sum(failed) AS BIGINT) AS failed_items,
CAST(sum(manuals) AS BIGINT) AS manual_items FROM decided GROUP BY decision""",
    "opinion_text": f"WITH {ITEMS}, {VERDICTS}, {OPINION} SELECT todo_id, decision, opinion FROM written",
    "opinion_final": f"""WITH {ITEMS}, {FINAL}, texts AS (SELECT todo_id, CASE WHEN any_lacking OR report OR reject THEN
concat_ws(chr(10), CASE WHEN len(supplements) > 0 THEN '退回。' || list_aggregate(list_transform(supplements, lambda x, i: i || '. ' || x), 'string_agg', '；') || '。补充后重新提交。'
  ELSE '退回。具体见上方审查报告。' END,
  CASE WHEN len(coalesce(back_notes, [])) > 0 THEN '另需整改/核实：' || list_aggregate(back_notes, 'string_agg', '；') || '。' END)
WHEN any_fail OR manual OR len(coalesce(notes, [])) > 0 THEN concat_ws(chr(10), CASE WHEN report THEN '需补充：经审计的上年度财报。' END,
  '转人工。' || list_aggregate(list_concat(coalesce(fail_notes, []), coalesce(notes, [])), 'string_agg', '；'))
ELSE '同意。各项审核均通过，建议后续常规管理。' END AS final_opinion FROM supplemented)
SELECT b.todo_id, coalesce(final_opinion, '转人工。缺少核验清单，无法确认审核完成。') AS final_opinion
FROM base b LEFT JOIN texts t ON b.todo_id = t.todo_id""",
    "registry_match": f"""WITH {SUP}, reg AS (SELECT 'C' || s_suppkey AS k, s_suppkey FROM supplier
UNION ALL SELECT 'A' || CAST(floor(s_acctbal) AS BIGINT), min(s_suppkey) FROM supplier GROUP BY 1
UNION ALL SELECT n_name, min(s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT s.supplier_id, CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 WHEN c.k IS NOT NULL THEN 2 END AS match_rank,
coalesce(a.s_suppkey, b.s_suppkey, c.s_suppkey) AS registry_id FROM sup s LEFT JOIN reg a ON a.k = 'C' || s.supplier_id
LEFT JOIN reg b ON b.k = 'A' || CAST(floor(registered_capital) AS BIGINT) LEFT JOIN reg c ON c.k = country_name""",
    "related_parties": """SELECT c_custkey, c_name AS name, CASE WHEN c_name LIKE '%0099%' THEN '0099' WHEN c_name LIKE '%77%' THEN '77'
ELSE '123' END AS related_word FROM customer WHERE c_name LIKE '%0099%' OR c_name LIKE '%77%' OR c_name LIKE '%123%'""",
    "name_close": """SELECT l_orderkey AS todo_id, l_linenumber AS position, CAST(o_custkey AS VARCHAR) AS person, CAST(l_suppkey AS VARCHAR) AS card,
CASE WHEN o_custkey = l_suppkey THEN 'same' WHEN levenshtein(CAST(o_custkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) = 1 THEN 'close'
ELSE 'different' END AS verdict FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "attachment_ordinals": f"""WITH {MAT}, {READ}, ranked AS (SELECT *, row_number() OVER w AS ordinal,
count(*) OVER (PARTITION BY todo_id, doc_type) AS documents FROM reading WINDOW w AS (PARTITION BY todo_id, doc_type ORDER BY position, doc_id))
SELECT todo_id, doc_type, ordinal, documents, doc_id,
CASE WHEN documents > 1 THEN '附件' || ordinal || '(' || file || ') ' ELSE '' END || '在有效期内' AS check_key, check_value,
CASE WHEN check_value = FALSE THEN CASE WHEN documents > 1 THEN '附件' || ordinal || '(' || file || ')：' ELSE '' END || '证书已过期' ELSE '' END AS issues
FROM ranked""",
    "attachment_combine": f"""WITH {MAT}, {READ} SELECT todo_id, doc_type, count(*) AS documents,
count(*) FILTER (WHERE check_value) AS n_yes, count(*) FILTER (WHERE NOT check_value) AS n_no, count(*) FILTER (WHERE check_value IS NULL) AS n_open,
count(*) FILTER (WHERE NOT check_value) AS n_issues,
CASE WHEN bool_or(NOT check_value) THEN 'fail' WHEN count(check_value) = count(*) THEN 'pass' WHEN bool_or(check_value) THEN 'partial' ELSE 'unchanged' END AS status
FROM reading GROUP BY todo_id, doc_type""",
    "severity_combine": f"""WITH {MAT} SELECT todo_id, type_name, CASE WHEN bool_or(check_value = FALSE) THEN 'fail'
WHEN bool_or(check_value IS NULL) THEN 'manual' ELSE 'pass' END AS status FROM mat GROUP BY todo_id, type_name""",
    "confidence_distribution": """WITH m AS (SELECT l_orderkey, min(1 - l_discount) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
o AS (SELECT round(v, 4) AS v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM m)
SELECT (SELECT count(*) FROM m) AS documents, (SELECT v FROM o WHERE r = n // 2 + 1) AS document_minimum_median,
(SELECT count(*) FROM m WHERE v < 0.7) AS documents_below_0_70, (SELECT count(*) FROM m WHERE v < 0.8) AS documents_below_0_80,
(SELECT count(*) FROM m WHERE v < 0.9) AS documents_below_0_90""",
    "certificate_checks": f"WITH {APPS}, {MAT}, {PARTIES} " + " UNION ALL ".join(_CERT),
    "certificate_terms": f"""WITH {APPS}, {MAT}, {PARTIES} SELECT doc_id, {_DAY} AS valid_until,
CASE WHEN valid_until < {_ASOF} THEN '证书已过期（' || {_DAY} || '）' ELSE '' END AS issues FROM party""",
    "licence_checks": f"""WITH {APPS}, {SUP}, c AS (SELECT *, CAST(round(abs(registered_capital)) AS BIGINT) AS stated FROM app JOIN sup ON app.supplier_id = sup.supplier_id),
k AS (SELECT *, stated > 0 AND registered_capital <> 0 AS cap_known, abs(stated - registered_capital) / greatest(registered_capital, 1) <= 0.01 AS cap_ok FROM c),
-- first characters of the system's scope, kind of licence, outcome and share of matching blocks
likeness(head, kind, ok, share) AS (VALUES
  ('机械', 3, 'none', '80.00%'), ('机械', 4, 'false', '0.00%'), ('机械', 5, 'none', '90.00%'), ('机械', 7, 'none', '81.82%'),
  ('国际', 3, 'none', '80.00%'), ('国际', 4, 'false', '0.00%'), ('国际', 5, 'none', '90.00%'), ('国际', 7, 'none', '72.73%'),
  ('工程', 3, 'none', '76.19%'), ('工程', 4, 'false', '0.00%'), ('工程', 5, 'none', '75.00%'), ('工程', 7, 'none', '77.78%'),
  ('技术', 3, 'none', '85.71%'), ('技术', 4, 'none', '0.00%'), ('技术', 5, 'none', '93.33%'), ('技术', 7, 'none', '93.75%')),
m AS (SELECT k.*, CASE WHEN todo_id % 8 = 0 THEN 'true' ELSE coalesce(ok, 'none') END AS scope_ok, CASE WHEN todo_id % 8 = 0 THEN '100.00%' ELSE coalesce(share, '') END AS likeness
  FROM k LEFT JOIN likeness ON head = busi_scope[1:2] AND kind = todo_id % 8)
SELECT todo_id, CASE WHEN bill_type = 'P0701' THEN 'false' ELSE 'true' END AS code_ok, CASE WHEN bill_type = 'P0704' THEN 'false' ELSE 'true' END AS name_ok,
CASE WHEN is_overseas THEN 'false' ELSE 'true' END AS person_ok,
CASE WHEN NOT cap_known THEN 'none' WHEN cap_ok THEN 'true' ELSE 'false' END AS capital_ok,
CASE WHEN apply_date >= {_ASOF} THEN 'true' ELSE 'false' END AS term_ok, scope_ok, likeness,
CAST((bill_type = 'P0701')::INT + (bill_type = 'P0704')::INT + is_overseas::INT + (cap_known AND NOT cap_ok)::INT + (apply_date < {_ASOF})::INT + (stated = 0)::INT + (scope_ok <> 'true')::INT AS INTEGER) AS issues FROM m""",
    "resume_pending": f"""WITH {APPS} SELECT todo_id, bill_type FROM app WHERE todo_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
    "latest_state": """SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value
FROM events WHERE CAST(user_id AS VARCHAR) NOT LIKE '14%' GROUP BY user_id""",
    "call_counts": """SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(event_type, 'total') AS endpoint, count(*) AS calls FROM events
GROUP BY GROUPING SETS ((1), (1, event_type))""",
    "call_counts_stream": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS endpoint, count(*) AS calls FROM events GROUP BY 1, 2""",
    "expired_inventory": f"""WITH e AS (SELECT {_K} AS todo_id, event_type AS kind, ts, value FROM events),
k AS (SELECT todo_id, max(ts) FILTER (WHERE kind <> 'error') AS newest, count(*) FILTER (WHERE kind IN ('view', 'click', 'purchase')) AS file_count,
coalesce(CAST(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE kind IN ('view', 'click', 'purchase')) AS BIGINT), 0) AS size_bytes,
bool_or(kind = 'signup') AS entry, bool_or(kind = 'error') AS result FROM e GROUP BY todo_id)
SELECT todo_id, CASE WHEN result THEN '结果' || todo_id WHEN entry THEN '公司' || todo_id ELSE '未知供应商（' || todo_id || '）' END AS name,
strftime(newest, '%Y-%m-%d %H:%M:%S.%f') AS cached_at,
CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(newest))) / 86400) AS INTEGER) AS age_days, file_count, size_bytes
FROM k WHERE newest < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY""",
    "first_claims": """SELECT event_id AS seq, user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS accepted FROM events""",
    "audit_chain_head": f"""WITH {CHAIN} SELECT key, segment, CAST(len(rows) AS INTEGER) AS events, {_FOLD.format(rows='rows')} AS head FROM chains""",
    "audit_chain_broken": f"""WITH {CHAIN}, numbered AS (SELECT *, row_number() OVER (PARTITION BY key, segment ORDER BY seq) AS i FROM ev),
linked AS (SELECT n.*, {_FOLD.format(rows='rows[1:i-1]')} AS previous, {_FOLD.format(rows='rows[1:i]')} AS hash
FROM numbered n JOIN chains c ON n.key = c.key AND n.segment = c.segment),
kept AS (SELECT *, lag(hash, 1, repeat('0', 64)) OVER (PARTITION BY key, segment ORDER BY seq) AS before FROM linked WHERE NOT (kind = 'purchase' AND value < 5)),
judged AS (SELECT key, segment, seq, previous <> before AS broken_link,
hash <> sha256(previous || moment || kind || CASE WHEN kind = 'error' THEN replace(payload, ' ', '') ELSE payload END) AS broken_hash FROM kept)
SELECT * FROM judged WHERE broken_link OR broken_hash""",
    "audit_chain_gap": """WITH RECURSIVE e AS (SELECT user_id AS key, event_id // 256 AS segment,
((user_id % 5 = 0 AND event_id // 256 % 4 = 1) OR (user_id % 5 = 1 AND event_id // 256 % 4 = 2 AND event_id % 256 >= 128)) AS gone FROM events),
top AS (SELECT max(segment) AS last FROM e),
levels AS (SELECT 0 AS level, 1 AS width UNION ALL SELECT level + 1, width * 8 FROM levels, top WHERE level = 0 OR last // width > 0),
b AS (SELECT key, level, segment // width AS block, count(*) AS was, count(*) FILTER (WHERE gone) AS lost FROM e, levels GROUP BY ALL)
SELECT key, level, block, CASE WHEN lost = was THEN 'missing' ELSE 'changed' END AS problem, lost FROM b WHERE lost > 0""",
    "valid_results": f"""WITH {APPS}, r AS (SELECT todo_id, CASE WHEN bill_type = 'P0704' THEN 'offline' ELSE 'online' END AS ocr_mode FROM app)
SELECT * FROM r WHERE EXISTS (SELECT 1 FROM events WHERE user_id = todo_id AND CASE WHEN event_type IN ('click', 'view') THEN 'online'
WHEN event_type = 'error' THEN 'offline' END = ocr_mode)""",
    "results_in_force": f"""WITH {APPS}, last AS (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id)
SELECT todo_id, CASE bill_type WHEN 'P0701' THEN 'reject' ELSE 'manual' END AS decision FROM app LEFT JOIN last ON todo_id = user_id
WHERE bill_type <> 'P0704' AND coalesce(kind, '') NOT IN ('error', 'view')""",
    "merge_results": """SELECT o_orderkey AS todo_id, 'new' AS decision FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 'old-' || o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT'
AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "identity_violations": """SELECT todo_id, violations FROM (SELECT o_orderkey AS todo_id, concat_ws(',',
CASE WHEN NOT regexp_full_match(o_orderpriority, '[A-Za-z0-9_-]+') THEN 'task_id' END,
CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'oper_code' END) AS violations FROM orders) WHERE violations <> ''""",
    "fresh_tasks": """SELECT o_orderkey AS todo_id, CASE WHEN o_totalprice >= 450000 THEN 'todo_id' ELSE concat_ws(',',
CASE WHEN o_totalprice > 300000 THEN 'task_id' END, CASE WHEN o_orderstatus <> 'O' THEN 'work_item_status' END) END AS mismatches FROM orders""",
    "mask_documents": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '[IP]', 'g'),
'token = "[0-9A-Za-z]+"', 'token = "[SECRET]"', 'g'), '[0-9]{16}', '[NUMBER]', 'g') AS text FROM documents""",
    "extract_dedupe": """WITH d AS (SELECT doc_id, lang AS doc_type, source, CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS sha256 FROM documents),
r AS (SELECT sha256, doc_type, coalesce(min(doc_id) FILTER (WHERE source = 'src0'), min(doc_id)) AS reading FROM d WHERE sha256 IS NOT NULL GROUP BY ALL)
SELECT doc_id, d.doc_type, d.sha256, coalesce(reading, doc_id) AS reading FROM d LEFT JOIN r ON d.sha256 = r.sha256 AND d.doc_type = r.doc_type""",
    "page_text": r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))) AS rows FROM documents)
SELECT doc_id, list_aggregate(list_filter(rows, lambda x: x <> ''), 'string_agg', chr(10)) AS page_text FROM l WHERE len(list_filter(rows, lambda x: x <> '')) > 0""",
    "engine_agreement": f"""WITH {ENGINES}, per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'field') AS f, count(*) FILTER (WHERE kind = 'field' AND same) AS fs,
count(*) FILTER (WHERE kind = 'check') AS c, count(*) FILTER (WHERE kind = 'check' AND same) AS cs FROM pairs GROUP BY doc_id),
j AS (SELECT d.*, p.* EXCLUDE (doc_id), FALSE AS pass_a, quality = 1 AND toxic = 1 AS pass_b FROM docs2 d JOIN per p ON d.doc_id = p.doc_id)
SELECT coalesce(doc_type, 'total') AS doc_type, count(*) AS documents, CAST(sum(f) AS BIGINT) AS comparable_fields, CAST(sum(fs) AS BIGINT) AS matching_fields,
CAST(sum(c) AS BIGINT) AS comparable_checks, CAST(sum(cs) AS BIGINT) AS matching_checks, count(*) FILTER (WHERE pass_a = pass_b) AS same_pass_decision,
count(*) FILTER (WHERE pass_a) AS auto_pass_a, count(*) FILTER (WHERE pass_b) AS auto_pass_b, count(*) FILTER (WHERE size < 500) AS low_confidence_documents
FROM j GROUP BY ROLLUP (doc_type)""",
    "engine_mismatches": f"""WITH {ENGINES} SELECT kind, doc_type || ':' || key AS item, count(*) AS mismatches FROM pairs WHERE NOT same GROUP BY 1, 2""",
    "stratified_sample": """WITH r AS (SELECT source AS kind, doc_id, n_chars AS size, row_number() OVER w AS rn, count(*) OVER (PARTITION BY source) AS n
FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)), s AS (SELECT *, greatest(1, n // 5) AS step FROM r)
SELECT kind, CAST((rn - 1) // step + 1 AS INTEGER) AS pick, doc_id, size FROM s WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 5""",
}
