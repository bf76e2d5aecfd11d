"""Word lists, lookup tables, labels, messages and text patterns.

They decide results, so they are kept as they must be, in one place and in plain text.
"""

# --- decisions and statuses -------------------------------------------------
DECISIONS = ["reject", "manual", "recommend", "skip"]
STATUS_RANK = {"fail": 4, "manual": 3, "partial": 2, "pending": 2, "pass": 1, "skip": 0}
UNKNOWN_RANK = 3
BILL_TYPES = ["P0701", "P0702", "P0704"]
OPER_CODES = [2, 3]
ID_PATTERN = r"^[A-Za-z0-9_-]+$"
RETENTION_DAYS = 14
GENESIS = "0" * 64

# --- material types ---------------------------------------------------------
ISO_TYPES = ["iso9001", "iso14001", "iso45001"]
ISO_CODES = ["9001", "14001", "45001"]
PUBLIC_TYPES = [
    "business_license", "iso9001", "iso14001", "iso45001", "tax_credit", "tax_cert",
    "production_license", "after_sales_cert", "after_sales_statement", "transport_license",
]
SENSITIVE_NAME = r"(?i)身份证|证件|财务|财报|审[计记]|资产负债|利润表|现金流|银行|账号|保密|涉密|id.?card"
EXPLICIT_INSPECTION = r"(?i)检验检测机构资质|检验检测资质|资质认定证书|CMA|实验室认可|计量认证|检定校准"
# the same as plain words and what is left of the patterns: words are found many times faster than alternatives of a pattern
SENSITIVE_WORDS = ["身份证", "证件", "财务", "财报", "审计", "审记", "资产负债", "利润表", "现金流", "银行", "账号", "保密", "涉密"]
SENSITIVE_CASED = r"(?i)id.?card"
EXPLICIT_WORDS = ["检验检测机构资质", "检验检测资质", "资质认定证书", "实验室认可", "计量认证", "检定校准"]
EXPLICIT_CASED = r"(?i)CMA"
CANONICAL_LICENSE_SLOTS = ["营业执照副本图片", "营业执照"]
TRANSPORT_WORDS = ["道路运输", "无船承运"]

SLOT_TYPES = {
    "营业执照副本图片": "business_license",
    "营业执照": "business_license",
    "法人代表身份证复印件": "legal_person_id",
    "法人代表身份证": "legal_person_id",
    "法人身份证正反面": "legal_person_id",
    "税务登记证图片": "tax_cert",
    "税务登记证图片（含增值税一般纳税人红章页面）": "tax_cert",
    "质量管理体系认证证书": "iso9001",
    "环境管理体系认证证书": "iso14001",
    "职业健康安全管理体系认证证书": "iso45001",
    "健康安全管理体系认证证书": "iso45001",
    "财务报表": "financial_report",
    "审计报告": "financial_report",
    "财务审计报告": "financial_report",
    "开户许可证图片": "bank_permit",
    "专利证书图片": "product_cert",
    "产品认证证书图片": "product_cert",
    "检验检测报告图片": "product_cert",
    "检验检测机构资质认定证书": "inspection_cert",
    "资质认定证书": "inspection_cert",
    "CMA资质证书": "inspection_cert",
    "经销代理资格证明图片": "authorization",
    "产品销售授权证明图片": "authorization",
    "代理协议图片": "authorization",
    "授权书图片": "authorization",
}

KEYWORD_TYPES = [
    ("检验检测机构资质", "inspection_cert"), ("检验检测资质", "inspection_cert"),
    ("资质认定证书", "inspection_cert"), ("资质认定", "inspection_cert"),
    ("CMA", "inspection_cert"), ("CNAS", "inspection_cert"),
    ("实验室认可", "inspection_cert"), ("计量认证", "inspection_cert"), ("检定校准", "inspection_cert"),
    ("9001", "iso9001"), ("ISO9001", "iso9001"), ("ISO 9001", "iso9001"), ("质量管理体系", "iso9001"),
    ("14001", "iso14001"), ("ISO14001", "iso14001"), ("ISO 14001", "iso14001"), ("环境管理体系", "iso14001"),
    ("45001", "iso45001"), ("ISO45001", "iso45001"), ("ISO 45001", "iso45001"),
    ("职业健康安全", "iso45001"), ("健康安全管理体系", "iso45001"),
    ("纳税信用", "tax_credit"), ("纳税缴费信用", "tax_credit"), ("纳税等级", "tax_credit"),
    ("A级纳税人", "tax_credit"), ("B级纳税人", "tax_credit"), ("C级纳税人", "tax_credit"),
    ("纳税证明", "tax_cert"),
    ("财报", "financial_report"), ("审计", "financial_report"), ("资产负债表", "financial_report"),
    ("利润表", "financial_report"), ("现金流量表", "financial_report"),
    ("售后", "after_sales_cert"), ("五星", "after_sales_cert"), ("服务认证", "after_sales_cert"),
    ("授权书", "authorization"), ("代理协议", "authorization"), ("委托书", "authorization"),
    ("销售授权", "authorization"),
    ("生产许可", "production_license"),
    ("道路运输", "transport_license"), ("无船承运", "transport_license"),
    ("强制认证", "production_license"), ("3C认证", "production_license"),
    ("检测报告", "product_cert"), ("检验报告", "product_cert"), ("产品认证", "product_cert"),
    ("CE认证", "product_cert"), ("UL认证", "product_cert"),
    ("营业执照", "business_license"),
    ("法人", "legal_person_id"), ("身份证", "legal_person_id"),
]

# first matching line wins; the type is the one stated
NAME_TYPES = [
    (["道路运输", "无船承运"], "transport_license"),
    (["营业执照", "执照"], "business_license"),
    (["身份证"], "legal_person_id"),
    (["财务", "审计", "审记", "财报"], "financial_report"),
    (["纳税"], "tax_credit"),
    (["质量管理体系", "9001"], "iso9001"),
    (["环境", "14001"], "iso14001"),
    (["职业健康", "职业安全", "45001"], "iso45001"),
    (["生产许可", "强制认证", "3C"], "production_license"),
    (["授权", "代理", "经销"], "authorization"),
    (["售后", "承诺"], "after_sales_statement"),
    (["售后"], "after_sales_cert"),
]

ISO_SLOT_TYPES = {
    "质量管理体系认证证书": "iso9001",
    "环境管理体系认证证书": "iso14001",
    "职业健康安全管理体系认证证书": "iso45001",
    "健康安全管理体系认证证书": "iso45001",
}
ISO_SLOT_SUFFIXES = ["图片", "扫描件", "复印件"]
ISO14001_STEMS = ["环境管理", "环境管理体系", "环境管理体系证书", "环境管理体系认证证书"]
# words of a slot name -> the ISO number it stands for, first match wins
ISO_SLOT_WORDS = [("质量管理", "9001"), ("环境管理", "14001"), ("健康安全|职业健康", "45001")]

PERFORMANCE_VETO = ["无需", "未提交", "未提供", "空白", "模板", "样本"]
PERFORMANCE_DIRECT = [
    "业绩", "履约证明", "运输合同", "运输服务合同", "承运合同", "物流合同", "物流服务合同",
    "委托代理合同", "货运代理合同", "运输代理合同", "中标通知书", "客户评价",
]
PERFORMANCE_SLOT = "合作业绩证明"
PERFORMANCE_PLAUSIBLE = ["合同", "协议", "业绩", "履约", "中标", "订单", "客户评价"]

FINANCIAL_TITLE = [
    "财务报表", "财务报告", "财报", "审计报告", "审记报告", "资产负债表", "利润表", "现金流量表",
]
TITLE_YEAR = r"(?<!\d)(20\d{2})(?!\d)"
PERIOD_KEYS = ["报告期", "报告年度", "ReportDate"]

FILE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".bmp", ".gif", ".pdf", ".doc", ".docx", ".xls", ".xlsx"]
ID_CARD_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp", ".pdf"]
ID_CARD_NAME_WORDS = ["身份证", "id_card"]
NOT_ID_CARD_WORDS = [
    "营业执照", "执照", "营业", "税务", "纳税", "信用", "质量", "ISO", "授权", "代理", "经销",
    "声明", "承诺", "售后", "生产", "许可", "强制", "3C", "检验", "检测", "资质", "证书",
    "审计", "财报", "财务", "报告", "专利", "商标", "ICP",
]
PERSON_IMAGE_NAME = r"^(?:\d+_)?[\u4e00-\u9fa5]{2,4}\.(?:jpg|jpeg|png)$"

# --- supplier profile and routing -------------------------------------------
HMT_WORDS = ["香港", "澳门", "台湾", "Hong Kong", "Macao", "Taiwan", "港澳台"]
MANUFACTURER_TYPE_WORDS = ["厂家", "生产商", "制造商", "生产"]
INSPECTION_NAME_WORDS = ["检验", "检测", "检定", "校准", "实验室"]
INSPECTION_SCOPE_WORDS = [
    "检验检测", "检测服务", "检验服务", "检定", "校准", "实验室认可", "检测实验室", "检验实验室",
    "实验室检测", "实验室检验", "测试中心", "检验机构", "检测机构",
]
SCOPE_NEGATIONS = ["不含", "不包括", "不涉及"]
LICENSE_SCOPE_WORDS = [
    "食品", "食品生产", "化工", "化学原料", "农药", "危险化学品", "危化", "水泥", "压力容器",
    "电梯", "起重机械", "起重设备", "制冷设备", "燃气器具", "化肥", "饲料", "化妆品", "医疗器械生产",
]
CCC_SCOPE_WORDS = [
    "电线", "电缆", "开关", "灯具", "照明", "电机", "电池", "充电器", "家用电器", "家电", "玩具",
    "安全玻璃", "汽车零部件", "汽车配件", "低压电器", "插头", "插座", "电焊机",
]
LABEL_SEPARATORS = r"(?U)[/／、,，;；|\s]+"
CARRIER_LABELS = [
    "运输商", "承运商", "运输服务商", "道路运输商", "物流运输商",
    "物流服务商", "货运代理商", "国际货运代理商", "货代服务商",
]
CARRIER_SIDE_LABELS = ["仓储服务商", "仓储商"]
GENERIC_LABELS = ["服务商", "代理商", "其他", "一般供应商"]
CARRIER_SCOPE = (
    r"(?:国际|国内|海上|航空|陆路|铁路|集装箱)?货(?:物)?运输代理(?:服务)?"
    r"|(?:国际|国内)?货运代理(?:服务)?"
    r"|(?:国际|国内)?运输代理(?:业务|服务)?"
    r"|无船承运(?:业务)?|道路货物运输(?:服务)?|普通货运|网络货运"
)
TRADE_SCOPE_WORDS = ["销售", "批发", "零售", "贸易", "经销", "代理", "采购", "进出口"]
TRADE_WORDS = ["销售", "批发", "零售", "贸易", "经销", "代理"]
MAKE_WORDS = ["生产", "制造", "加工"]
MAKER_LABEL_WORDS = ["厂家", "生产商", "制造商"]
TRADER_LABEL_WORDS = ["贸易", "经销", "代理"]
SERVICE_LABEL_VETO = ["租赁", "生产", "制造", "贸易", "经销", "代理", "厂家"]
DEPARTMENT_NAMES = ["其他部门", "其他单位", "其他"]
DEPARTMENT_WORDS = ["项目经理部", "项目部"]
NOT_SUPPLIER_WORDS = ["其他部门", "其他单位", "项目经理部", "项目部", "合同", "标段"]
DOMESTIC_COUNTRIES = ["China", "中国", "CHINA"]
INFER_TRADE = TRADE_WORDS + ["采购", "进出口"]
INFER_MAKE = ["生产", "制造", "加工", "研发"]
INFER_SERVICE = ["服务", "咨询", "运输", "工程", "维修", "设计", "系统集成", "项目管理", "监理"]

OPINION_FOREIGN_REJECT = "退回。国外供应商请通过中交海外采购专区进行注册申请。"
OPINION_HMT = "转人工复核。港澳台地区供应商需人工审批。"
OPINION_RECOMMEND = "建议同意。该供应商材料齐全、各项核验通过。（初期设置：需人工核实后再执行通过操作）"
SKIP_FOREIGN = "境外供应商不适用中国大陆合规审查"
DOMESTIC_TIP = (
    "提示：该供应商「是否海外供应商」字段标记为海外，但国家/地区信息为中国，"
    "疑似国内供应商。建议将该供应商「是否海外供应商」字段修改为国内供应商后重新提交。"
)

# --- checklist --------------------------------------------------------------
ISO_CODE_BY_RULE = {
    "C1_02": "9001", "C1_03": "14001", "C1_04": "45001",
    "D1_03": "9001", "D1_04": "14001", "D1_05": "45001",
}
# document type -> words of the checklist item it feeds, in the order it is applied
ITEM_WORDS = {
    "business_license": ["营业执照", "法律主体资格"],
    "legal_person_id": ["法人身份"],
    "tax_credit": ["纳税信用"],
    "production_license": ["生产许可", "强制认证"],
    "transport_license": ["运输承运资质"],
    "after_sales_cert": ["售后服务"],
    "after_sales_statement": ["售后服务"],
    "financial_report": ["审计财报", "资金财务"],
    "iso9001": ["ISO 9001", "ISO9001"],
    "iso14001": ["ISO 14001", "ISO14001"],
    "iso45001": ["ISO 45001", "ISO45001"],
}
# rule -> material type it needs and the label of that material
REQUIRED_MATERIALS = {
    "A01": ("business_license", "营业执照副本"),
    "A02": ("legal_person_id", "法人身份证正反面"),
    "A03": ("tax_credit", "纳税信用等级证明"),
    "A07": ("after_sales_cert", "售后服务承诺（机构认证证书或厂家/供应商承诺函）"),
    "A08": ("financial_report", "上年度经审计财报"),
    "C1_02": ("iso9001", "ISO9001 体系认证证书"),
    "C1_03": ("iso14001", "ISO14001 环境管理体系证书"),
    "C1_04": ("iso45001", "ISO45001 职业健康安全证书"),
    "C1_05": ("production_license", "生产许可证/强制认证"),
    "E1": ("transport_license", "道路运输许可证/无船承运证明"),
    "A13": ("inspection_cert", "检验检测机构资质认定证书（CMA/CNAS）"),
    "D1_03": ("iso9001", "ISO9001 质量管理体系认证证书"),
    "D1_04": ("iso14001", "ISO14001 环境管理体系证书"),
    "D1_05": ("iso45001", "ISO45001 职业健康安全证书"),
    "D1_06": ("authorization", "产品代理协议或销售授权"),
}
SUPPLEMENTS = {
    "A01": "营业执照副本（须含统一社会信用代码及完整经营范围明细）",
    "A02": "法人有效身份证正反面（须在有效期内）",
    "A03": "国家税务总局网站下载的上年度纳税信用等级证明（需C级及以上）",
    "A07": "售后服务五星认证或售后服务承诺函",
    "A08": "上年度经审计的财报（须含资产负债表/利润表/现金流量表）",
    "A13": "检验检测资质证明（CMA 资质认定证书 / CNAS 实验室认可证书等，须在有效期内）",
    "C1_02": "ISO 9001 认证证书（须为该公司认证且在有效期内）",
    "C1_03": "ISO 14001 认证证书（须为该公司认证且在有效期内）",
    "C1_04": "ISO 45001 认证证书（须为该公司认证且在有效期内）",
    "C1_05": "生产许可证或强制认证证明（须在有效期内）",
    "D1_06": "产品生产企业的代理协议或产品销售授权资质（授权一方须为该贸易公司且在有效期内）",
}
MISSING_DETAIL = (
    r"^(?:缺少|未上传|未提交|材料缺失|需上传|需补充)"
    r"|(?:材料|附件|文件)(?:尚未|未)(?:上传|提交|提供)"
)
A08_MISSING = "缺少经审计的上年度财报（须为上一年度，须含资产负债表、利润表、现金流量表及审计意见）"

# --- registry ---------------------------------------------------------------
ACTIVE_STATES = ["存续", "在业", "开业"]
FOREIGN_MONEY = ["万美元", "万港", "万欧元", "万日元"]

# --- certificate texts ------------------------------------------------------
# all text patterns are read with Unicode classes and \n as the only line end
DATE = r"(\d{4})\s*[年.\-/]\s*(\d{1,2})\s*[月.\-/]\s*(\d{1,2})(?!\d)"
LONG_TERM = r"长期|永久|无固定期限"
NOT_PREVIOUS_CYCLE = r"(?<!上周期)(?<!上一周期)(?<!上期)(?<!原周期)(?<!上一年度)(?<!上一期)"
VALID_LABEL = r"(?:证书)?有效(?:日期|期)\s*[:：]?\s*"
RANGE_END = r"(?:\s*日?\s*[至到\-—~]\s*" + DATE + r")?"
EXPIRY_LABEL = r"(?:有效期[至到]|失效[日日期]*|到期[日日期]*)[:：]?\s*"
LABELLED_RANGE = r"有效期.{0,40}?[-—~至].{0,10}?(?:" + DATE + r"|长期|永久|无固定期限)"
LABELLED_EXPIRY = r"失效[日日期]*\s*[:：]?\s*" + DATE
LABELLED_ISSUE = r"发证[日日期]*\s*[:：]?\s*" + DATE

TABLE_RULE = r"^\s*\|[\s:\-|]+\|?\s*$"
SPLIT_LABEL = r"^([\u4e00-\u9fa5]{1,3})[ \t]*\n+[ \t]*(?=[\u4e00-\u9fa5])"
HEADING = r"^#{1,6}\s*"
FIELD_STOP = (
    r"统一社会信用代码|名称|类型|住所|法定代表人|注册资本|成立日期|营业期限|经营范围|证书编号|"
    r"获证组织|认证状态|有效期至|有效期限|授权方|被授权方|授权期限|纳税人名称|纳税人识别号"
)
VALUE_TRIM = " 　。，,；;、"
LICENCE_LABELS = [
    "统一社会信用代码", "名称", "类型", "住所", "法定代表人", "注册资本",
    "成立日期", "营业期限", "经营范围", "登记机关", "核准日期",
]
CREDIT_CODE = r"统一社会信用代码\s*[:：]?\s*([0-9A-Za-z]{15,18})"
BARE_CREDIT_CODE = r"(?<![0-9A-Za-z])([0-9A-Z]{18})(?![0-9A-Za-z])"
VALUE_60 = r"[^\n:：]{2,60}?"
VALUE_120 = r"[^\n:：]{2,120}?"
COMPANY_SUFFIXES = ["有限责任公司", "股份有限公司", "有限公司", "集团公司", "公司"]
REVERSED_NAME_LINE = r"(?:名\s*)?称\s*$"
COMPANY_TOKEN = r"[\u4e00-\u9fa5A-Za-z0-9（）()·&]+?(?:" + "|".join(COMPANY_SUFFIXES) + ")"
PERSON_CUTS = [
    r"\s+(?:类\s+名|名\s+类)(?=\s|$)",
    r"\s+(?:类\s*型|名\s*称)(?=\s|$)",
    r"\s+(?:住\s*)?所(?=[^\n]{0,40}(?:省|自治区|市|区|县|镇|街道|路|道|号|栋|村))",
    r"(?<![0-9A-Za-z])[0-9A-Z]{15,18}(?![0-9A-Za-z])",
]
PERSON_RESIDENCE_NOISE = r"(?:^|\s)(?:住|住所|所)(?:\s|$)"
PERSON_NEXT_LINE = (
    r"法定代表人[^\n]{0,60}\n\s*([\u4e00-\u9fff·]{2,6}?)"
    r"(?=\s*(?:经营范围|住所|注册资本|成立日期|营业期限|$))"
)
PERSON_DASH_NOISE = r"^([\u4e00-\u9fff·]{2,12})\s*[—–－]\s*[\u4e00-\u9fff]{1,3}$"
PERSON_NOT_NAMES = ["类名", "名类", "类型", "名称", "类", "名"]
PERSON_WINDOW = r"法定代表人[\s\S]{0,180}"
CAPITAL_DIGITS = r"注册资本\s*[:：]?\s*(?:人民币(?:元)?|美元|港币|欧元|澳元)?\s*([\d,.，]+)\s*万"
CAPITAL_NUMERALS = (
    r"注册资本\s*[:：]?\s*(?:人民币(?:元)?)?\s*"
    r"([零〇一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟]+)"
)
NUMERAL_DIGITS = {
    "零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "贰": 2, "两": 2, "三": 3, "叁": 3, "四": 4, "肆": 4,
    "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9,
}
NUMERAL_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
NUMERAL_SECTIONS = {"万": 10_000, "亿": 100_000_000}
TERM = r"营业期限\s*[:：]?\s*([^\n]{1,60})"
RAW_TERM = r"营\s*业\s*期\s*限[^\r\n]{0,120}"
STARS = r"(?:\*\s*){4,}|(?:＊\s*){4,}"
SCOPE_LABEL = r"经\s*营\s*范\s*围\s*[:：]?"
SCOPE_END = (
    r"(?:\n\s*(?:注册资本|成立日期|营业期限|住所|登记机关|核准日期|统一社会信用代码))"
    r"|(?:(?:注册资本|成立日期|营业期限|住所|登记机关|核准日期)\s*[:：])"
    r"|(?:\n\s*\d+[、.．]\s*本营业执照)|<!--|数字签名"
)
SCOPE_INLINE_ADDRESS = (
    r"\s*住所\s*[\u4e00-\u9fa5\dA-Za-z\-—－号弄幢栋单元室座楼层]+?号[\dA-Za-z\-—－]*\s*"
)
SCOPE_TAIL_LABEL = r"\s*(?:登记机关|核准日期)\s*(?:-->)?\s*$"
SCOPE_NOTE_LINE = r"^\s*(?:说明|经营范围说明)\s*[:：]?\s*$"
SCOPE_LEGAL_NOTE = r"\((?:除依法须经批准的项目外|依法须经批准的项目)[^()]*\)"
SCOPE_GROUP_HEAD = r"(?:一般项目|许可项目)[:：]"
SCOPE_NOT_TEXT = ["说明", "说明：", "说明:"]
SCOPE_SAME = 0.98
SCOPE_LENGTH = 0.65
SCOPE_SIMILAR = 0.7

ID_NAME = r"姓\s*名\s*[:：]?\s*([\u4e00-\u9fa5·]{2,15}?)(?=\s*(?:性别|民族|出生|住址|公民|号码|签发|$))"
ID_RANGE = r"有效[期限]*[^\d]*" + DATE + r"\s*[-—~至\s]*(长期|永久|无固定期限|" + DATE + r")"
ID_UNTIL = r"有效期[至止]?\s*[:：]?\s*" + DATE
ID_KEEP_NAME = r"姓\s*名\s*[:：]?\s*([\u4e00-\u9fa5·]{2,15})"
ID_KEEP_TERM = r"有效期限\s*([^\s\n，,；;]+)"
CARD_DATES = [r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}", r"\d{6}[.\-/]\d{2}(?!\d)"]

TAX_LEVELS = [
    r"年度评价结果[:：]?\s*([A-D])", r"纳税信用(?:级别|等级)[:：]?\s*([A-D])",
    r"级别[:：]?\s*([A-D])\s*级?", r"[（(]\s*([A-D])\s*级\s*[)）]",
]
TAX_YEARS = [r"(20\d{2})\s*年度", r"年度\s*[:：]?\s*(20\d{2})"]
TAX_SOURCE = r"国家税务总局|税务局|纳税服务平台|信用中国|电子税务局"

ISO_COMPANY = r"[^\n:：]{2,60}?(?:公司|集团|中心|厂)"
ISO_DECLARED = r"(?:^|\n)\s*兹证明\s*[:：]?\s*(" + ISO_COMPANY + r")\s*(?=\n|$)"
ISO_RECOGNISED = (
    r"(?:^|\n)\s*(?:我公司|本公司|本机构|本认证机构)?\s*(?:认定|确认|证明)\s*(?:下列|以下)\s*组织"
    r"[^\n]{0,50}\n+\s*(" + ISO_COMPANY + r")\s*(?=\n|$)"
)
ISO_HOLDER_LABELS = ["获证组织", "认证委托人", "受审核方", "组织名称", "证书持有者"]
ISO_BODY_LABELS = ["认证机构", "发证机构", "检验机构", "认证方"]
ISO_OBLIGATION = r"须按规定|必须|接受年度监督|定期接受监督|监督审核|方可保持|有效性|经审核合格"
ISO_TITLE = (
    r"(?i)(?:质量|环境|职业健康安全)管理体系\s*认证证书|"
    r"(?:QMS|EMS|OHSMS)\s+CERTIFICATE\s+OF\s+REGISTRATION"
)
ISO_NUMBER = r"证书编号\s*[:：]?\s*([A-Za-z0-9\-]{6,30})"
ISO_STATE = r"认证?状态\s*[:：]?\s*(有效|暂停|撤销|失效)"
ISO_MARKERS = {
    "iso9001": "质量管理体系认证证书",
    "iso14001": "环境管理体系认证证书",
    "iso45001": "职业健康安全管理体系认证证书",
}
ISO_REMINDER_DAYS = 90
GRANTOR_LABELS = ["授权方", "许可方", "甲方", "授权单位"]
GRANTEE_LABELS = ["被授权方", "被许可方", "乙方", "受权单位"]

PRODUCTION_MARKERS = [
    ("工业产品生产许可证", ["全国工业产品生产许可证", "工业产品生产许可证"]),
    ("安全生产许可证", ["安全生产许可证"]),
    ("食品生产许可证", ["食品生产许可证"]),
    ("危险化学品生产许可证", ["危险化学品生产许可证"]),
    ("特种设备生产许可证", ["特种设备生产许可证"]),
    ("3C强制认证证书", ["中国国家强制性产品认证证书", "强制性产品认证证书", "CCC认证", "3C认证"]),
]
PRODUCTION_NUMBER = r"(?i)(?:许可证|证书)编号[:：]?([A-Z0-9\-（）()]{5,40})"
OTHER_MATERIALS = [
    ("营业执照", ["营业执照"]),
    ("ISO 9001证书", ["质量管理体系认证证书", "ISO9001", "ISO9001:2015"]),
    ("ISO 14001证书", ["环境管理体系认证证书", "ISO14001"]),
    ("ISO 45001证书", ["职业健康安全管理体系认证证书", "ISO45001"]),
]
TRANSPORT_MARKERS = [
    "道路运输经营许可证", "道路运输许可证", "无船承运业务经营资格登记证",
    "无船承运业务经营资格登记证明", "无船承运业务经营资格证", "无船承运人备案证明",
]
TRANSPORT_TERM = r"(?:有效期|有效日期|失效日期|到期日期)[^\n]{0,100}"
SIGN_DATE = r"日期\s*[:：]?\s*([^\n]{4,40})"
STATEMENT_DAYS = 92
AFTER_SALES_CERT_MARKERS = [
    "售后服务认证证书", "商品售后服务评价体系认证", "五星级售后服务认证",
    "五星售后服务认证", "售后服务五星认证",
]
AFTER_SALES_STATEMENT_MARKERS = ["售后服务", "售后保障", "售后承诺"]

CONFIDENCE_FLOOR = 0.9
LOCAL_OCR_TYPES = PUBLIC_TYPES

# --- page layout ------------------------------------------------------------
FRONT_WORDS = ["姓名", "性别", "民族", "出生", "住址", "公民身份号码"]
BACK_WORDS = ["签发机关", "有效期限", "有效期", "居民身份证"]
NAME_LABELS = ["姓名"]
DAMAGED_NAME_LABELS = ["城名", "性名", "姓各", "姓多"]
TERM_LABELS = ["有效期限", "有效期", "无效期限", "无效期", "视效期限", "视效期"]
LICENCE_PAGE_WORDS = ["营业执照", "统一社会信用代码", "法定代表人", "注册资本", "经营范围", "登记机关"]
COMPLETE_DATE = r"(?:19|20)\d{2}\s*[年.\-/]\s*\d{1,2}\s*[月.\-/]\s*\d{1,2}(?!\d)"

#: One string of a JSON text.
JSON_STRING = r'"(?:[^"\\]|\\.)*+"'
