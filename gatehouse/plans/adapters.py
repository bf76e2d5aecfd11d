"""Views that give the driver's tables the shape of requests, suppliers and materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.classify import with_type_flags
from ..operators.profile import with_inspection, with_license_need, with_region
from ..operators.routing import route_rule_sets
from .redecision import add_uploads

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

APPLICATION = """
SELECT o_orderkey AS todo_id, o_custkey AS supplier_id, CAST(o_orderdate AS DATE) AS apply_date,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'P0701'
            WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'P0702' ELSE 'P0704' END AS bill_type
FROM orders
"""

SUPPLIER = """
SELECT c_custkey AS supplier_id, c_name AS name, c_acctbal AS registered_capital,
       CASE c_mktsegment WHEN 'MACHINERY' THEN '厂家' WHEN 'BUILDING' THEN '经销商'
            WHEN 'FURNITURE' THEN '服务商' WHEN 'AUTOMOBILE' THEN '仓储服务商、物流服务商' ELSE '其他' END AS sup_type,
       CASE c_nationkey % 4 WHEN 0 THEN '机械设备生产、加工、销售' WHEN 1 THEN '国际货运代理；无船承运'
            WHEN 2 THEN '工程设计；设备采购' ELSE '技术咨询（不含危险化学品）；电梯维保' END AS busi_scope,
       n_regionkey = 0 AS is_overseas, n_name AS country_name,
       CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS social_credit_code,
       c_acctbal > 1000 AS tyc_checked, c_acctbal > 9000 AS has_violation_3y,
       c_acctbal BETWEEN 8000 AND 8500 AS is_dishonest,
       c_acctbal > 2000 AS basics_on_file, c_acctbal > 5000 AS iso_on_file
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

MATERIAL = """
SELECT l_orderkey AS todo_id, l_linenumber AS position, l_partkey AS part_id, l_suppkey AS issuer_id,
       l_extendedprice AS tie_break,
       CASE p_type WHEN 'PROMO' THEN 'ISO9001 ' || p_name WHEN 'SMALL' THEN 'ISO14001 ' || p_name
            WHEN 'LARGE' THEN 'ISO45001 ' || p_name WHEN 'STANDARD' THEN '纳税信用等级证明 ' || p_name
            WHEN 'ECONOMY' THEN '财报 ' || CAST(EXTRACT(year FROM l_shipdate) AS STRING) || '年 ' || p_name
            ELSE CASE WHEN p_size < 25 THEN '运输合同 ' || p_name ELSE '道路运输许可证 ' || p_name END
       END AS file_name,
       CASE l_linenumber WHEN 1 THEN '营业执照副本图片' WHEN 2 THEN '法人代表身份证' WHEN 3 THEN '税务登记证图片'
            WHEN 4 THEN '合作业绩证明文件' WHEN 5 THEN '质量管理体系认证证书' WHEN 6 THEN '环境管理体系认证证书'
            ELSE '职业健康安全管理体系认证证书' END AS type_name,
       CAST(l_shipdate AS DATE) AS valid_until, 1 - l_discount AS confidence,
       CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS check_value
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

LOG = """
SELECT event_id AS seq, user_id AS key, event_type AS kind, ts AS at, value, props AS payload FROM events
"""

OCR_DOC = "SELECT doc_id, text, lang, source AS owner, n_chars AS size FROM documents"

VIEWS = {"application": APPLICATION, "supplier_view": SUPPLIER, "material": MATERIAL, "log": LOG, "ocr_doc": OCR_DOC}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


_NEEDS = {
    "application": ["orders"], "supplier_view": ["customer", "nation"], "material": ["lineitem", "part"],
    "log": ["events"], "ocr_doc": ["documents"],
}


#: Requests and uploads are dealt by these columns as they are read, at every size, before texts are made of them: their files
#: are few row groups of narrow rows, and what follows is wide text work. No request, however many uploads it has, is one task.
_DEALT = {"application": ["todo_id"], "material": ["todo_id", "position"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables(spark, sf_dir, *_NEEDS[name])
    rows = spark.sql(VIEWS[name])
    return rows.repartition(*_DEALT[name]) if name in _DEALT else rows


AS_OF = "2001-06-30"
# the nations of the overseas region that stand for Hong Kong, Macao and Taiwan
HMT_NATIONS = ["NATION_0", "NATION_10", "NATION_20"]


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed supplier profiles: routing needs no request, so it runs once per supplier."""
    base = view(spark, sf_dir, "supplier_view").withColumn(
        "is_manufacturer", F.col("sup_type").contains("厂家"))
    on_file, iso = F.col("basics_on_file"), F.col("iso_on_file")
    certs = F.when(iso, F.array(*[F.lit(c) for c in ("ISO14001", "ISO45001", "ISO9001")]))
    filled = (base.withColumn("has_after_sales_statement", on_file).withColumn("has_authorization", iso)
              .withColumn("certifications", F.coalesce(certs, F.array().cast("array<string>"))))
    known = schemas.conform(filled, schemas.SUPPLIER).drop("todo_id")
    return route_rule_sets(with_inspection(with_license_need(with_region(known, HMT_NATIONS))))


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_type_flags(schemas.conform(view(spark, sf_dir, "material"), schemas.MATERIAL))


def requests(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """Everything the checklist needs, one row per request."""
    apps = view(spark, sf_dir, "application")
    routed = apps.join(suppliers(spark, sf_dir), "supplier_id").withColumn("bill_name", F.col("bill_type"))
    mats = materials(spark, sf_dir)
    none = F.array().cast("array<string>")
    joined = add_uploads(routed.drop("iso_conflicts", "classified_materials"), mats, texts)
    types = F.coalesce("classified_materials", none)

    def seen(kind: str) -> Column:
        return F.array_contains(types, kind)

    on_file = F.col("basics_on_file")
    return joined.withColumns({
        "has_business_license": on_file | seen("business_license"),
        "has_legal_id_material": on_file | seen("legal_person_id"),
        "tax_credit_rating_ok": on_file | seen("tax_credit"),
        "certifications": F.array_sort(F.array_union(
            "certifications", F.coalesce("uploaded_certifications", none)))})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
