"""More operators over the driver's tables, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fixed, numbers
from ..functions import text as tx
from ..operators import classify, financial, masking, ocr, profile, registry, retention, review, routing, state
from ..operators.extract import extract_all
from ..operators.extract.identity import idcard_checks
from ..schemas import CARD
from ..streaming import jobs
from .adapters import AS_OF, table, view
from .driver_queries import _no_lines, applications, materials, moment_text, readings, text_of, typed_materials
from .oracles import APPS, FACTS, FLAGGED, MAT, READ, SUP, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query together with the SQL that gives the same rows."""
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__], ORACLES[run.__name__] = run, sql
        return run

    return keep


def flag_text(value: Column) -> Column:
    """A three-valued check as text."""
    return F.coalesce(value.cast("string"), F.lit("unknown"))


# --- profiles and routes ----------------------------------------------------------------
BASE_INFO = """info AS (
  SELECT o_orderkey AS todo_id, CASE WHEN o_custkey % 3 = 0 THEN 'P0704' ELSE 'P0701' END AS bill_type,
    CASE WHEN o_custkey % 4 > 0 THEN c_name ELSE '' END AS sup_short, CASE WHEN o_custkey % 7 = 0 THEN 'X' || o_custkey END AS credit_code,
    CASE WHEN o_custkey % 2 = 0 THEN 'O' || o_custkey END AS org_code,
    CASE WHEN o_custkey % 6 = 0 THEN 'bad' ELSE CAST(o_custkey AS STRING) || '.5' END AS reg_capl,
    CASE WHEN o_custkey % 9 = 0 THEN 'x' ELSE CAST(1970 + o_custkey % 30 AS STRING) || '-03-01' END AS found_time,
    CASE o_custkey % 4 WHEN 0 THEN '厂家' WHEN 1 THEN '检测服务商' WHEN 2 THEN '软件服务商' ELSE '贸易商' END AS sup_type,
    CASE o_custkey % 5 WHEN 0 THEN '电梯制造' WHEN 1 THEN '销售（不含危险化学品）' WHEN 2 THEN '工程设计；设备检测服务' WHEN 3 THEN '灯具生产' ELSE '' END AS busi_scope,
    CASE WHEN o_custkey % 3 = 1 THEN 1 ELSE 0 END AS overseas_code,
    CASE o_custkey % 4 WHEN 0 THEN '中国香港' WHEN 1 THEN '中国' WHEN 2 THEN 'Japan' END AS country_name,
    CASE WHEN o_custkey % 5 = 0 THEN '{broken' WHEN o_custkey % 5 = 1 THEN NULL ELSE '{"supName":"公司' || o_custkey || '","creditCode":"C' || o_custkey
      || '","penaltyCount":' || o_custkey % 3 || ',"dishonestyCount":' || o_custkey % 2 || '}' END AS tyc_info
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _info(spark: SparkSession, sf: str) -> DataFrame:
    for name in ("orders", "customer"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(f"WITH {BASE_INFO} SELECT * FROM info").repartition("todo_id")


_JUDGED = f"""{BASE_INFO}, j AS (SELECT *, CAST(regexp_extract(tyc_info, '公司([0-9]+)', 1) AS VARCHAR) AS tyc_no, tyc_info LIKE '{{"%' AS good,
  overseas_code = 1 AND coalesce(country_name, '') = '中国香港' AS hmt FROM info)"""


@query(f"""WITH {MAT}, {FLAGGED}, {FACTS}, {_JUDGED},
c AS (SELECT todo_id, count(DISTINCT slot_no) AS n FROM mat4 WHERE clash GROUP BY todo_id)
SELECT j.todo_id, coalesce(nullif(sup_short, ''), CASE WHEN good THEN '公司' || tyc_no END, '') AS name,
  coalesce(credit_code, CASE WHEN good THEN 'C' || tyc_no END, org_code, '') AS social_credit_code,
  coalesce(TRY_CAST(reg_capl AS DOUBLE), 0) AS registered_capital,
  CASE WHEN found_time = 'x' THEN 0 ELSE 2001 - CAST(found_time[1:4] AS INTEGER) END AS established_years,
  hmt AS is_hmt, overseas_code = 1 AND NOT hmt AS is_foreign, bill_type = 'P0704' AS is_cooperation, sup_type = '厂家' AS is_manufacturer,
  coalesce(licence, FALSE) AS has_business_license, coalesce(tax_credit, FALSE) AS tax_credit_rating_ok, coalesce(financial, FALSE) AS has_financial_report,
  sup_type = '厂家' AND busi_scope IN ('电梯制造', '灯具生产') AS needs_production_license,
  CASE WHEN sup_type <> '厂家' THEN '' WHEN busi_scope = '电梯制造' THEN '生产许可证（经营范围涉及「电梯」）'
    WHEN busi_scope = '灯具生产' THEN '3C强制认证证书（经营范围涉及「灯具」）' ELSE '' END AS production_license_reason,
  coalesce(good, FALSE) AS tyc_checked, coalesce(good AND tyc_info NOT LIKE '%"penaltyCount":0%', FALSE) AS has_violation_3y,
  coalesce(good AND tyc_info LIKE '%"dishonestyCount":1%', FALSE) AS is_dishonest, busi_scope LIKE '%检测服务%' AS is_inspection,
  CAST(coalesce(n, 0) AS INTEGER) AS conflicts,
  concat_ws(',', CASE WHEN iso14001 THEN 'ISO14001' END, CASE WHEN iso45001 THEN 'ISO45001' END, CASE WHEN iso9001 THEN 'ISO9001' END) AS certifications
FROM j LEFT JOIN facts f ON j.todo_id = f.todo_id LEFT JOIN c ON j.todo_id = c.todo_id""")
def supplier_profiles(spark, sf):
    """Profiles from base info, registry summary and uploads."""
    base = _info(spark, sf)
    for name in ("fact_capl", "legal_person", "company_type", "state", "money_type", "office_addr", "home_addr"):
        base = base.withColumn(name, F.lit(None).cast("string"))
    rollup = classify.material_summary(materials(spark, sf))
    made = profile.supplier_profile(base.withColumn("is_in_indy", F.lit(0)), rollup, AS_OF)
    return made.select(
        "todo_id", "name", "social_credit_code", "registered_capital", "established_years", "is_hmt", "is_foreign", "is_cooperation",
        "is_manufacturer", "has_business_license", "tax_credit_rating_ok", "has_financial_report", "needs_production_license",
        "production_license_reason", "tyc_checked", "has_violation_3y", "is_dishonest", "is_inspection",
        F.size("iso_conflicts").alias("conflicts"), text_of(F.col("certifications")).alias("certifications"))


@query(f"""WITH {_JUDGED} SELECT todo_id,
  CASE WHEN hmt THEN 'manual' WHEN overseas_code = 1 OR sup_type = '软件服务商' THEN 'skip' ELSE 'rules' END AS route_decision,
  CASE WHEN hmt THEN '港澳台供应商' WHEN overseas_code = 1 OR sup_type = '软件服务商' THEN '不适用' ELSE '' END AS route_type,
  CASE WHEN hmt THEN {text(fixed.OPINION_HMT)} WHEN overseas_code = 1 THEN '不适用。境外供应商不适用中国大陆合规审查。'
    WHEN sup_type = '软件服务商' THEN '不适用。该供应商属于集团独有类别（软件服务商），审查标准复杂，需转人工处理。' ELSE '' END AS route_opinion,
  CASE WHEN sup_type = '软件服务商' THEN '软件服务商' ELSE '' END AS special_category FROM j""")
def stage2_routes(spark, sf):
    """Early results of the re-decision, special categories."""
    known = profile.with_region(_info(spark, sf).withColumn("is_overseas", F.col("overseas_code") == 1))
    routed = routing.with_special(routing.route_stage2(known))
    return routed.select("todo_id", F.coalesce("route_decision", F.lit("rules")).alias("route_decision"), *[
        tx.blank(F.col(c)).alias(c) for c in ("route_type", "route_opinion", "special_category")])


_NAMES = """n AS (SELECT o_orderkey AS todo_id, CASE o_orderkey % 5 WHEN 0 THEN ' 执照' || o_custkey || ' ' WHEN 1 THEN '' END AS ocr_name,
  CASE o_custkey % 3 WHEN 0 THEN '公司' || o_custkey || '/流程' WHEN 1 THEN '/x' ELSE '' END AS title,
  CASE o_orderkey % 4 WHEN 0 THEN '其他部门' WHEN 1 THEN '某项目经理部' WHEN 2 THEN ' 单位' || o_custkey ELSE '一标段合同' END AS apply_unit,
  CASE o_orderkey % 7 WHEN 0 THEN '登记名' || o_custkey END AS registry_name, CASE o_orderkey % 11 WHEN 0 THEN '全名' || o_custkey ELSE '' END AS full_name,
  ' 短' || o_custkey AS short FROM orders)"""


@query(f"""WITH {_NAMES}, m AS (SELECT *, nullif(trim(ocr_name), '') AS o, nullif(trim(string_split(title, '/')[1]), '') AS t, nullif(trim(apply_unit), '') AS u FROM n),
f AS (SELECT *, coalesce(nullif(registry_name, ''), t, CASE WHEN todo_id % 4 = 2 THEN u END) AS found FROM m)
SELECT todo_id, coalesce(o, t, CASE WHEN todo_id % 4 IN (2, 3) THEN u END, trim(short)) AS display_name,
  coalesce(nullif(full_name, ''), CASE WHEN length(found) > 4 THEN found END, '') AS legal_name FROM f""")
def supplier_names(spark, sf):
    """The name shown and the legal name."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    rows = profile.with_full_name(spark.sql(f"WITH {_NAMES} SELECT * FROM n"))
    return rows.select("todo_id", profile.display_name(F.col("ocr_name"), F.col("title"), F.col("apply_unit"), F.col("short")).alias("display_name"),
                       tx.blank(F.col("full_name")).alias("legal_name"))


@query(f"""WITH {BASE_INFO} SELECT todo_id, overseas_code = 1 AND coalesce(country_name, '') = '中国' AS suspect,
  concat_ws('、', CASE WHEN busi_scope LIKE '%销售%' OR sup_type = '贸易商' THEN '贸易商/经销商' END, CASE WHEN busi_scope LIKE '%制造%' OR busi_scope LIKE '%生产%' THEN '生产/制造商' END,
    CASE WHEN busi_scope LIKE '%设计%' OR sup_type LIKE '%服务%' THEN '服务商' END) AS inferred FROM info""")
def profile_hints(spark, sf):
    """Suspected domestic suppliers, kinds of business that the scope hints at."""
    info = profile.with_domestic_tip(_info(spark, sf).withColumn("is_overseas", F.col("overseas_code") == 1))
    return info.select("todo_id", (F.col("domestic_tip") != "").alias("suspect"),
                       profile.infer_types(F.col("busi_scope"), F.replace("sup_type", F.lit("厂家"), F.lit(""))).alias("inferred"))


# --- uploads ----------------------------------------------------------------------------
_FILES = """files AS (SELECT l_orderkey AS todo_id, l_linenumber AS position,
  CASE l_partkey % 5 WHEN 0 THEN '张三.jpg' WHEN 1 THEN l_suppkey || '_李四.png' WHEN 2 THEN '营业执照.png' WHEN 3 THEN '身份证.docx' ELSE '五六七八九.jpg' END AS file,
  CASE l_suppkey % 4 WHEN 0 THEN 'legal_person_id' WHEN 1 THEN 'iso9001' WHEN 2 THEN 'inspection_cert' END AS kind,
  CASE WHEN l_quantity > 25 THEN 'CMA' ELSE '' END AS file_desc FROM lineitem)"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(f"WITH {_FILES} SELECT * FROM files")


@query(f"""WITH {_FILES} SELECT todo_id, position, file, l AS looks_like_card FROM (SELECT *, file LIKE '%张三%' OR file LIKE '%李四%' AS l FROM files)""")
def id_card_names(spark, sf):
    """P20: bare person names as image names."""
    return _files(spark, sf).select("todo_id", "position", "file", masking.looks_like_id_card(F.col("file")).alias("looks_like_card"))


@query(f"""WITH {_FILES} SELECT todo_id, position, CASE WHEN kind IS NULL THEN '' WHEN kind = 'iso9001' AND file_desc = 'CMA' THEN 'iso9001,inspection_cert'
  WHEN kind = 'iso9001' THEN 'iso9001' ELSE kind END AS types FROM files""")
def resolved_types(spark, sf):
    """An accreditation mark on an ISO certificate."""
    rows = _files(spark, sf)
    types = F.array_compact(F.array(F.col("kind"), F.when(F.col("kind") == "iso9001", "inspection_cert")))
    return rows.select("todo_id", "position", text_of(classify.resolve_types(types, F.col("file_desc"))).alias("types"))


@query(f"""WITH {_FILES} SELECT file AS file_name, bool_or(kind = 'legal_person_id') AS is_id_card, bool_or(kind <> 'legal_person_id') AS is_other
FROM files WHERE kind IS NOT NULL GROUP BY file""")
def id_name_sets(spark, sf):
    """Names known as identity cards, and names known as something else."""
    mats = _files(spark, sf).select(F.col("file").alias("file_name"), F.array_compact(F.array("kind")).alias("types"))
    return classify.id_name_sets(mats)


@query(f"""WITH {MAT}, {FLAGGED}, t AS (SELECT todo_id, name_no = '9001' OR (name_no IS NULL AND slot_no = '9001') AS a,
  name_no = '14001' OR (name_no IS NULL AND slot_no = '14001') AS b, name_no = '45001' OR (name_no IS NULL AND slot_no = '45001') AS c FROM mat4),
r AS (SELECT todo_id, bool_or(coalesce(a, FALSE)) AS a, bool_or(coalesce(b, FALSE)) AS b, bool_or(coalesce(c, FALSE)) AS c FROM t GROUP BY todo_id)
SELECT o_orderkey AS todo_id, concat_ws(',', CASE WHEN b THEN 'iso14001' END, CASE WHEN c THEN 'iso45001' END, CASE WHEN a THEN 'iso9001' END, 'tax_cert') AS types,
  concat_ws(',', CASE WHEN b THEN 'ISO14001' END, CASE WHEN c THEN 'ISO45001' END, CASE WHEN a THEN 'ISO9001' END) AS certifications
FROM orders LEFT JOIN r ON o_orderkey = todo_id""")
def hydrated_types(spark, sf):
    """ISO types of old records derived again and added to the supplier."""
    mats = view(spark, sf, "material").select("todo_id", "file_name", "type_name", F.lit("").alias("file_desc"), F.lit(None).cast("array<string>").alias("types"))
    owners = applications(spark, sf).select("todo_id", F.array(F.lit("tax_cert")).alias("classified_materials"), F.lit(None).cast("array<string>").alias("certifications"))
    _, updated = classify.hydrate(mats, owners)
    return updated.select("todo_id", text_of(F.col("classified_materials")).alias("types"), text_of(F.col("certifications")).alias("certifications"))


@query(f"""WITH {MAT}, own AS (SELECT todo_id, bool_or(position = 1) AS canonical FROM mat GROUP BY todo_id)
SELECT DISTINCT m.todo_id, file_name AS file, CASE WHEN m.canonical THEN '' ELSE 'business_license' END AS types
FROM (SELECT *, bool_or(position = 1) OVER (PARTITION BY todo_id) AS canonical, bool_or(position = 1) OVER (PARTITION BY todo_id, file_name) AS own FROM mat) m
WHERE m.position = 4 AND NOT own AND NOT EXISTS (SELECT 1 FROM mat x WHERE x.todo_id = m.todo_id AND x.file_name = m.file_name AND x.position <> 4)
  AND file_name NOT LIKE 'ISO%' AND file_name NOT LIKE '%道路运输%' AND file_name NOT LIKE '%财报%'""")
def canonical_licences(spark, sf):
    """An old licence file loses its type where the owner filled the licence slot with another file."""
    mats = view(spark, sf, "material").withColumn("file_desc", F.lit("")).withColumn(
        "types", F.when(F.col("position") == 4, F.array(F.lit("business_license"))))
    alone = mats.groupBy("todo_id", "file_name").agg(F.max(F.col("position") == 4).alias("old"), F.max(F.col("position") != 4).alias("other"))
    plain = ~F.col("file_name").startswith("ISO") & ~F.col("file_name").contains("道路运输") & ~F.col("file_name").contains("财报")
    files = alone.filter(F.col("old") & ~F.col("other") & plain).select("todo_id", F.col("file_name").alias("file"))
    return classify.match_files(files, mats).select("todo_id", "file", text_of(F.col("types")).alias("types"))


@query(f"""WITH {MAT}, {FLAGGED} SELECT todo_id, file FROM (SELECT todo_id, file_name AS file, bool_or(financial OR position = 2) AS hidden,
  bool_or(position IN (1, 3) OR tax_credit OR iso9001 OR iso14001 OR iso45001 OR transport) AS known FROM mat4 GROUP BY ALL) WHERE known AND NOT hidden""")
def public_files(spark, sf):
    """Files that pass type matching and the gate."""
    mats = materials(spark, sf)
    return masking.public_subset(mats.select("todo_id", F.col("file_name").alias("file")).distinct(), mats).select("todo_id", "file")


@query(f"""WITH {_FILES}, f AS (SELECT DISTINCT todo_id, file FROM files), k AS (SELECT todo_id, file, count(*) AS n FROM files WHERE position % 2 = 0 GROUP BY ALL)
SELECT f.todo_id, f.file, CASE WHEN f.file LIKE '%.docx' THEN 'unsupported' WHEN n > 0 THEN 'cards' ELSE 'no_result' END AS outcome,
  CASE WHEN f.file LIKE '%.docx' THEN '身份证文件格式 .docx 不受支持（仅支持 jpg/png/bmp/tif/webp/pdf），无法打码识别'
    WHEN n IS NULL THEN 'PaddleOCR 未返回识别结果' ELSE '' END AS reason, coalesce(n, 0) AS cards
FROM f LEFT JOIN k ON f.todo_id = k.todo_id AND f.file = k.file WHERE f.file LIKE '%身份证%' OR f.file LIKE '%张三%'""")
def mask_outcomes(spark, sf):
    """D3: what became of each identity-card file."""
    rows = _files(spark, sf)
    mats = rows.filter("file like '%张三%'").select(
        "todo_id", F.col("file").alias("file_name"), F.lit("").alias("type_name"), F.lit("").alias("file_desc"), F.array(F.lit("legal_person_id")).alias("types"))
    found = masking.mask_outcomes(rows.select("todo_id", "file").distinct(), rows.filter("position % 2 = 0"), mats)
    return found.withColumn("reason", tx.blank(F.col("reason")))


@query("""SELECT l_orderkey AS todo_id, l_linenumber AS position, l_partkey AS part, CASE l_partkey % 3
  WHEN 0 THEN '姓名 王' || chr(19968 + CAST(l_suppkey % 900 AS INTEGER)) || ' 有效期限 2001.02.03-' || strftime(l_shipdate, '%Y.%m.%d') WHEN 1 THEN '税务登记证' ELSE '' END AS kept
FROM lineitem""")
def allow_list_masking(spark, sf):
    """Identity cards keep name and validity, other texts stay."""
    lines = table(spark, sf, "lineitem")
    name = F.concat(F.lit("王"), F.char(F.lit(0)), F.lit(""))
    sign = F.decode(F.unhex(F.lpad(F.hex(F.lit(19968) + F.col("l_suppkey") % 900), 4, "0")), "UTF-16BE")
    name = F.concat(F.lit("王"), sign)
    card = F.concat(F.lit("<!-- 第1页 -->\n姓名 "), name, F.lit("\n性别 男\n住址 某市某路1号\n有效期限 2001.02.03-"), F.date_format("l_shipdate", "yyyy.MM.dd"))
    case = F.col("l_partkey") % 3
    docs = lines.select(F.col("l_orderkey").alias("todo_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part"),
                        F.when(case == 1, "tax_cert").otherwise("legal_person_id").alias("doc_type"),
                        F.when(case == 0, card).when(case == 1, "税务登记证").otherwise("性别 男\n住址 某市").alias("text"))
    return masking.mask_documents(docs).select("todo_id", "position", "part", F.col("text").alias("kept"))


# --- state --------------------------------------------------------------------------------
@query("""SELECT DISTINCT o_custkey AS todo_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)""")
def missing_keys(spark, sf):
    """Requested keys that nothing is stored for."""
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("todo_id"))
    return state.missing_requested(keys, table(spark, sf, "events").select(F.col("user_id").alias("todo_id")))


@query("""WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN 'offline' WHEN 'click' THEN 'online' END AS mode FROM events),
l AS (SELECT user_id, max(event_id) AS id FROM e GROUP BY user_id)
SELECT e.user_id AS todo_id, event_type AS status, 'step-' || event_type AS step, CASE WHEN event_type = 'signup' THEN 'x' ELSE '' END AS error,
  CAST(CASE WHEN value > 50 THEN floor(value) ELSE 0 END AS INTEGER) AS progress FROM e JOIN l ON e.event_id = l.id WHERE coalesce(mode, 'online') = 'online'""")
def task_overview(spark, sf):
    """The last task of each request of one backend."""
    kind = F.col("event_type")
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("todo_id"), F.col("event_id").alias("seq"), kind.alias("status"), F.concat(F.lit("step-"), kind).alias("step"),
        F.when(kind == "signup", "x").alias("error"), F.when(F.col("value") > 50, F.floor("value").cast("int")).alias("progress"),
        F.when(kind == "error", "offline").when(kind == "click", "online").alias("ocr_mode"))
    return state.task_overview(log, "online").withColumn("error", tx.blank(F.col("error")))


_LIMIT = "2024-01-31 00:00:00"


@query(f"""WITH l AS (SELECT user_id AS todo_id, max(event_id) AS id FROM events GROUP BY user_id),
t AS (SELECT todo_id, CASE WHEN event_type IN ('view', 'click') THEN 'running' ELSE 'done' END AS status, ts FROM l JOIN events ON event_id = id)
SELECT todo_id, CASE WHEN status = 'running' AND ts < TIMESTAMP '{_LIMIT}' - INTERVAL 30 MINUTE THEN 'error' ELSE status END AS status,
  CASE WHEN status = 'running' AND ts < TIMESTAMP '{_LIMIT}' - INTERVAL 30 MINUTE THEN 'stale_running_reset' ELSE 'work' END AS step FROM t""")
def stale_tasks(spark, sf):
    """Last task states; one that runs for too long counts as failed."""
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("todo_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("view", "click"), "running").otherwise("done").alias("status"),
        F.lit("work").alias("step"), F.lit(None).cast("string").alias("error"), F.col("ts").cast("timestamp").alias("updated_at"))
    return jobs.mark_stale(jobs.latest_tasks(log), _LIMIT, 30).select("todo_id", "status", "step")


@query(f"""SELECT event_id AS seq, user_id AS key FROM events WHERE event_type <> 'signup' AND ts >= TIMESTAMP '{_LIMIT}' - INTERVAL 86400 SECOND""")
def live_entries(spark, sf):
    """T4: cache entries within their time to live."""
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"),
                                            F.when(F.col("event_type") != "signup", F.col("ts").cast("timestamp")).alias("at"))
    return state.live_cache(log, _LIMIT).select("seq", "key")


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-01-01')
SELECT 'materials' AS kind, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS left_over FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone) GROUP BY 2
UNION ALL SELECT 'progress', CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT 'registry', '公司' || o_orderkey || '/info', 1 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)""")
def purged_tables(spark, sf):
    """A10: tables, registry cache and progress lines without the expired requests."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("todo_id"), "o_orderdate")
    expired = orders.filter("cast(o_orderdate as date) < date '1995-01-01'").select(
        "todo_id", F.concat(F.lit("公司"), F.col("todo_id").cast("string")).alias("name"))
    mats = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("todo_id"))
    kept = retention.purge({"materials": mats}, expired)["materials"].groupBy(F.col("todo_id").cast("string").alias("key")).agg(F.count("*").alias("left_over"))
    lines = orders.select(F.concat(F.lit('{"todoId": "'), F.col("todo_id").cast("string"), F.lit('"}')).alias("value"))
    progress = retention.purge_progress(lines, expired).select(F.get_json_object("value", "$.todoId").alias("key"))
    cache = orders.select(F.concat(F.lit("公司"), F.col("todo_id").cast("string"), F.lit("/info")).alias("key"))
    registry_kept = retention.purge_registry_cache(cache, expired)
    one = F.lit(1).cast("bigint")
    return (kept.select(F.lit("materials").alias("kind"), "key", "left_over")
            .unionByName(progress.select(F.lit("progress").alias("kind"), "key", one.alias("left_over")))
            .unionByName(registry_kept.select(F.lit("registry").alias("kind"), "key", one.alias("left_over"))))


@query("""WITH e AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY user_id)
SELECT CAST(row_number() OVER (ORDER BY newest, user_id) AS INTEGER) AS place, user_id AS todo_id FROM e QUALIFY place <= 50""")
def oldest_inventory(spark, sf):
    """L3: the inventory, oldest first (the first page of it)."""
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("todo_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("cached_at"))
    first = retention.in_order(rows.withColumn("name", F.lpad(F.col("todo_id").cast("string"), 12, "0"))).limit(50)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("cached_at", "name", "todo_id"))).alias("r"))
    return listed.select(F.posexplode("r").alias("i", "r")).select((F.col("i") + 1).alias("place"), "r.todo_id")


# --- registry and certificates -----------------------------------------------------------
_PAYLOAD = """pay AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{broken'
  WHEN 2 THEN '{"rows": [{"报告期": "2000-12-31", "ReportDate": "1999"}, {"报告期": "", "报告年度": "1998"}]}'
  WHEN 3 THEN '{"a": {"b": [{"ReportDate": "1997-06-30"}]}, "报告期": "1996"}' WHEN 4 THEN '{"note": "报告期：无 {x}", "k": []}' ELSE '[{"报告年度": "2000"}]' END AS financial,
  CASE s_suppkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS submitted FROM supplier)"""
_MANUAL = "公开财务数据不能证明上传财报已经审计；转人工核验上年度经审计财报。"


@query(f"""WITH {_PAYLOAD}, p AS (SELECT *, CASE id % 6 WHEN 2 THEN '1998、2000-12-31' WHEN 3 THEN '1996、1997-06-30' WHEN 5 THEN '2000' ELSE '' END AS periods FROM pay),
d AS (SELECT *, CASE WHEN periods = '' THEN '未取得带报告期的公开财务数据；' || '{_MANUAL}' WHEN id % 6 = 3 THEN '公开数据非上年度，报告期：' || periods || '；' || '{_MANUAL}'
  ELSE '已取得上年度公开财务数据，仍需核对三表完整性及审计意见；' || '{_MANUAL}' END AS detail FROM p)
SELECT id, periods, CASE WHEN submitted IS NULL THEN '财报上传状态未确认；' || detail WHEN NOT submitted
  THEN '缺少经审计的上年度财报；请补交后转人工核查年度、三表完整性及审计意见；公开财务数据不能替代应上传的经审计财报。' ELSE detail END AS assessment FROM d""")
def financial_assessments(spark, sf):
    """K5: reporting periods in nested payloads, and the wording of the assessment."""
    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    rows = financial.assess_financial(spark.sql(f"WITH {_PAYLOAD} SELECT * FROM pay"), AS_OF)
    return rows.select("id", F.array_join("periods", "、").alias("periods"), "assessment")


_REG = """reg AS (SELECT o_orderkey AS todo_id, o_custkey, CASE WHEN o_orderkey % 9 > 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN '不一致' ELSE '一致' END END AS r_accuracy,
  CASE WHEN o_orderkey % 9 > 0 THEN '公司' || o_custkey END AS r_company_name, CASE WHEN o_orderkey % 9 > 0 THEN CASE WHEN o_custkey % 3 = 0 THEN '李四' ELSE '张三' END END AS r_legal_person,
  CASE WHEN o_orderkey % 9 > 0 THEN CASE WHEN o_custkey % 4 = 0 THEN '900万元' ELSE '500万人民币' END END AS r_registered_capital,
  CASE WHEN o_orderkey % 9 > 0 THEN CASE WHEN o_custkey % 5 = 0 THEN '注销' ELSE '存续' END END AS r_reg_status, o_orderkey % 9 > 0 AS r_has_reg,
  o_custkey % 7 = 0 AS related, o_orderkey % 2 = 0 AS has_financial_report, CASE WHEN o_custkey % 2 = 0 THEN 'fail' ELSE 'pending' END AS before FROM orders)"""


@query(f"""WITH {_REG}, f AS (SELECT *, r_accuracy <> '一致' AS incomplete, concat_ws('；', CASE WHEN r_legal_person = '李四' THEN '法人不一致（审批系统:张三 / 工商登记:李四）' END,
  CASE WHEN r_registered_capital = '900万元' THEN '注册资本不一致（审批系统:500万 / 工商登记:900万）' END, CASE WHEN r_reg_status = '注销' THEN '工商登记状态异常：「注销」' END) AS found FROM reg),
a01 AS (SELECT todo_id, 'A01' AS rule_id, CASE WHEN NOT r_has_reg THEN before WHEN incomplete THEN CASE WHEN before = 'fail' THEN 'fail' ELSE 'manual' END WHEN found <> '' THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN NOT r_has_reg THEN '原' WHEN incomplete THEN CASE WHEN before = 'fail' THEN '原' ELSE '企查查身份核验不完整或不一致，需人工核验' END WHEN found <> '' THEN '企查查核验发现问题：' || found
    ELSE '企查查核验通过：名称/信用代码一致，法定代表人' || r_legal_person || '，注册资本' || r_registered_capital || '，登记状态「' || r_reg_status || '」' END AS detail,
  CASE WHEN NOT r_has_reg THEN '' WHEN incomplete THEN '法律主体资格：公开信息不足以确认一致' WHEN found <> '' THEN '法律主体资格：' || found ELSE '' END AS issue FROM f),
a02 AS (SELECT todo_id, 'A02', CASE WHEN related THEN 'fail' ELSE 'partial' END, CASE WHEN related THEN '企查查股权穿透发现中交系统关联：股东「中交某局」（持股60%）、实际控制人「中港集团」'
    ELSE '企查查股权穿透：未发现中交系统关联（股东：王五(40%)，实际控制人王五）；身份证有效期仍需人工核验' END,
  CASE WHEN related THEN '股权穿透发现中交关联：股东「中交某局」（持股60%）、实际控制人「中港集团」' ELSE '' END FROM f),
a08 AS (SELECT todo_id, 'A08', CASE WHEN has_financial_report THEN 'manual' ELSE 'fail' END, d, 'A08 财报：' || d FROM (SELECT todo_id, has_financial_report, CASE WHEN has_financial_report
  THEN '未取得带报告期的公开财务数据；{_MANUAL}' ELSE '缺少经审计的上年度财报；请补交后转人工核查年度、三表完整性及审计意见；公开财务数据不能替代应上传的经审计财报。' END AS d FROM f)),
a10 AS (SELECT todo_id, 'A10', CASE WHEN r_reg_status = '注销' THEN 'fail' ELSE 'manual' END,
  CASE WHEN NOT r_has_reg THEN '企查查未查到该企业数据，商业信誉（失信被执行人/被执行人/限制消费令/经营异常/严重违法）需人工核验' WHEN r_reg_status = '注销' THEN '企查查登记状态异常：「注销」，需人工复核'
    ELSE '企查查登记状态「存续」正常；失信被执行人/被执行人/限制消费令/经营异常/严重违法：企查查无对应数据，需人工核验' END,
  CASE WHEN NOT r_has_reg THEN 'A10 商业信誉：企查查无数据，需人工核验' WHEN r_reg_status = '注销' THEN '商业信誉：企查查登记状态「注销」异常' ELSE 'A10 商业信誉：失信/被执行等专项数据企查查无数据，需人工核验' END FROM f)
SELECT * FROM a01 UNION ALL SELECT * FROM a02 UNION ALL SELECT * FROM a08 UNION ALL SELECT * FROM a10""")
def registry_enrichment(spark, sf):
    """K6, K7: registry findings over the four items they touch, every branch."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(f"WITH {_REG} SELECT * FROM reg").repartition("todo_id")
    held = F.array(F.struct(F.when(F.col("related"), "中交某局").otherwise("王五").alias("name"), F.when(F.col("related"), "60%").otherwise("40%").alias("share")))
    items = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col("before").alias("status"), F.lit("原").alias("detail")) for r in ("A01", "A02", "A08", "A10")])
    known = rows.select(
        "todo_id", "r_accuracy", "r_company_name", "r_legal_person", "r_registered_capital", "r_reg_status", "r_has_reg", "has_financial_report",
        held.alias("r_shareholders"), F.array(F.when(F.col("related"), "中港集团").otherwise("王五")).alias("r_controllers"),
        F.lit(None).cast("string").alias("r_financial"), F.lit("张三").alias("legal_person"), F.lit(500.0).alias("registered_capital"), items.alias("items"))
    item = registry.enrich_registry(known, AS_OF).select("todo_id", F.explode("items").alias("i"))
    return item.select("todo_id", "i.rule_id", "i.status", "i.detail", tx.blank(F.col("i.registry_issue")).alias("issue"))


@query(f"""WITH {MAT}, {READ}, r AS (SELECT *, row_number() OVER w AS ordinal, count(*) OVER (PARTITION BY todo_id, doc_type) AS documents FROM reading
  WINDOW w AS (PARTITION BY todo_id, doc_type ORDER BY position, doc_id))
SELECT todo_id, doc_type, '核验通过：' || string_agg(CASE WHEN documents > 1 THEN '附件' || ordinal || ' ' ELSE '' END || '在有效期内', '；' ORDER BY ordinal) AS passed
FROM r WHERE check_value GROUP BY todo_id, doc_type""")
def passed_checks(spark, sf):
    """Passed checks of each request and type, by attachment."""
    return review.passed_checks(ocr.combine_attachments(readings(spark, sf)))


_ITEMS = """it AS (SELECT o_orderkey AS todo_id, CASE o_custkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'partial' WHEN 2 THEN 'fail' WHEN 3 THEN 'manual' WHEN 4 THEN 'pass' ELSE 'skip' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN '材料已上传；待核验：有效期' WHEN 1 THEN '一项；二项' WHEN 2 THEN '无分号' ELSE '' END AS detail, CASE WHEN o_orderkey % 3 = 0 THEN 'missing' WHEN o_orderkey % 3 = 1 THEN 'auto' END AS role FROM orders)"""


@query(f"""WITH {_ITEMS} SELECT todo_id, coalesce(CASE WHEN role = 'missing' AND status <> 'fail' THEN NULL ELSE role END, '') AS role,
  coalesce(CASE WHEN status = 'pending' THEN CASE WHEN detail LIKE '%；待核验：%' THEN '有效期' ELSE detail END
  WHEN status = 'partial' THEN CASE todo_id % 4 WHEN 0 THEN '待核验：有效期' WHEN 1 THEN '二项' END WHEN status IN ('fail', 'manual') THEN detail END, '') AS verify FROM it""")
def verify_points(spark, sf):
    """Missing items and points to verify, derived again from the enriched items."""
    from ..operators.checklist import verify_items

    table(spark, sf, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(f"WITH {_ITEMS} SELECT * FROM it").select(
        "todo_id", F.array(F.struct("status", "detail", "role", F.lit("old").alias("verify"))).alias("items"))
    item = verify_items(rows).select("todo_id", F.explode("items").alias("i"))
    return item.select("todo_id", tx.blank(F.col("i.role")).alias("role"), tx.blank(F.col("i.verify")).alias("verify"))


_DAY = "strftime(valid_until, '%Y-%m-%d')"
_ASOF = f"DATE '{AS_OF}'"
_PAPERS = f"""{APPS}, {MAT}, paper AS (SELECT m.*, a.supplier_id, m.todo_id || '-' || m.position || '-' || m.part_id || '-' || m.issuer_id || '-' || m.tie_break AS doc_id,
  m.part_id % 4 AS layout FROM mat m JOIN app a ON m.todo_id = a.todo_id)"""


def _papers(spark, sf, doc_type: str, text_: Column, **known: Column) -> DataFrame:
    rows = view(spark, sf, "material").join(applications(spark, sf), "todo_id")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("todo_id", "position", "part_id", "issuer_id", "tie_break")])
    docs = rows.select(key.alias("doc_id"), key.alias("todo_id"), F.lit(doc_type).alias("doc_type"), F.lit("a.png").alias("file"), F.lit(0).alias("position"), text_.alias("text"),
                       F.lit(None).cast("string").alias("sha256"), F.lit("e").alias("engine"), F.lit(None).cast("string").alias("error"))
    values = {"name": F.lit(""), "full_name": F.lit(""), "social_credit_code": F.lit(""), "legal_person": F.lit(""), "registered_capital": F.lit(0.0), "busi_scope": F.lit(""), **known}
    suppliers = rows.select(key.alias("todo_id"), *[v.alias(k) for k, v in values.items()])
    return extract_all(docs, _no_lines(spark), suppliers, AS_OF, [doc_type])


@query(f"""WITH {_PAPERS} SELECT doc_id, CASE WHEN layout = 3 THEN 'unknown' ELSE 'true' END AS both_sides,
  CASE WHEN check_value IS NULL THEN 'unknown' WHEN check_value THEN 'true' ELSE 'false' END AS name_ok,
  CASE layout WHEN 1 THEN 'true' WHEN 3 THEN 'unknown' ELSE CASE WHEN valid_until >= {_ASOF} THEN 'true' ELSE 'false' END END AS valid,
  CASE layout WHEN 1 THEN '长期' WHEN 3 THEN '' ELSE {_DAY} END AS until FROM paper""")
def id_card_texts(spark, sf):
    """Identity cards in four layouts, from text lines."""
    layout, day = F.col("part_id") % 4, F.date_format("valid_until", "yyyy.MM.dd")
    end = F.when(layout == 1, F.lit("\n有效期限 1990.01.02-长期")).when(layout == 3, F.lit("")).otherwise(F.concat(F.lit("\n有效期限 1990.01.02-"), day))
    body = F.concat(F.when(layout == 2, "| 姓名 | 张三 |").otherwise("姓名 张三"), F.lit("\n性别 男"), end)
    person = F.when(F.col("check_value").isNull(), "张五").when(F.col("check_value"), "张三").otherwise("赵六七")
    c = F.col("checks")
    found = _papers(spark, sf, "legal_person_id", body, legal_person=person)
    return found.select("doc_id", flag_text(c["正反面齐全"]).alias("both_sides"), flag_text(c["姓名与法人一致"]).alias("name_ok"),
                        flag_text(c["在有效期内"]).alias("valid"), tx.blank(F.col("fields")["有效期至"]).alias("until"))


@query(f"""WITH {_PAPERS} SELECT doc_id, CASE WHEN layout = 3 THEN 'false' ELSE 'true' END AS kind_ok,
  CASE WHEN layout = 3 THEN 'absent' WHEN check_value IS NULL THEN 'unknown' ELSE 'true' END AS holder_ok,
  CASE layout WHEN 3 THEN 'unknown' ELSE CASE WHEN valid_until >= {_ASOF} THEN 'true' ELSE 'false' END END AS valid,
  CASE layout WHEN 3 THEN '' WHEN 1 THEN '' ELSE 'XK00-' || lpad(CAST(part_id % 1000 AS VARCHAR), 3, '0') || '-00001' END AS number FROM paper""")
def production_licences(spark, sf):
    """Production licences and compulsory certificates."""
    layout, day = F.col("part_id") % 4, F.date_format("valid_until", "yyyy年MM月dd日")
    number = F.concat(F.lit("XK00-"), F.lpad((F.col("part_id") % 1000).cast("string"), 3, "0"), F.lit("-00001"))
    own = F.concat(F.lit("合成"), F.col("supplier_id").cast("string"), F.lit("号有限公司"))
    holder = F.when(F.col("check_value").isNull(), "另一家有限公司").otherwise(own)
    body = (F.when(layout == 3, F.lit("营业执照\n注册资本1000万元"))
            .when(layout == 1, F.concat(F.lit("中国国家强制性产品认证证书 CCC认证\n持证单位 "), holder, F.lit(" 有效期至："), day))
            .otherwise(F.concat(F.lit("全国工业产品生产许可证\n许可证编号："), number, F.lit(" 持证单位 "), holder, F.lit(" 有效期至："), day)))
    found = _papers(spark, sf, "production_license", body, full_name=own)
    c = F.col("checks")
    holds = F.when(F.array_contains(F.map_keys(c), "持证主体一致"), flag_text(c["持证主体一致"])).otherwise("absent")
    return found.select("doc_id", flag_text(c["材料类型正确"]).alias("kind_ok"), holds.alias("holder_ok"), flag_text(c["在有效期内"]).alias("valid"),
                        tx.blank(F.col("fields")["证书编号"]).alias("number"))


@query(f"""WITH {MAT}, c AS (SELECT todo_id, position, part_id, issuer_id, tie_break, valid_until, check_value,
  todo_id || '-' || position || '-' || part_id || '-' || issuer_id || '-' || tie_break AS doc_id FROM mat)
SELECT doc_id, CASE WHEN check_value IS NULL THEN 'unknown' ELSE 'true' END AS both_sides, CASE part_id % 3 WHEN 0 THEN 'true' ELSE 'false' END AS name_ok,
  CASE WHEN check_value IS NULL THEN 'absent' WHEN check_value THEN 'true' WHEN valid_until >= {_ASOF} THEN 'true' ELSE 'false' END AS valid FROM c""")
def id_cards(spark, sf):
    """Identity cards from card rows: the last front and the last back of a document count."""
    rows = view(spark, sf, "material")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("todo_id", "position", "part_id", "issuer_id", "tie_break")])
    term = F.when(F.col("check_value"), "1990.01.02-长期").otherwise(F.concat(F.lit("1990.01.02-"), F.date_format("valid_until", "yyyy"), F.date_format("valid_until", "MM.dd")))
    sides = F.array(
        F.struct(F.lit(1).alias("card_index"), F.lit("front").alias("side"), F.lit("旧名字").alias("name"), F.lit(None).cast("string").alias("valid_until")),
        F.struct(F.lit(2).alias("card_index"), F.lit("front").alias("side"), F.lit("张三").alias("name"), F.lit(None).cast("string").alias("valid_until")),
        F.struct(F.lit(3).alias("card_index"), F.when(F.col("check_value").isNotNull(), "back").otherwise("unknown").alias("side"), F.lit(None).cast("string").alias("name"), term.alias("valid_until")))
    cards = rows.select(key.alias("todo_id"), key.alias("doc_id"), F.lit("a").alias("file"), F.explode(sides).alias("s")).select(
        "todo_id", "doc_id", "file", F.lit(1).alias("page"), "s.*", F.lit("ok").alias("status"))
    assert {f.split()[0] for f in CARD.split(", ")} == set(cards.columns)
    known = rows.select(key.alias("todo_id"), F.when(F.col("part_id") % 3 == 0, "张三").otherwise("赵六七").alias("legal_person"))
    c = F.col("result.checks")
    valid = F.when(F.array_contains(F.map_keys(c), "在有效期内"), flag_text(c["在有效期内"])).otherwise("absent")
    return idcard_checks(cards, known, AS_OF).select(
        "doc_id", flag_text(c["正反面齐全"]).alias("both_sides"), flag_text(c["姓名与法人一致"]).alias("name_ok"), valid.alias("valid"))


_ANSWERS = """ans AS (
  SELECT CAST(s_suppkey AS STRING) AS key, 'baseinfo' AS part, 2 AS seq, CASE s_suppkey % 5 WHEN 0 THEN '{"result": null, "data": {"企业名称": "旧"}}' WHEN 1 THEN '{"data": {"企业名称": "' || s_name || '", "登记状态": "存续"}}'
    WHEN 2 THEN '[1]' ELSE '{"result": {"企业名称": "' || s_name || '", "注册资本": "500万元", "登记状态": "在业"}, "data": {"企业名称": "旧"}}' END AS response FROM supplier
  UNION ALL SELECT CAST(s_suppkey AS STRING), 'baseinfo', 1, '{"result": {"企业名称": "更旧"}}' FROM supplier
  UNION ALL SELECT CAST(s_suppkey AS STRING), 'verify_ic', 3, '{"result": {"核验结果是否一致": "一致"}}' FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT CAST(s_suppkey AS STRING), 'holders', 4, '{"result": [{"股东名称": "甲", "持股比例": "60%"}, {"股东名称": "乙", "持股比例": "40%"}]}' FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT CAST(s_suppkey AS STRING), 'balance_sheet', 5, '{"result": [{"报告期": "2000-12-31"}]}' FROM supplier WHERE s_suppkey % 4 = 0)"""


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 5 IN (1, 3, 4) THEN s_name ELSE '' END AS company_name,
  CASE WHEN s_suppkey % 5 >= 3 THEN '500万元' ELSE '' END AS registered_capital, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 2 THEN '' WHEN 1 THEN '存续' ELSE '在业' END AS reg_status,
  CASE WHEN s_suppkey % 2 = 0 THEN '一致' ELSE '' END AS accuracy, CASE WHEN s_suppkey % 3 = 0 THEN '甲60%,乙40%' ELSE '' END AS holders,
  CASE WHEN s_suppkey % 4 = 0 THEN '2000-12-31' ELSE '' END AS periods FROM supplier""")
def registry_records(spark, sf):
    """landed answers with envelopes of every kind as registry records."""
    from ..sources.readers import registry_of

    table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    found = registry_of(spark.sql(f"WITH {_ANSWERS} SELECT * FROM ans"))
    return found.select("key", *[tx.blank(F.col(c)).alias(c) for c in ("company_name", "registered_capital", "reg_status", "accuracy")],
                        F.array_join(F.transform("shareholders", lambda h: F.concat(h["name"], h["share"])), ",").alias("holders"),
                        F.array_join(financial.report_periods(F.col("financial")), ",").alias("periods"))


@query(f"""WITH {MAT}, {FLAGGED}, {FACTS}, r AS (SELECT o_orderkey AS todo_id, o_orderkey % 3 = 0 AS hidden, CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS stated FROM orders),
j AS (SELECT r.todo_id, CASE WHEN hidden THEN stated ELSE coalesce(financial, FALSE) END AS submitted, CASE WHEN NOT hidden THEN year_ok END AS ok, CASE WHEN NOT hidden THEN any_year END AS seen
  FROM r LEFT JOIN facts f ON r.todo_id = f.todo_id)
SELECT todo_id, coalesce(CAST(submitted AS VARCHAR), 'not known') AS submitted, CASE WHEN submitted IS NULL THEN 'unknown' WHEN NOT submitted THEN 'missing' WHEN ok THEN 'matched'
  WHEN seen THEN 'mismatch' ELSE 'unknown' END AS status FROM j""")
def upload_states(spark, sf):
    """K4 with its third state: lists of uploads that have not landed."""
    apps = applications(spark, sf)
    key = F.col("todo_id")
    stated = F.when(key % 4 == 0, True).when(key % 4 == 1, False)
    requests_ = apps.select("todo_id", (key % 3 != 0).alias("has_list"), stated.alias("has_financial_report"))
    landed = typed_materials(spark, sf).filter("todo_id % 3 <> 0")
    checked = financial.financial_title_check(landed, requests_, AS_OF)
    return checked.select("todo_id", F.coalesce(F.col("submitted").cast("string"), F.lit("not known")).alias("submitted"), "status")


_REV = """rv AS (SELECT o_orderkey AS todo_id, o_custkey % 4 AS kind, o_orderkey % 5 AS k FROM orders)"""


@query(f"""WITH {_REV} SELECT todo_id, CASE kind
  WHEN 0 THEN '获证组织=甲；认证机构=乙；' || CASE k WHEN 0 THEN '有效期至 2002-01-01，在有效期内' WHEN 1 THEN '有效期至 2002-01-01，已过期' WHEN 2 THEN '有效期至 2002-01-01' ELSE '未识别到有效期' END
    || CASE k WHEN 1 THEN '' ELSE '' END || '；核验通过：' || CASE WHEN k IN (3, 4) THEN '材料类型正确、在有效期内' ELSE '材料类型正确' END
  WHEN 1 THEN '名称=丙；法定代表人=张三；注册资本=500.0万' || CASE WHEN k = 0 THEN '；法定代表人：执照「张三」vs 系统「李四」不一致' ELSE '' END || CASE WHEN k = 1 THEN '；信用代码：执照与系统不一致' ELSE '' END
    || CASE WHEN k <> 0 THEN '；核验通过：法人一致' ELSE '' END
  WHEN 2 THEN CASE WHEN k < 2 THEN '甲栏=一；乙栏=None；2 项不符' ELSE '甲栏=一；乙栏=None；请人工核验' END
  ELSE 'OCR 失败' END AS verified FROM rv""")
def review_cells(spark, sf):
    """What the review table shows of certificates of each kind, failed readings included."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(f"WITH {_REV} SELECT * FROM rv")
    kind, k, lit = F.col("kind"), F.col("k"), F.lit
    none = lit(None).cast("boolean")
    valid = F.when(k.isin(0, 3, 4), True).when(k == 1, False)
    iso_fields = F.create_map(lit("获证组织"), lit("甲"), lit("认证机构"), lit("乙"), lit("有效期至"), F.when(k < 3, "2002-01-01"))
    iso_checks = F.create_map(lit("材料类型正确"), lit(True), lit("在有效期内"), valid)
    licence_fields = F.create_map(lit("名称"), lit("丙"), lit("法定代表人"), lit("张三"), lit("注册资本_万"), lit("500.0"))
    licence_checks = F.create_map(lit("法人一致"), k != 0, lit("信用代码一致"), F.when(k == 1, False).otherwise(none))
    plain_fields = F.create_map(lit("甲栏"), lit("一"), lit("乙栏"), lit(None).cast("string"))
    plain_checks = F.create_map(lit("一致"), lit(False), lit("完整"), lit(False))
    docs = rows.select(
        "todo_id", F.when(kind == 0, "iso9001").when(kind == 1, "business_license").otherwise("authorization").alias("doc_type"), lit(0).alias("position"), lit("d").alias("doc_id"), lit("a.png").alias("file"),
        F.when(kind == 0, iso_fields).when(kind == 1, licence_fields).when(kind == 2, plain_fields).alias("fields"),
        F.when(kind == 0, iso_checks).when(kind == 1, licence_checks).when(kind == 2, plain_checks).alias("checks"),
        F.when((kind == 2) & (k >= 2), F.array(lit("请人工核验"))).alias("issues"), F.when(kind == 3, "OCR 失败").alias("error"))
    shown = review.verification(ocr.combine_attachments(docs).withColumn("system_person", lit("李四")))
    return shown.select("todo_id", "verified")


_MERGE = """mg AS (SELECT o_orderkey AS todo_id, CASE o_custkey % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'manual' WHEN 2 THEN 'pass' WHEN 3 THEN 'partial' END AS licence,
  CASE o_custkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'manual' END AS transport, o_orderkey % 2 = 0 AS has_files, o_orderkey % 3 > 0 AS conflict,
  CASE o_orderkey % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'manual' WHEN 2 THEN 'pass' ELSE 'pending' END AS before,
  CASE o_custkey % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'pass' WHEN 2 THEN 'partial' END AS cert, CASE o_custkey % 7 WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' WHEN 2 THEN 'manual' END AS stmt FROM orders)"""
_GRAVE = "CASE {x} WHEN 'fail' THEN 4 WHEN 'manual' THEN 3 WHEN 'partial' THEN 2 WHEN 'pending' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END"


@query(f"""WITH {_MERGE}, a AS (SELECT *, coalesce(licence, before) AS own, CASE WHEN licence IS NULL THEN '原' || CASE WHEN conflict THEN '企查查' ELSE '' END ELSE '照' || licence END AS text,
  before IN ('fail', 'manual') AND conflict AS kept, '原' || CASE WHEN conflict THEN '企查查' ELSE '' END AS old FROM mg),
a01 AS (SELECT todo_id, 'A01' AS rule_id, CASE WHEN kept AND own = 'pass' THEN before ELSE own END AS status, CASE WHEN kept THEN text || '；' || old ELSE text END AS detail,
  CASE WHEN licence IN ('fail', 'manual') THEN '法律主体资格：照有误' ELSE '' END AS issues FROM a),
e1 AS (SELECT todo_id, 'E1', CASE WHEN before = 'fail' AND NOT has_files THEN before ELSE transport END, CASE WHEN before = 'fail' AND NOT has_files THEN '缺少' ELSE '运' || transport END,
  CASE WHEN (before = 'fail' AND NOT has_files) OR transport = 'pass' THEN '' ELSE '运有误' END FROM mg),
one AS (SELECT *, coalesce(cert, before) AS s1, CASE WHEN cert IS NULL THEN '售' ELSE '证' || cert END AS d1 FROM mg),
two AS (SELECT *, coalesce(stmt, s1) AS s2, CASE WHEN stmt IS NULL THEN d1 ELSE '函' || stmt END AS d2 FROM one),
a07 AS (SELECT todo_id, 'A07', CASE WHEN {_GRAVE.format(x="s1")} > {_GRAVE.format(x="s2")} THEN s1 ELSE s2 END, CASE WHEN {_GRAVE.format(x="s1")} > {_GRAVE.format(x="s2")} THEN d1 ELSE d2 END,
  concat_ws(',', CASE WHEN cert = 'manual' THEN '售后服务：证有误' END, CASE WHEN stmt IN ('fail', 'manual') THEN '售后服务：函有误' END) FROM two)
SELECT * FROM a01 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM a07""")
def certificate_merge(spark, sf):
    """Certificate results merged into the items they feed: the graver of two papers, registry conflicts, stale transport papers."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(f"WITH {_MERGE} SELECT * FROM mg")

    def paper(order: int, kind: str, status: str, word: str) -> Column:
        state = F.col(status)
        return F.struct(F.lit(order).alias("type_order"), F.lit(kind).alias("doc_type"), state.alias("status"), F.concat(F.lit(word), state).alias("detail"),
                        F.when(state.isin("fail", "manual"), F.lit(f"{word}有误")).alias("issue"))

    def item(rule: str, name: str, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule_id"), F.lit(name).alias("name"), F.col("before").alias("status"), detail.alias("detail"), F.col("has_files"))

    known = rows.select(
        "todo_id", F.array(paper(0, "business_license", "licence", "照"), paper(4, "transport_license", "transport", "运"),
                           paper(5, "after_sales_cert", "cert", "证"), paper(6, "after_sales_statement", "stmt", "函")).alias("ocr_documents"),
        F.array(item("A01", "法律主体资格", F.concat(F.lit("原"), F.when(F.col("conflict"), "企查查").otherwise(""))), item("E1", "运输承运资质", F.lit("缺少")),
                item("A07", "售后服务", F.lit("售"))).alias("items"))
    found = ocr.enrich_ocr(known).select("todo_id", F.explode("items").alias("i"))
    return found.select("todo_id", "i.rule_id", "i.status", "i.detail", text_of(F.transform("i.ocr_issues", lambda x: x["issue"])).alias("issues"))


@query("""SELECT doc_id AS todo_id, 'f' || doc_id || '.png' AS file FROM documents WHERE doc_id % 5 > 1""")
def masked_files(spark, sf):
    """Masked files whose content is the one recorded at masking; some were changed since, some never recorded."""
    from ..operators.audit import verify_masked

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("todo_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".png")).alias("file"), "text")
    files = docs.select("todo_id", "file", F.when(F.col("todo_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary").alias("content"))
    recorded = docs.select("todo_id", "file", F.when(F.col("todo_id") % 5 != 1, F.sha2(F.col("text").cast("binary"), 256)).alias("masked_sha256"))
    return verify_masked(files, recorded.unionByName(recorded)).select("todo_id", "file")


@query("""SELECT o_orderkey AS todo_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'reject' ELSE 'manual' END AS decision FROM orders""")
def decision_stream(spark, sf):
    """Requests decided as they arrive, each once; the stream is stopped twice, and every seventh request comes again after its state has ended."""
    requests_ = table(spark, sf, "orders").select(F.col("o_orderkey").alias("todo_id"), "o_orderpriority")
    folder = jobs.stream_folder(spark, "decisions")
    decide_ = lambda df: df.select("todo_id", F.when(F.col("o_orderpriority") == "1-URGENT", "reject").otherwise("manual").alias("decision"))
    third = F.col("todo_id") % 3
    for part in (0, 1, 2):
        arriving = requests_.where((third == part) | ((third < part) & (F.col("todo_id") % 7 == 0)))
        arriving.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(requests_.schema).parquet(f"{folder}/in")
        jobs.decide_stream(stream, decide_, f"{folder}/out", f"{folder}/state", "0 seconds").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("todo_id", "decision")


#: Four parts of the log by time; every 50th record arrives with the last part.
_PARTS = """p AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 4 // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) AS part FROM events)"""


def _arriving(spark: SparkSession, events: DataFrame, folder: str, late: Column):
    """Lands four parts of the log, one after the other, and gives the stream over what has landed each time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(micros).alias("low"), F.max(micros).alias("high")).first()
    low, width = ends.low or 0, (ends.high or 0) - (ends.low or 0) + 1
    part = F.when(late, 3).otherwise(F.floor((micros - low) * 4 / width))
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("__part", part)
    for number in range(4):
        marked.where(F.col("__part") == number).drop("__part").write.mode("append").parquet(folder)
        yield spark.readStream.schema(marked.drop("__part").schema).parquet(folder)


@query(f"""WITH {_PARTS}, a AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 3 ELSE part END AS arrives FROM p),
w AS (SELECT max(epoch_us(ts)) FILTER (WHERE arrives < 3) // 1000 - 60000 AS before, max(epoch_us(ts)) // 1000 - 60000 AS after FROM a),
l AS (SELECT user_id, arg_max(event_type, (epoch_us(ts) // 1000, event_id)) AS kind, max(epoch_us(ts) // 1000) AS ms FROM a, w WHERE arrives < 3 OR epoch_us(ts) > before * 1000 GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS todo_id, CASE WHEN kind NOT IN ('view', 'click') THEN 'done' WHEN ms + 36000000 < after THEN 'error' ELSE 'running' END AS status,
  CASE WHEN kind IN ('view', 'click') AND ms + 36000000 < after THEN 'stale_running_reset' ELSE 'step-' || kind END AS step FROM l, w""")
def task_stream_states(spark, sf):
    """Task states after a log that arrives in four parts, with a restart between them, late records and timers of ten hours."""
    events, folder = table(spark, sf, "events"), jobs.stream_folder(spark, "tasks")
    kind = F.col("event_type")
    for stream in _arriving(spark, events, f"{folder}/in", F.col("event_id") % 50 == 0):
        log = stream.select(
            F.col("user_id").alias("todo_id"), F.col("event_id").alias("seq"), F.when(kind.isin("view", "click"), "running").otherwise("done").alias("status"),
            F.concat(F.lit("step-"), kind).alias("step"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("at"))
        found = jobs.run_to_table(jobs.task_stream(log, 600), folder, ["todo_id"])
    return found.select("todo_id", "status", "step")


@query("""WITH l AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type <> 'signup'), w AS (SELECT max(ms) - 3600000 AS now FROM l)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS entries, arg_max(event_id, (ms, event_id)) AS newest FROM l, w WHERE ms + 86400000 >= now GROUP BY user_id""")
def live_entries_stream(spark, sf):
    """T4: cache entries in force per key, kept as state with timers over a log that arrives in four parts."""
    events, folder = table(spark, sf, "events"), jobs.stream_folder(spark, "entries")
    for stream in _arriving(spark, events, f"{folder}/in", F.lit(False)):
        log = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "signup", F.col("ts")).alias("at"))
        found = jobs.run_to_table(jobs.live_stream(log), folder, ["key"], "-entries")
    return found.where("entries > 0").select("key", "entries", "newest")


# --- crowded attachments ----------------------------------------------------------------------
@query("""WITH a AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'one' ELSE 'r' || l_suppkey END AS todo_id, 'iso9001' AS doc_type, l_linenumber > 6 AS later,
    'scan-' || l_orderkey || '-' || l_linenumber AS doc_id FROM lineitem)
SELECT todo_id, doc_id, row_number() OVER (PARTITION BY todo_id ORDER BY later, doc_id) AS ordinal, count(*) OVER (PARTITION BY todo_id) AS documents FROM a""")
def crowded_attachments(spark, sf):
    """Ordinals where one request has a third of all attachments, nearly all of them at position 0."""
    lines = table(spark, sf, "lineitem")
    owner = F.when(F.col("l_suppkey") % 3 == 0, "one").otherwise(F.concat(F.lit("r"), F.col("l_suppkey").cast("string")))
    none = F.create_map().cast("map<string,string>")
    rows = lines.select(
        owner.alias("todo_id"), F.lit("iso9001").alias("doc_type"), F.when(F.col("l_linenumber") > 6, 5).otherwise(0).alias("position"),
        F.concat(F.lit("scan-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("doc_id"),
        F.lit("a.png").alias("file"), none.cast("map<string,boolean>").alias("checks"), none.alias("fields"),
        F.array().cast("array<string>").alias("issues"), F.lit(None).cast("string").alias("error"))
    return ocr.combine_attachments(rows).select("todo_id", "doc_id", "ordinal", "documents")


# --- scalar functions over whole columns -----------------------------------------------------
@query("""SELECT doc_id, translate(text[1:100000000], 'abcXYZ019', 'abcXYZ019') AS folded,
  CASE WHEN length(text) > 100 THEN text[1:100] || '…' ELSE text END AS clipped,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents""")
def text_forms(spark, sf):
    """width folding, clipping and escaping of whole texts."""
    wide = F.translate("text", "abcXYZ019", "ａｂｃＸＹＺ０１９")
    return table(spark, sf, "documents").select(
        "doc_id", tx.fold_width(wide).alias("folded"), tx.clip(F.col("text")).alias("clipped"), tx.html_escape(F.col("text")).alias("escaped"))


@query(f"""SELECT o_orderkey AS todo_id, CASE WHEN o_orderkey % 3 = 2 THEN -o_totalprice ELSE o_totalprice END AS amount,
  o_totalprice AS plain, round((o_orderkey % 10000) / 10000, 4) AS share, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE date_diff('year', o_orderdate, {_ASOF}) END AS years FROM orders""")
def amounts(spark, sf):
    """Amounts written in several ways, and ages."""
    orders = table(spark, sf, "orders")
    written = F.format_number("o_totalprice", 2)
    stated = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("("), written, F.lit(")"))).otherwise(written)
    found = F.when(F.col("o_orderkey") % 4 == 0, "不详").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.select(F.col("o_orderkey").alias("todo_id"), numbers.signed_number(stated).alias("amount"),
                         numbers.float_text(F.col("o_totalprice")).cast("double").alias("plain"),
                         F.round(numbers.percent_value(numbers.percent_text((F.col("o_orderkey") % 10000) / 10000)), 4).alias("share"), profile.years_since(found, F.lit(AS_OF).cast("date")).cast("bigint").alias("years"))


@query("""SELECT event_id AS seq, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') END AS moment FROM events""")
def iso_moments(spark, sf):
    """times with and without offsets, and text that is none."""
    at = F.col("ts").cast("timestamp")
    plain = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.concat(F.date_format(at + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+08:00"))
    case = F.col("event_id") % 4
    written = F.when(case == 0, F.concat(plain, F.lit("Z"))).when(case == 1, shifted).when(case == 2, plain).otherwise("昨天")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), moment_text(dates.parse_iso(written)).alias("moment"))
