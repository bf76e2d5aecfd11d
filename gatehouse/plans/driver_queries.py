"""The operators run over the driver's tables. Every query reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_close as names_are_close
from ..operators import audit, checklist, classify, compare, decide, financial, layout, masking, ocr
from ..operators import registry as reg
from ..operators import retention, review, routing, rules, state
from ..operators.extract import confidence_distribution as distribution
from ..operators.extract import extract_all, shared_results, to_extract
from ..operators.extract.dispatch import READING
from ..operators.profile import with_region
from ..streaming import jobs
from .adapters import AS_OF, HMT_NATIONS, materials, requests, suppliers, table, view

CATALOGUE = rules.load_catalogue()


def applications(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "application")


def landed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """`rows` as a table in the shared folder, for plans that read them several times."""
    folder = jobs.stream_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def log(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "log")


def text_of(items: Column, separator: str = ",") -> Column:
    return F.array_join(items, separator)


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def moment_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- requests and routing -----------------------------------------------------
def request_page(spark, sf):
    named = applications(spark, sf).join(
        view(spark, sf, "supplier_view").select("supplier_id", "name"), "supplier_id")
    found = state.list_requests(named, query="99", bill="P0702")
    return state.page(found, 2, 50, newest="apply_date").select(
        "todo_id", "name", "bill_type", day_text(F.col("apply_date")).alias("apply_date"))


def region_routing(spark, sf):
    known = with_region(view(spark, sf, "supplier_view"), HMT_NATIONS)
    joined = applications(spark, sf).join(known, "supplier_id").withColumn("bill_name", F.lit(""))
    return routing.route_stage1(joined).select(
        "todo_id", "is_overseas", "is_hmt", "is_foreign",
        F.coalesce("route_decision", F.lit("rules")).alias("route"))


def rule_set_routing(spark, sf):
    routed = suppliers(spark, sf)
    applied = routing.applicable_rules(routed, CATALOGUE, "supplier_id")
    listed = applied.groupBy("supplier_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "rule_id"))).alias("r"))
    per_supplier = routed.select("supplier_id", "type_desc").join(listed, "supplier_id")
    return applications(spark, sf).join(per_supplier, "supplier_id").select(
        "todo_id", "type_desc", F.size("r").alias("rule_count"),
        text_of(F.transform("r", lambda x: x["rule_id"])).alias("rule_ids"))


def rule_eval(spark, sf):
    return rules.evaluate_rules(requests(spark, sf, texts=False), CATALOGUE)


# --- materials ------------------------------------------------------------------
def material_keyword(spark, sf):
    return classify.material_rollup(materials(spark, sf)).select(
        "todo_id", "uploads", text_of(F.col("classified_materials")).alias("types"),
        text_of(F.col("certifications")).alias("certifications"))


def material_first_match(spark, sf):
    named = classify.classify_by_name(view(spark, sf, "material"))
    return named.groupBy("todo_id", F.coalesce("name_type", F.lit("none")).alias("name_type")).agg(
        F.count(F.lit(1)).alias("uploads"))


def slot_conflicts(spark, sf):
    return classify.iso_conflicts(materials(spark, sf))


def typed_materials(spark, sf):
    flagged = materials(spark, sf)
    kinds = sorted(c for c in flagged.columns if c.startswith("is_"))
    return flagged.withColumn("types", classify.listed({k[3:]: F.col(k) for k in kinds}))


def public_gate(spark, sf):
    mats = materials(spark, sf)
    files = mats.select("todo_id", F.concat(F.col("issuer_id").cast("string"), F.lit("_"), "file_name").alias("file")).distinct()
    return masking.with_public_flag(classify.match_files(files, mats)).select(
        "todo_id", "file", text_of(F.col("types")).alias("types"), "is_public")


def proof_texts(spark, sf):
    return classify.proof_files(materials(spark, sf))


def title_years(spark, sf):
    mats = typed_materials(spark, sf)
    checked = financial.financial_title_check(mats, applications(spark, sf), AS_OF)
    return checked.select("todo_id", "submitted", "status", "required_year", text_of(
        F.transform("title_years", lambda y: y.cast("string"))).alias("title_years"))


def missing_materials(spark, sf):
    kept = ["todo_id", "classified_materials", "financial_submitted"]
    items = checklist.checklist_statuses(requests(spark, sf, texts=False), CATALOGUE, AS_OF, kept)
    return review.missing_materials(items).select("todo_id", "rule_id", "label")


# --- checklist and decision -------------------------------------------------------
def checklist_rows(spark, sf):
    return checklist.build_checklist(requests(spark, sf), CATALOGUE, AS_OF).select(
        "todo_id", "rule_id", "status", "detail")


def _decided(spark, sf):
    staged = routing.route_stage1(requests(spark, sf, texts=False))
    kept = ["todo_id", "type_desc", "route_decision"]
    ruled = decide.decide_items(checklist.checklist_items(staged, CATALOGUE, AS_OF, kept))
    return ruled.withColumn("decision", F.coalesce("route_decision", "decision"))


def decision(spark, sf):
    staged = routing.route_stage1(requests(spark, sf, texts=False))
    kept = ["todo_id", "type_desc", "route_decision"]
    flags = checklist.checklist_flags(staged, CATALOGUE, AS_OF, kept)
    return flags.select("todo_id", "type_desc", F.coalesce(
        "route_decision", decide.verdict(F.col("reject"), F.col("manual"))).alias("decision"))


def decision_summary(spark, sf):
    def ids(status: str) -> Column:
        return F.transform(F.filter("items", lambda i: i["status"] == status), lambda i: i["rule_id"])

    results = _decided(spark, sf).select(
        "decision", ids("fail").alias("qcc_issues"), ids("manual").alias("ocr_issues"))
    return decide.decision_summary(results).select(
        "decision", "requests", F.col("registry_issues").alias("failed_items"),
        F.col("ocr_issues").alias("manual_items"))


def opinion_text(spark, sf):
    staged = routing.route_stage1(requests(spark, sf))
    kept = ["todo_id", "route_decision", "route_opinion", *decide.OPINION_COLUMNS]
    ruled = decide.opinion_items(checklist.checklist_items(staged, CATALOGUE, AS_OF, kept))
    return ruled.select("todo_id", F.coalesce("route_decision", "decision").alias("decision"),
                        F.coalesce("route_opinion", "opinion").alias("opinion"))


def opinion_final(spark, sf):
    kept = ["todo_id", "financial_submitted", "financial_years"]
    items = decide.decide_items(checklist.checklist_items(requests(spark, sf), CATALOGUE, AS_OF, kept))
    status = financial.year_status(F.col("financial_submitted"), F.col("financial_years"), F.lit(AS_OF).cast("date"))
    reviewed = items.withColumns({
        "financial_status": status, "domestic_tip": F.lit(""), "opinion": F.lit(""), "skip_reason": F.lit("")})
    return decide.opinion_final(reviewed).select("todo_id", "final_opinion")


# --- registry ---------------------------------------------------------------------
def registry_match(spark, sf):
    asked = view(spark, sf, "supplier_view").select(
        "supplier_id", F.concat(F.lit("C"), F.col("supplier_id").cast("string")).alias("code"),
        F.concat(F.lit("A"), F.floor("registered_capital").cast("string")).alias("short"),
        F.col("country_name").alias("unit"))
    known = table(spark, sf, "supplier")
    nations = table(spark, sf, "nation")
    by_code = known.select(F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("key"), "s_suppkey")
    by_name = known.groupBy(F.concat(F.lit("A"), F.floor("s_acctbal").cast("string")).alias("key")).agg(
        F.min("s_suppkey").alias("s_suppkey"))
    by_unit = (known.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
               .groupBy(F.col("n_name").alias("key")).agg(F.min("s_suppkey").alias("s_suppkey")))
    records = by_code.unionByName(by_name).unionByName(by_unit)
    matched = reg.match_registry(asked, records, ["code", "short", "unit"], "supplier_id")
    return asked.select("supplier_id").join(matched, "supplier_id", "left").select(
        "supplier_id", "match_rank", F.col("s_suppkey").alias("registry_id"))


def related_parties(spark, sf):
    holders = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return reg.related_parties(holders, ["0099", "77", "123"]).select("c_custkey", "name", "related_word")


def name_close(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("todo_id"), F.col("l_linenumber").alias("position"),
        F.col("o_custkey").cast("string").alias("person"), F.col("l_suppkey").cast("string").alias("card"))
    verdict = F.when(F.col("person") == F.col("card"), "same").when(
        names_are_close(F.col("person"), F.col("card")), "close").otherwise("different")
    return pairs.select("todo_id", "position", "person", "card", verdict.alias("verdict"))


# --- certificate results ------------------------------------------------------------
def readings(spark, sf):
    mats = view(spark, sf, "material")
    ok = F.col("check_value")
    return mats.select(
        "todo_id", F.col("type_name").alias("doc_type"), F.col("part_id").cast("int").alias("position"),
        F.concat_ws("/", F.lpad(F.col("issuer_id").cast("string"), 12, "0"), F.col("tie_break").cast("decimal(18,2)").cast("string"),
                    day_text(F.col("valid_until")), F.coalesce(ok.cast("string"), F.lit("none"))).alias("doc_id"),
        F.col("file_name").alias("file"),
        F.create_map(F.lit("有效期至"), day_text(F.col("valid_until"))).alias("fields"),
        F.create_map(F.lit("在有效期内"), ok).alias("checks"),
        F.array_compact(F.array(F.when(~ok, F.lit("证书已过期")))).alias("issues"),
        F.lit(None).cast("string").alias("error"))


def attachment_ordinals(spark, sf):
    rows = ocr.combine_attachments(readings(spark, sf))
    return rows.select(
        "todo_id", "doc_type", "ordinal", "documents", "doc_id",
        F.explode(F.map_entries("checks")).alias("c"), F.array_join("issues", "；").alias("issues")).select(
        "todo_id", "doc_type", "ordinal", "documents", "doc_id", F.col("c.key").alias("check_key"),
        F.col("c.value").alias("check_value"), "issues")


def attachment_combine(spark, sf):
    summary = ocr.ocr_summary(readings(spark, sf))
    judged = ocr.judge(summary).select("todo_id", "doc_type", "status")
    return summary.join(judged, ["todo_id", "doc_type"]).select(
        "todo_id", "doc_type", "documents", "n_yes", "n_no", "n_open", "n_issues",
        F.coalesce("status", F.lit("unchanged")).alias("status"))


def severity_combine(spark, sf):
    mats = view(spark, sf, "material")
    status = F.when(F.col("check_value"), "pass").when(~F.col("check_value"), "fail").otherwise("manual")
    items = mats.select("todo_id", "type_name", status.alias("status"), F.col("part_id").alias("ordinal"))
    return ocr.combine_severity(items, ["todo_id", "type_name"])


def confidence_distribution(spark, sf):
    lowest = view(spark, sf, "material").groupBy("todo_id").agg(F.min("confidence").alias("min_confidence"))
    return distribution(lowest)


# --- certificate texts, written from the tables ---------------------------------------
def _parties(spark, sf):
    return (view(spark, sf, "material").join(applications(spark, sf), "todo_id")
            .join(view(spark, sf, "supplier_view").select("supplier_id", "registered_capital"), "supplier_id"))


def _documents(rows: DataFrame, doc_type: Column, text: Column) -> DataFrame:
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("todo_id", "position", "part_id", "issuer_id", "tie_break")])
    return rows.select(
        key.alias("doc_id"), "todo_id", doc_type.alias("doc_type"), F.col("file_name").alias("file"), "position",
        text.alias("text"), F.lit(None).cast("string").alias("sha256"), F.lit("e").alias("engine"),
        F.lit(None).cast("string").alias("error"))


def _holders(spark, sf):
    apps = applications(spark, sf)
    cust = view(spark, sf, "supplier_view").select("supplier_id", "registered_capital")
    name = F.concat(F.lit("合成"), F.col("supplier_id").cast("string"), F.lit("号有限公司"))
    return apps.join(cust, "supplier_id").select(
        "todo_id", F.lit("").alias("name"), name.alias("full_name"), F.lit("").alias("social_credit_code"),
        F.lit("").alias("legal_person"), "registered_capital", F.lit("").alias("busi_scope"))


def _no_lines(spark):
    from ..schemas import OCR_LINE
    return spark.createDataFrame([], OCR_LINE)


def certificate_checks(spark, sf):
    """Texts of ISO, tax, authorisation, statement, transport and generic papers, read by X18."""
    rows = _parties(spark, sf)
    day = F.date_format("valid_until", "yyyy年MM月dd日")
    # an odd part belongs to the supplier, another one to the issuer
    owner = F.when(F.col("check_value").isNotNull(), F.col("supplier_id")).otherwise(F.col("issuer_id") + 1000000)
    holder = F.concat(F.lit("合成"), owner.cast("string"), F.lit("号有限公司"))
    level = F.substring(F.lit("ABCD"), (F.col("part_id") % 4 + 1).cast("int"), F.lit(1))
    place = F.col("position")
    kind = (F.when(place == 1, "iso9001").when(place == 2, "iso14001").when(place == 3, "tax_credit")
            .when(place == 4, "authorization").when(place == 5, "after_sales_statement")
            .when(place == 6, "transport_license").otherwise("tax_cert"))
    text = (
        F.when(place == 1, F.concat(F.lit("质量管理体系认证证书\n兹证明\n"), holder, F.lit("\nISO9001:2015\n有效期至："), day))
        .when(place == 2, F.concat(F.lit("某某认证中心\n环境管理体系认证证书\n获证组织："), holder, F.lit("\n注册有效日期：2001年1月5日 至 "), day))
        .when(place == 3, F.concat(F.lit("国家税务总局\n年度评价结果："), level, F.lit("\n"), F.year("valid_until").cast("string"), F.lit("年度")))
        .when(place == 4, F.concat(F.lit("授权方：某厂家有限公司\n被授权方："), holder, F.lit("\n有效期至："), day))
        .when(place == 5, F.concat(F.lit("售后服务承诺书\n日期："), day))
        .when(place == 6, F.concat(F.lit("道路运输经营许可证\n有效期至："), day))
        .otherwise(F.concat(F.lit("税务登记证\n发证日期："), day)))
    docs = _documents(rows, kind, text)
    found = extract_all(docs, _no_lines(spark), _holders(spark, sf), AS_OF, ["transport_license"])
    entry = F.explode(F.map_entries("checks")).alias("c")
    return found.select("doc_id", "doc_type", entry).select(
        "doc_id", "doc_type", F.col("c.key").alias("check_key"),
        F.coalesce(F.col("c.value").cast("string"), F.lit("unknown")).alias("check_value"))


def certificate_terms(spark, sf):
    """End of validity found in each text (X4), with its issue lines."""
    rows = _parties(spark, sf)
    day = F.date_format("valid_until", "yyyy-MM-dd")
    text = F.concat(F.lit("安全生产许可证\n上周期有效期至：1990-01-01\n证书有效期：1991-02-03 至 "), day,
                    F.lit("\n发证日期：2030年1月1日"))
    docs = _documents(rows, F.lit("product_cert"), text)
    found = extract_all(docs, _no_lines(spark), _holders(spark, sf), AS_OF, ["product_cert"])
    return found.select("doc_id", F.col("fields")["有效期至"].alias("valid_until"),
                        F.array_join("issues", "；").alias("issues"))


def licence_checks(spark, sf):
    """Licence texts of every request compared with the system record (X5, X6, X7): scopes that agree, are cut, general, unread,
    missing in the system, longer, altered or others altogether."""
    apps = applications(spark, sf)
    cust = view(spark, sf, "supplier_view")
    rows = apps.join(cust, "supplier_id")
    number = F.col("supplier_id").cast("string")
    code = F.concat(F.lit("91"), F.lpad(number, 16, "0"))
    company = F.concat(F.lit("合成"), number, F.lit("号有限公司"))
    stated = F.when(F.col("bill_type") == "P0701", F.concat(F.lit("92"), F.substring(code, 3, 16))).otherwise(code)
    wrong_name = F.concat(F.lit("另一"), number, F.lit("号有限公司"))
    scope, kind = F.col("busi_scope"), F.col("todo_id") % 8
    written = (F.when(kind == 1, "零售").when(kind == 2, "具体经营项目以公示系统为准").when(kind == 3, F.concat(scope, F.lit("；农产品零售")))
               .when(kind == 4, "餐饮住宿；棋牌娱乐").when(kind == 5, F.translate(scope, "设代术", "社贷木"))
               .when(kind == 7, F.concat(F.translate(scope, "备运", "施通"), F.lit("；安装"))).otherwise(scope))
    text = F.concat(
        F.lit("营业执照\n统一社会信用代码："), stated, F.lit("\n名 称："), F.when(
            F.col("bill_type") == "P0704", wrong_name).otherwise(company),
        F.lit("\n法定代表人：张三\n注册资本："), F.abs(F.round("registered_capital")).cast("int").cast("string"),
        F.lit("万元\n营业期限：1990-01-01 至 "), day_text(F.col("apply_date")), F.lit("\n经营范围："), written,
        F.lit("\n登记机关：市场监督管理局"))
    docs = rows.select(
        F.col("todo_id").cast("string").alias("doc_id"), "todo_id", F.lit("business_license").alias("doc_type"),
        F.lit("a.png").alias("file"), F.lit(0).alias("position"), text.alias("text"),
        F.lit(None).cast("string").alias("sha256"), F.lit("e").alias("engine"), F.lit(None).cast("string").alias("error"))
    known = rows.select("todo_id", "name", company.alias("full_name"), code.alias("social_credit_code"),
                        F.when(F.col("is_overseas"), "李四").otherwise("张三").alias("legal_person"),
                        "registered_capital", F.when(kind == 6, "").otherwise(scope).alias("busi_scope"))
    found = extract_all(docs, _no_lines(spark), known, AS_OF, ["business_license"])
    c = F.col("checks")
    return found.select("todo_id", *[
        F.coalesce(c[key].cast("string"), F.lit("none")).alias(name) for key, name in [
            ("信用代码一致", "code_ok"), ("名称一致", "name_ok"), ("法人一致", "person_ok"),
            ("注册资本一致", "capital_ok"), ("营业期限长期或有效", "term_ok"), ("经营范围一致", "scope_ok")]],
        F.coalesce(F.col("fields")["经营范围相似度"], F.lit("")).alias("likeness"), F.size("issues").alias("issues"))


# --- state, claims, audit ---------------------------------------------------------------
def resume_pending(spark, sf):
    done = log(spark, sf).filter("kind = 'purchase'").select(F.col("key").alias("todo_id"))
    return state.pending(applications(spark, sf), done).select("todo_id", "bill_type")


def latest_state(spark, sf):
    return state.latest_state(log(spark, sf), ["key"], deleted_prefix="14").select("key", "seq", "kind", "value")


def call_counts(spark, sf):
    return state.call_counts(log(spark, sf)).select(
        day_text(F.col("day")).alias("day"), F.coalesce("endpoint", F.lit("total")).alias("endpoint"), "calls")


def call_counts_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    calls = jobs.call_counts_stream(events.select(
        F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind")))
    counted = jobs.run_to_table(calls, jobs.stream_folder(spark, "call-counts"), ["day", "endpoint"])
    return counted.select(day_text(F.col("day")).alias("day"), "endpoint", "calls")


def expired_inventory(spark, sf):
    events = log(spark, sf)
    key = F.concat_ws("-", F.col("key").cast("string"), F.get_json_object("payload", "$.k"))
    rows = events.select(key.alias("todo_id"), "kind", F.col("at").cast("timestamp").alias("at"), "value")
    files = rows.filter("kind in ('view', 'click', 'purchase')").select(
        "todo_id", F.floor("value").cast("bigint").alias("length"), F.col("at").alias("modified"))
    entries = rows.filter("kind = 'signup'").groupBy("todo_id").agg(F.max("at").alias("fetched_at")).select(
        "todo_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("apply_unit"),
        F.concat(F.lit("公司"), "todo_id", F.lit("/1")).alias("title"), "fetched_at")
    results = rows.filter("kind = 'error'").select("todo_id", F.concat(F.lit("结果"), "todo_id").alias("name")).distinct()
    found = retention.expired_inventory(files, entries, results, "2024-01-31 00:00:00")
    return found.select("todo_id", "name", moment_text(F.col("cached_at")).alias("cached_at"), "age_days",
                        "file_count", "size_bytes")


def first_claims(spark, sf):
    attempts = log(spark, sf).select("key", "seq", "at")
    return state.first_claims(attempts).select("seq", "key", "accepted")


def _audit_rows(spark, sf):
    return log(spark, sf).select("key", "seq", moment_text(F.col("at")).alias("at"), "kind", "payload")


def audit_chain_head(spark, sf):
    return audit.chain_heads(_audit_rows(spark, sf), ["key"])


def audit_chain_broken(spark, sf):
    """A chain whose error payloads were edited and whose cheap purchases were deleted afterwards."""
    built = audit.build_chain(_audit_rows(spark, sf), ["key"])
    gone = log(spark, sf).filter("kind = 'purchase' and value < 5").select("seq")
    edited = built.join(gone, "seq", "left_anti").withColumn(
        "payload", F.when(F.col("kind") == "error", F.replace("payload", F.lit(" "), F.lit(""))).otherwise(F.col("payload")))
    return audit.verify_chain(edited, ["key", "segment"]).select(
        "key", "segment", "seq", "broken_link", "broken_hash")


def audit_chain_gap(spark, sf):
    """Chains of which whole segments or tails of segments were deleted, against the seals made before."""
    rows = _audit_rows(spark, sf)
    sealed = audit.seals(audit.chain_heads(rows, ["key"], 256), ["key"], 8)
    number = F.floor(F.col("seq") / 256)
    segment_gone = (F.col("key") % 5 == 0) & (number % 4 == 1)
    tail_gone = (F.col("key") % 5 == 1) & (number % 4 == 2) & (F.col("seq") % 256 >= 128)
    left = audit.chain_heads(rows.filter(~(segment_gone | tail_gone)), ["key"], 256)
    return audit.verify_seals(left, sealed, ["key"], 8).select("key", "level", "block", "problem", "lost")


def valid_results(spark, sf):
    results = applications(spark, sf).select(
        "todo_id", F.when(F.col("bill_type") == "P0704", "offline").otherwise("online").alias("ocr_mode"))
    keys = log(spark, sf).select(F.col("key").alias("todo_id"), F.when(
        F.col("kind").isin("click", "view"), "online").when(F.col("kind") == "error", "offline").alias("ocr_mode"))
    return state.valid_results(results, keys.filter("ocr_mode is not null"))


def results_in_force(spark, sf):
    """Results without a running or failed last task."""
    results = applications(spark, sf).select("todo_id", F.when(
        F.col("bill_type") == "P0701", "reject").when(F.col("bill_type") == "P0702", "manual").otherwise("draft").alias("decision"))
    tasks = log(spark, sf).select(
        F.col("key").alias("todo_id"), "seq", F.when(F.col("kind") == "error", "error").when(
            F.col("kind") == "view", "running").otherwise("done").alias("status"), F.lit(None).cast("string").alias("ocr_mode"))
    return state.has_valid_result(results, tasks, "online")


def merge_results(spark, sf):
    """Decisions of earlier requests kept where they qualify, new ones put in their place."""
    orders = table(spark, sf, "orders")
    previous = orders.select(F.col("o_orderkey").alias("todo_id"), F.concat(F.lit("old-"), "o_orderstatus").alias("decision"))
    new = orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("todo_id"), F.lit("new").alias("decision"))
    qualified = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("todo_id"))
    return state.merge_results(previous, new, qualified)


def identity_violations(spark, sf):
    orders = table(spark, sf, "orders")
    planned = applications(spark, sf).join(orders.select(
        F.col("o_orderkey").alias("todo_id"), F.col("o_orderpriority").alias("task_id"),
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 3).otherwise(4).alias("oper_code")), "todo_id")
    return state.identity_violations(planned, ["todo_id", "task_id"]).select(
        "todo_id", text_of(F.col("violations")).alias("violations"))


def fresh_tasks(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey").alias("todo_id")
    planned = orders.select(key, F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("bill_type"))
    fresh = orders.filter("o_totalprice < 450000").select(
        key, F.when(F.col("o_totalprice") > 300000, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("task_id"),
        F.col("o_orderpriority").alias("bill_type"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("work_item_status"))
    return state.verify_fresh(planned, fresh, ["task_id", "bill_type"]).select(
        "todo_id", text_of(F.col("mismatches")).alias("mismatches"))


# --- documents ------------------------------------------------------------------------
PATTERNS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
    (r'token = "[0-9A-Za-z]+"', 'token = "[SECRET]"'),
    (r"[0-9]{16}", "[NUMBER]"),
]


def mask_documents(spark, sf):
    docs = view(spark, sf, "ocr_doc").select("doc_id", "text")
    return masking.mask_patterns(docs, PATTERNS)


def extract_dedupe(spark, sf):
    """The reading of every upload (X21): its own, a shared or a cached one; some uploads have no digest."""
    digest = F.when(F.col("doc_id") % 7 != 0, F.sha2("text", 256))
    docs = landed(spark, view(spark, sf, "ocr_doc").select(
        "doc_id", F.col("lang").alias("doc_type"), "owner", digest.alias("sha256"), F.lit("e1").alias("engine")), "digests")
    old = docs.filter("owner = 'src0' and sha256 is not null").groupBy(*READING).agg(F.min("doc_id").alias("reading"))
    results = to_extract(docs, old).select("doc_id", F.col("doc_id").alias("reading"))
    return shared_results(docs, results, old).select("doc_id", "doc_type", "sha256", "reading")


def page_text(spark, sf):
    """Words of every document as boxes, put back into reading order."""
    docs = view(spark, sf, "ocr_doc")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("content", " +")).alias("word", "text")).filter("text <> ''")
    top = F.col("line") * 40.0 + F.length("text") % 7
    boxes = words.select(
        "doc_id", F.lit(1).alias("page_id"), (F.col("line") * 100000 + F.col("word")).cast("int").alias("line_no"), "text",
        (F.col("word") * 10.0).alias("x1"), top.alias("y1"), (top + 20.0).alias("y2"))
    return layout.read_pages(boxes).select("doc_id", "page_text")


def _engines(spark, sf):
    docs = view(spark, sf, "ocr_doc").join(table(spark, sf, "labels"), "doc_id")
    base = docs.select("doc_id", F.col("lang").alias("doc_type"), "owner", "size", "text", "quality", "toxic")
    long, secret = F.col("size") > 1000, F.col("text").contains("token")
    a = base.select(
        "doc_id", "doc_type", F.create_map(F.lit("owner"), "owner", F.lit("size"), F.col("size").cast("string")).alias("fields"),
        F.create_map(F.lit("long"), long, F.lit("secret"), secret).alias("checks"),
        F.array_compact(F.array(F.when(secret, F.lit("secret")))).alias("issues"))
    b = base.select(
        "doc_id", "doc_type", F.create_map(
            F.lit("owner"), F.upper(F.concat("owner", F.lit("。"))), F.lit("size"),
            F.when(F.col("quality") == 1, F.col("size").cast("string")).otherwise("")).alias("fields"),
        F.create_map(F.lit("long"), F.col("quality") == 1, F.lit("secret"), F.when(
            F.col("toxic") == 1, True)).alias("checks"), F.array().cast("array<string>").alias("issues"))
    return a, b


def engine_agreement(spark, sf):
    a, b = _engines(spark, sf)
    low = view(spark, sf, "ocr_doc").select("doc_id", (F.col("size") < 500).alias("is_low"))
    return compare.engine_agreement(a, b, low).withColumn("doc_type", F.coalesce("doc_type", F.lit("total")))


def engine_mismatches(spark, sf):
    return compare.mismatch_counts(*_engines(spark, sf))


def stratified_sample(spark, sf):
    files = view(spark, sf, "ocr_doc").select("doc_id", F.col("owner").alias("kind"), "size")
    return compare.stratified_sample(
        files, 5, "kind", [F.col("size"), F.col("doc_id")],
        [F.col("size"), F.floor(F.col("doc_id") / 65536)]).select("kind", "pick", "doc_id", "size")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "request_page": request_page, "region_routing": region_routing, "rule_set_routing": rule_set_routing,
    "rule_eval": rule_eval, "material_keyword": material_keyword, "material_first_match": material_first_match,
    "slot_conflicts": slot_conflicts, "public_gate": public_gate, "proof_texts": proof_texts,
    "title_years": title_years, "missing_materials": missing_materials, "checklist": checklist_rows,
    "decision": decision, "decision_summary": decision_summary, "opinion_text": opinion_text,
    "opinion_final": opinion_final, "registry_match": registry_match, "related_parties": related_parties,
    "name_close": name_close, "attachment_ordinals": attachment_ordinals,
    "attachment_combine": attachment_combine, "severity_combine": severity_combine,
    "confidence_distribution": confidence_distribution, "certificate_checks": certificate_checks,
    "certificate_terms": certificate_terms, "licence_checks": licence_checks, "resume_pending": resume_pending,
    "latest_state": latest_state, "call_counts": call_counts, "call_counts_stream": call_counts_stream,
    "expired_inventory": expired_inventory, "first_claims": first_claims, "audit_chain_head": audit_chain_head,
    "audit_chain_broken": audit_chain_broken, "audit_chain_gap": audit_chain_gap, "valid_results": valid_results,
    "results_in_force": results_in_force, "merge_results": merge_results,
    "identity_violations": identity_violations, "fresh_tasks": fresh_tasks, "mask_documents": mask_documents,
    "extract_dedupe": extract_dedupe, "page_text": page_text, "engine_agreement": engine_agreement,
    "engine_mismatches": engine_mismatches, "stratified_sample": stratified_sample,
}
