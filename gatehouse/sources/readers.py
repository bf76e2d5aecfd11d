"""Landed files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import fixed
from ..functions.hashing import content_digest
from ..functions.text import blank
from ..operators.rules import load_catalogue, rules_table
from ..operators.state import for_backend
from . import blocks


def read_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rule catalogue as a (small) table."""
    return rules_table(spark, load_catalogue(path))


ENTRY = (
    "struct<todo:struct<todoId:string,billType:string,billName:string,applyUnitName:string,businessBillId:string,"
    "procInstId:string,actInstId:string,actInstName:string,taskId:string,title:string>,"
    f"supplier:struct<{schemas.SUPPLIER.replace(' double', ':double').replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(' array', ':array').replace(', ', ',')}>,"
    "materials_detail:array<struct<fileName:string,typeName:string,desc:string,types:array<string>>>,"
    "certifications:array<string>,fetched_at:string>"
)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON files that may be cut anywhere for reading: file (two hashes of its path), block, at (order inside the block), value, and of
    the block the depth of brackets before it (`base`) and the number of top-level entries that begin before it (`first`).

    A JSON string holds no line end, so every line can be judged by itself. What a block opens and closes is counted as it is read, and so are
    its lines that may begin an entry, by their depth: one row per block meets the totals of earlier blocks, and tells which of its lines do.
    """
    path_of = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        F.xxhash64(path_of).alias("file"), F.xxhash64(F.lit(1), path_of).alias("check"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("__cut"))
    # nothing comes before the block of a file that is read whole
    totals = lines.where("__cut").select(*blocks.BLOCK, "value").mapInArrow(blocks.block_totals, blocks.TOTALS)
    earlier = Window.partitionBy("file", "check").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    depths = totals.select(*blocks.BLOCK, "named", F.coalesce(F.sum("total").over(earlier), zero).alias("base"))
    begun = depths.withColumn("__starts", F.coalesce(F.try_element_at("named", 1 - F.col("base")), zero))
    known = begun.select(*blocks.BLOCK, F.col("base").alias("__base"), F.coalesce(F.sum("__starts").over(earlier), zero).alias("__first"))
    # a row per block that a task reads; the lines stay where they are read, in order
    return lines.join(F.broadcast(known), blocks.BLOCK, "left").select(
        *blocks.BLOCK, "at", "value", F.coalesce("__base", zero).alias("base"), F.coalesce("__first", zero).alias("first"))


def _unlisted(text: Column) -> Column:
    """The text without the comma before it or the comma behind it, white space aside."""
    space = F.lit(" \t\n\x0b\f\r")
    left = F.ltrim(text, space)
    text = F.when(left.startswith(","), left.substr(F.lit(2), F.length(left))).otherwise(text)
    right = F.rtrim(text, space)
    return F.when(right.endswith(","), right.substr(F.lit(1), F.length(right) - 1)).otherwise(text)


def read_keyed_json(spark: SparkSession, path: str, entry: str = ENTRY) -> DataFrame:
    """Files that hold one JSON object keyed by request: (todo_id, entry).

    Where each entry begins on a line of its own, as such stores are written, a file is read by as many tasks as it has blocks; an
    object on a single line is one row. An entry that is no valid JSON is skipped, and the others are read.
    """
    pieces = _numbered_lines(spark, path).mapInArrow(blocks.entry_pieces, blocks.PIECES)
    texts = pieces.groupBy("file", "check", "entry").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    joined = texts.select("entry", F.concat_ws("\n", F.transform("lines", lambda line: line["value"])).alias("value"))
    written = F.concat(F.lit("{"), _unlisted(F.col("value")), F.lit("}"))
    objects = joined.select(F.from_json(F.when(F.col("entry") > 0, written).otherwise(F.col("value")), f"map<string,{entry}>").alias("object"))
    # an inner explode would have its object looked at before, and the text parsed twice
    return objects.select(F.explode_outer("object").alias("todo_id", "entry")).where(F.col("entry").isNotNull())


def keyed_applications(entries: DataFrame) -> DataFrame:
    t = "entry.todo."
    return entries.select(
        "todo_id", F.col(t + "billType").alias("bill_type"), F.col(t + "billName").alias("bill_name"),
        F.col(t + "applyUnitName").alias("apply_unit"), F.col(t + "businessBillId").alias("business_bill_id"),
        F.col(t + "procInstId").alias("proc_inst_id"), F.col(t + "actInstId").alias("act_inst_id"),
        F.col(t + "actInstName").alias("act_inst_name"), F.col(t + "taskId").alias("task_id"),
        F.col(t + "title").alias("title"))


def keyed_suppliers(entries: DataFrame) -> DataFrame:
    names = [c for c in entries.select("entry.supplier.*").columns if c != "todo_id"]
    return entries.select("todo_id", *[F.col(f"entry.supplier.{c}").alias(c) for c in names])


def keyed_materials(entries: DataFrame) -> DataFrame:
    rows = entries.select("todo_id", F.posexplode("entry.materials_detail").alias("position", "m"))
    return schemas.conform(rows.select(
        "todo_id", "position", F.col("m.fileName").alias("file_name"), F.col("m.typeName").alias("type_name"),
        F.col("m.desc").alias("file_desc"), F.col("m.types").alias("types")), schemas.MATERIAL)


PAGE_SCHEMA = (
    "data struct<recordsTotal:bigint,rows:array<struct<id:string,todoId:string,businessBillType:string,"
    "businessBillName:string,applyUnitName:string,businessBillId:string,procInstId:string,actInstId:string,"
    "actInstName:string,taskId:string,title:string,applyTime:string>>>"
)


def read_todo_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: (applications, reconciliation of stated total and landed rows)."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path)
    rows = pages.select("data.recordsTotal", F.explode_outer("data.rows").alias("r"))
    key = F.coalesce("r.id", "r.todoId")
    apps = rows.filter(key.isNotNull()).select(
        key.alias("todo_id"), F.col("r.businessBillType").alias("bill_type"),
        F.col("r.businessBillName").alias("bill_name"), F.col("r.applyUnitName").alias("apply_unit"),
        F.col("r.businessBillId").alias("business_bill_id"), F.col("r.procInstId").alias("proc_inst_id"),
        F.col("r.actInstId").alias("act_inst_id"), F.col("r.actInstName").alias("act_inst_name"),
        F.col("r.taskId").alias("task_id"), F.col("r.title").alias("title"),
        F.try_to_timestamp("r.applyTime").alias("apply_time"))
    # of several rows of one request the newest counts; equal times are settled by the other columns
    names = [c for c in apps.columns if c != "todo_id"]
    apps = apps.groupBy("todo_id").agg(F.max(F.struct("apply_time", *[c for c in names if c != "apply_time"])).alias("v")).select(
        "todo_id", *[F.col(f"v.{c}").alias(c) for c in names])
    counts = rows.agg(F.max("recordsTotal").alias("stated"), F.count(key).alias("landed"),
                      F.count_distinct(key).alias("distinct_requests"))
    return apps, counts.withColumn("complete", F.col("stated") == F.col("distinct_requests"))


LIST_SCHEMA = (
    "todoId string, data struct<supFilesBOList:array<struct<fileName:string,fileinfoTypeName:string,"
    "fileDesc:string,fileSumm:string,fileTitle:string,remark:string,uploadId:string,fileSize:bigint>>>"
)


def read_material_lists(spark: SparkSession, path: str) -> DataFrame:
    """Attachment lists, one row per upload, in upload order; an empty list is one row without a position."""
    lists = spark.read.schema(LIST_SCHEMA).json(path)
    rows = lists.select(F.col("todoId").alias("todo_id"), F.posexplode_outer("data.supFilesBOList").alias("position", "f"))
    return rows.select(
        "todo_id", "position", F.col("f.uploadId").alias("upload_id"), blank(F.col("f.fileName")).alias("file_name"),
        blank(F.col("f.fileinfoTypeName")).alias("type_name"), blank(F.col("f.fileDesc")).alias("file_desc"),
        blank(F.col("f.fileSumm")).alias("file_summ"), F.col("f.fileTitle").alias("file_title"),
        F.col("f.remark").alias("remark"), F.col("f.fileSize").alias("file_size"),
        F.lit(None).cast("array<string>").alias("types"))


def scan_materials(spark: SparkSession, root: str) -> DataFrame:
    """Stored material files with owner, name, size and digest; the content itself is not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return (files.filter(extension.isin(fixed.FILE_EXTENSIONS))
            .select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("todo_id"),
                    F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path", "length",
                    F.col("modificationTime").alias("modified"), content_digest(F.col("content")).alias("sha256")))


OCR_RECORD = (
    "doc_id string, todo_id string, file string, doc_type string, position int, markdown string, sha256 string, "
    "engine string, error string, "
    "detail array<struct<page_id:int,text:string,position:array<array<double>>,confidence:double>>"
)


def read_ocr(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, lines)."""
    records = spark.read.schema(OCR_RECORD).json(path)
    docs = records.select("doc_id", "todo_id", "doc_type", "file", F.coalesce("position", F.lit(0)).alias("position"),
                          F.col("markdown").alias("text"), "sha256", "engine", "error")
    lines = records.select("doc_id", F.posexplode("detail").alias("line_no", "d")).select(
        "doc_id", F.coalesce("d.page_id", F.lit(0)).alias("page_id"), "line_no", "d.text", "d.position", "d.confidence")
    return docs, lines


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Last progress record per request; malformed lines are skipped. Of equal times the later line counts,
    by file, block and place in the block."""
    lines = spark.read.text(path).select("value", F.struct(
        "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at"))
    record = F.from_json("value", schemas.PROGRESS, {"mode": "PERMISSIVE"})
    rows = lines.select(record.alias("r"), "at").filter("coalesce(r.todoId, '') <> ''")
    latest = rows.groupBy(F.col("r.todoId").alias("todo_id")).agg(
        F.max_by(F.struct("r.name", "r.decision", "r.ts"), F.struct(F.col("r.ts"), F.col("at"))).alias("v"))
    return latest.select("todo_id", "v.name", "v.decision", F.col("v.ts").cast("string").alias("ts"))


def unwrapped(response: Column) -> Column:
    """what a service envelope holds: `result`, else `data`, as JSON text; `{}` if that is no object."""
    body = F.try_parse_json(response)

    def member(name: str) -> Column:
        # an envelope that names the member, be it null, does not fall back to the other one
        return F.when(F.array_contains(F.json_object_keys(response), name), F.coalesce(F.try_variant_get(body, f"$.{name}", "variant").cast("string"), F.lit("null")))

    value = F.coalesce(member("result"), member("data"), F.lit("{}"))
    return F.when(F.trim(value).startswith("{"), value).otherwise("{}")


REGISTRY_PARTS = ["baseinfo", "verify_ic", "holders", "human_holding"]
STATEMENTS = ["balance_sheet", "income_statement", "cash_flow"]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Landed registry answers as the registry table: JSON lines of key, part, seq and response (JSON text)."""
    answers = spark.read.schema("key string, part string, seq bigint, response string").json(path)
    return registry_of(answers.filter("key is not null"))


def registry_of(answers: DataFrame) -> DataFrame:
    """Registry records from answers (key, part, seq, response); the last answer of each key and part counts."""
    parts = [*REGISTRY_PARTS, *STATEMENTS]
    last = answers.filter(F.col("part").isin(parts)).groupBy("key").agg(*[
        F.max_by(F.when(F.col("part") == part, F.col("response")), F.when(F.col("part") == part, F.col("seq"))).alias(part) for part in parts])
    info, verified, holding = (unwrapped(F.col(p)) for p in ("baseinfo", "verify_ic", "human_holding"))

    def field(name: str) -> Column:
        return F.get_json_object(info, f"$.{name}")

    holders = F.from_json(F.get_json_object("holders", "$.result"), "array<struct<`股东名称`:string,`持股比例`:string>>")
    controllers = F.from_json(F.get_json_object(holding, "$.实际控制人信息"), "array<struct<`实际控制人名称`:string>>")
    valid = [F.concat(F.lit(f'"{p}":'), F.when(F.try_parse_json(F.col(p)).isNotNull(), F.col(p)).otherwise("{}")) for p in STATEMENTS]
    return last.select(
        "key", field("企业名称").alias("company_name"), field("统一社会信用代码").alias("credit_code"), field("法定代表人").alias("legal_person"),
        field("注册资本").alias("registered_capital"), field("登记状态").alias("reg_status"),
        F.get_json_object(verified, "$.核验结果是否一致").alias("accuracy"),
        F.transform(F.coalesce(holders, F.array().cast("array<struct<`股东名称`:string,`持股比例`:string>>")), lambda h: F.struct(
            h["股东名称"].alias("name"), h["持股比例"].alias("share"))).alias("shareholders"),
        F.transform(F.coalesce(controllers, F.array().cast("array<struct<`实际控制人名称`:string>>")), lambda c: c["实际控制人名称"]).alias("controllers"),
        F.concat(F.lit("{"), F.concat_ws(",", *valid), F.lit("}")).alias("financial"))


def _partition_exists(spark: SparkSession, path: str, mode: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/ocr_mode={mode}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_results(spark: SparkSession, path: str, mode: str, legacy: DataFrame | None = None) -> DataFrame:
    """Results of one backend; the legacy ones stand in for a missing online partition."""
    if not _partition_exists(spark, path, mode) and mode == "online" and legacy is not None:
        return legacy.withColumn("ocr_mode", F.lit("online"))
    return for_backend(spark.read.parquet(path), mode)
