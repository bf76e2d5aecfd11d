"""Sources and sinks over the driver's tables: rows are written to a fresh folder that all executors share, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layout, rules
from ..operators.extract import confidence_review
from ..sources import readers, writers
from ..streaming.jobs import stream_folder
from .adapters import table
from .driver_queries import landed
from .operator_queries import query

#: Requests whose stored entry is no valid JSON.
BROKEN = 97
#: Keys whose entries are one store: a file, written by one task.
STORED = 16384


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS todo_id, 'P0' || o_custkey % 3 AS bill_type, '公司"' || o_custkey || '"{{' AS supplier, round(o_totalprice, 2) AS capital,
  l_linenumber AS place, 'f' || l_partkey || '\\n.pdf' AS file_name
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % {BROKEN} <> 0""")
def keyed_store(spark: SparkSession, sf: str) -> DataFrame:
    """Stores of one JSON object each, read in blocks; entries of several lines with quotes and brackets in their texts, some of them broken."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("parts"))
    rows = table(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    files = F.transform("parts", lambda p: F.struct(F.concat(F.lit("f"), _text(p["l_partkey"]), F.lit("\\n.pdf")).alias("fileName"), _text(p["l_linenumber"]).alias("desc")))
    name = F.concat(F.lit('公司"'), _text("o_custkey"), F.lit('"{'))
    todo = F.to_json(F.struct(F.concat(F.lit("P0"), _text(F.col("o_custkey") % 3)).alias("billType"), _text("o_orderkey").alias("todoId")))
    supplier = F.to_json(F.struct(name.alias("name"), F.round("o_totalprice", 2).alias("registered_capital")))
    detail = F.replace(F.to_json(files), F.lit("},{"), F.lit("},\n   {"))
    head = F.when(F.col("o_orderkey") % BROKEN == 0, '{\n  "todo" ').otherwise('{\n  "todo": ')
    entry = F.concat(F.lit(' "'), _text("o_orderkey"), F.lit('": '), head, todo, F.lit(',\n  "supplier": '), supplier, F.lit(',\n  "materials_detail": '), detail, F.lit("\n }"))
    bucket = F.floor(F.col("o_orderkey") / STORED).alias("bucket")
    entries = rows.select(bucket, F.col("o_orderkey").alias("place"), entry.alias("value"))
    stored = Window.partitionBy("bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the first entry of a store opens it, every other one begins after a comma, and the last one closes it; braces that are rows of their own,
    # added by a union, may be left in another file: Spark takes the union of two parts dealt by store as dealt
    opened = F.when(F.col("place") == F.min("place").over(stored), "{\n").otherwise(",")
    closed = F.when(F.col("place") == F.max("place").over(stored), "\n}").otherwise("")
    listed = entries.repartition("bucket").select("bucket", "place", F.concat(opened, "value", closed).alias("value"))
    folder = stream_folder(spark, "keyed-store")
    listed.sortWithinPartitions("bucket", "place").select("bucket", "value").write.partitionBy("bucket").text(folder)
    # requests, suppliers and files are read from the entries: the stores are parsed once
    found = landed(spark, readers.read_keyed_json(spark, f"{folder}/bucket=*"), "keyed-entries")
    kept = readers.keyed_applications(found).select("todo_id", "bill_type").join(
        readers.keyed_suppliers(found).select("todo_id", F.col("name").alias("supplier"), F.col("registered_capital").alias("capital")), "todo_id")
    materials = readers.keyed_materials(found).select("todo_id", F.col("file_desc").cast("int").alias("place"), "file_name")
    return kept.join(materials, "todo_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS todo_id, o_orderpriority AS bill_type, 'T' || o_custkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def todo_pages(spark: SparkSession, sf: str) -> DataFrame:
    """S3: list pages that overlap: a request of two pages counts once, with its newest row."""
    orders = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")

    def rows(shift: int, older: bool) -> DataFrame:
        known = orders if not older else orders.where(F.col("o_orderkey") % 5 == 0)
        return known.select(F.floor(F.col("o_orderkey") / 4000 + shift).alias("page"), F.struct(
            _text("o_orderkey").alias("id"), F.when(F.lit(older), "old").otherwise(F.col("o_orderpriority")).alias("businessBillType"),
            F.concat(F.lit("T"), _text("o_custkey")).alias("title"), F.concat(F.when(F.lit(older), "1901-01-01").otherwise(day), F.lit(" 08:00:00")).alias("applyTime")).alias("row"))

    # a page is bounded by its 4,000 keys
    pages = rows(0, False).unionByName(rows(1, True)).groupBy("page").agg(F.struct(
        F.lit(orders.count()).alias("recordsTotal"), F.collect_list("row").alias("rows")).alias("data"))
    folder = stream_folder(spark, "pages")
    pages.repartition("page").write.partitionBy("page").json(folder)
    found, counts = readers.read_todo_pages(spark, f"{folder}/page=*")
    complete = counts.where("complete").select(F.lit(True).alias("complete"))
    return found.crossJoin(F.broadcast(complete)).select("todo_id", "bill_type", "title", F.date_format("apply_time", "yyyy-MM-dd").alias("day"))


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN l_partkey % 4 > 0 THEN 'f' || l_partkey END AS f, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_partkey % 4 > 0 THEN 'f' || l_partkey END NULLS FIRST, l_returnflag) - 1 AS n FROM lineitem)
SELECT CAST(o_orderkey AS VARCHAR) AS todo_id, CAST(CASE WHEN o_orderkey % 6 > 0 THEN n ELSE -1 END AS INTEGER) AS position,
  CASE WHEN o_orderkey % 6 > 0 THEN coalesce(f, '') ELSE '' END AS file_name, CASE WHEN o_orderkey % 6 > 0 THEN l_returnflag ELSE '' END AS type_name
FROM l JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 6 > 0 OR n = 0""")
def material_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Attachment lists; an empty one is a row without a position, missing names are empty."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("f"), _text("l_partkey"))).alias("f"), "l_returnflag")))
    lists = lines.groupBy("o_orderkey").agg(held.alias("lines"))
    files = F.transform("lines", lambda x: F.struct(x["f"].alias("fileName"), x["l_returnflag"].alias("fileinfoTypeName")))
    folder = stream_folder(spark, "lists")
    lists.select(_text("o_orderkey").alias("todoId"), F.struct(F.when(F.col("o_orderkey") % 6 > 0, files).alias("supFilesBOList")).alias("data")).write.json(folder)
    return readers.read_material_lists(spark, folder).select("todo_id", F.coalesce("position", F.lit(-1)).alias("position"), "file_name", "type_name")


@query("""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS line_no, CAST(CASE WHEN n % 3 = 0 THEN 0 ELSE n % 3 END AS INTEGER) AS page_id, line, round(0.5 + (n % 50) / 100, 2) AS confidence, sha256(text) AS digest FROM l""")
def ocr_records(spark: SparkSession, sf: str) -> DataFrame:
    """Recognition records with their lines; a line without a page is on page 0."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    detail = F.transform(F.split("text", "\n"), lambda t, i: F.struct(
        F.when(i % 3 > 0, i % 3).alias("page_id"), t.alias("text"), F.round(F.lit(0.5) + (i % 50) / 100, 2).alias("confidence")))
    folder = stream_folder(spark, "records")
    docs.select(_text("doc_id").alias("doc_id"), F.col("text").alias("markdown"), detail.alias("detail")).write.json(folder)
    found, lines = readers.read_ocr(spark, folder)
    return lines.join(found.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "doc_id").select(
        "doc_id", "line_no", "page_id", F.col("text").alias("line"), "confidence", "digest")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS todo_id, CASE WHEN o_orderkey % 4 = 0 THEN 'reject' ELSE 'manual' END AS decision,
  CASE WHEN o_orderkey % 4 = 0 THEN '2026-02-02T00:00:00' ELSE '2026-01-01T00:00:00' END AS ts FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 > 0""")
def progress_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs append what they decided; the last record of a request counts, undecided ones leave none."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("todo_id"), F.concat(F.lit("公司"), _text("o_custkey")).alias("name"))
    folder, number = stream_folder(spark, "progress"), F.col("todo_id")
    writers.append_progress(rows.withColumn("decision", F.when(number % 3 > 0, "manual")), folder, "2026-01-01T00:00:00")
    writers.append_progress(rows.withColumn("decision", F.when(number % 4 == 0, "reject")), folder, "2026-02-02T00:00:00")
    return readers.read_progress(spark, folder).select("todo_id", "decision", "ts")


@query("""SELECT o_orderkey AS todo_id, 'second' AS decision, 'online' AS ocr_mode FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'first', 'offline' FROM orders WHERE o_orderkey % 3 = 0""")
def decision_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The results of one backend are replaced, those of the other stay."""
    rows, folder = table(spark, sf, "orders").select(F.col("o_orderkey").alias("todo_id")), stream_folder(spark, "decided")
    writers.write_decisions(rows.withColumn("decision", F.lit("first")), folder, "online")
    writers.write_decisions(rows.where("todo_id % 3 = 0").withColumn("decision", F.lit("first")), folder, "offline")
    writers.write_decisions(rows.where("todo_id % 2 = 0").withColumn("decision", F.lit("second")), folder, "online")
    return readers.read_results(spark, folder, "online").select("todo_id", "decision", F.lit("online").alias("ocr_mode")).unionByName(
        readers.read_results(spark, folder, "offline").select("todo_id", "decision", F.lit("offline").alias("ocr_mode")))


@query("""SELECT o_orderkey AS todo_id, '最终审批意见_' || o_orderkey || '_' || substr(CASE WHEN o_custkey % 3 = 0 THEN '甲_乙' || o_custkey ELSE repeat('长', 40) END, 1, 30) || '.txt' AS file,
  '意见' || o_orderpriority || chr(10) || '第二行' AS text FROM orders""")
def opinion_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Opinions as files; names carry no signs that file systems refuse and are cut."""
    name = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("甲/乙"), _text("o_custkey"))).otherwise(F.repeat(F.lit("长"), 40))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("todo_id"), name.alias("name"),
                                             F.concat(F.lit("意见"), "o_orderpriority", F.lit("\n第二行")).alias("final_opinion"))
    folder = stream_folder(spark, "opinions")
    writers.write_opinions(rows, folder)
    return spark.read.schema("todo_id long, file string, text string").json(f"{folder}/bucket=*")


@query("""SELECT l_orderkey AS todo_id, CAST(l_linenumber AS INTEGER) AS item, 'A' || l_linenumber AS rule_id, l_returnflag AS state FROM lineitem""")
def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The review table, replaced by a second run."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("todo_id"), F.col("l_linenumber").cast("int").alias("item"),
                                               F.concat(F.lit("A"), _text("l_linenumber")).alias("rule_id"), F.col("l_returnflag").alias("state"))
    folder = stream_folder(spark, "review")
    writers.write_review(rows.limit(10), folder)
    writers.write_review(rows, folder)
    return spark.read.parquet(folder)


# --- confidence, rule audit, layout -----------------------------------------------------------
@query("""WITH p AS (SELECT 'R' || CASE WHEN p_partkey % 10 = 0 AND p_partkey > 1 THEN p_partkey - 1 ELSE p_partkey END AS id, p_partkey % 7 = 0 AS bare, p_partkey % 11 = 0 AS odd FROM part)
SELECT id, 'duplicate id' AS fault, '' AS what FROM p GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'missing predicate', '' FROM p WHERE bare UNION ALL SELECT id, 'unknown column', 'no_such_column' FROM p WHERE odd AND NOT bare""")
def rule_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of a catalogue with a rule per part."""
    number = F.col("p_partkey")
    shared = F.when((number % 10 == 0) & (number > 1), number - 1).otherwise(number)
    catalogue = table(spark, sf, "part").select(
        F.concat(F.lit("R"), _text(shared)).alias("id"), F.lit("auto").alias("check_type"),
        F.when(number % 7 == 0, "").when(number % 11 == 0, "registered_capital > 5 and no_such_column = 'other_name'").otherwise("registered_capital > 5").alias("predicate"))
    return rules.audit_rules(catalogue, ["registered_capital"])


@query("""WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS iso, doc_id % 5 = 0 AS none, (doc_id % 7) / 10 + 0.38 AS holder, doc_id % 11 = 0 AS unscored FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN none THEN 'unknown' WHEN iso AND holder >= 0.9 THEN 'true' WHEN iso THEN 'unknown' WHEN unscored OR holder < 0.9 THEN 'unknown' ELSE 'none' END AS enough,
  CASE WHEN none THEN 'OCR置信度明细缺失，转人工核验' WHEN iso AND holder < 0.9 THEN 'ISO关键字段获证组织文字置信度较低（' || printf('%.2f', holder) || '），转人工核验'
    WHEN NOT iso AND (unscored OR holder < 0.9) THEN '存在低置信度或缺失置信度文字，转人工核验' ELSE '' END AS issues FROM d""")
def confidence_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Certificates whose lines are certain, weak, unscored or missing."""
    docs = table(spark, sf, "documents").select("doc_id")
    number, iso = F.col("doc_id"), F.col("doc_id") % 3 == 0
    checks = F.create_map(F.lit("材料类型正确"), F.lit(True), F.lit("持有人一致"), F.lit(True))
    found = docs.select(
        _text("doc_id").alias("doc_id"), F.when(iso, "iso9001").otherwise("tax_credit").alias("doc_type"), checks.alias("checks"),
        F.create_map(F.lit("获证组织"), F.concat(F.lit("合成"), _text("doc_id"), F.lit("公司"))).alias("fields"), F.array().cast("array<string>").alias("issues"))
    lines = docs.where(number % 5 != 0).select(_text("doc_id").alias("doc_id"), F.explode(F.array(
        F.struct(F.lit("质量管理体系认证证书").alias("text"), F.lit(0.99).alias("confidence")),
        F.struct(F.concat(F.lit("合 成"), _text("doc_id"), F.lit("公司")).alias("text"), ((number % 7) / 10 + 0.38).alias("confidence")),
        F.struct(F.lit("其他").alias("text"), F.when(number % 11 == 0, None).otherwise(F.lit(0.95)).alias("confidence")))).alias("l")).select("doc_id", "l.*")
    rows = confidence_review(found, lines)
    check = F.col("checks")["OCR文字置信度充足"]
    known = F.array_contains(F.map_keys("checks"), "OCR文字置信度充足")
    return rows.select("doc_id", F.when(known, F.coalesce(check.cast("string"), F.lit("unknown"))).otherwise("none").alias("enough"), F.array_join("issues", "；").alias("issues"))


def _boxes(rows: DataFrame, boxes: list[tuple[Column, float, float, float]]) -> DataFrame:
    """One box (text, x1, y1, width) per entry and row; texts that are null are left out."""
    items = F.array(*[F.struct(F.lit(i).alias("line_no"), text.alias("text"), F.lit(x).alias("x1"), F.lit(y).alias("y1"), F.lit(x + w).alias("x2"), F.lit(y + 30.0).alias("y2"))
                      for i, (text, x, y, w) in enumerate(boxes)])
    return rows.select("*", F.explode(items).alias("b")).select(*rows.columns, "b.*").where("text IS NOT NULL")


@query("""WITH k AS (SELECT o_orderkey AS n, chr(CAST(19968 + o_orderkey % 500 AS INTEGER)) AS c FROM orders)
SELECT CAST(n AS VARCHAR) AS doc_id, CASE WHEN n % 6 < 3 THEN 'front' WHEN n % 6 < 5 THEN 'back' ELSE 'unknown' END AS side,
  CASE n % 6 WHEN 0 THEN '张' || c WHEN 1 THEN '李' || c END AS name, CASE WHEN n % 6 IN (3, 4) THEN '2016.01.14-2036.01.1' || n % 5 END AS valid_until FROM k""")
def card_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Names and terms inside their label's box, in one or two boxes beside it, too far away, and missing."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"))
    kind = F.col("n") % 6
    # the character of a code point, by its escape in JSON
    sign = F.get_json_object(F.concat(F.lit('{"c":"\\u'), F.lower(F.lpad(F.hex(F.lit(19968) + F.col("n") % 500), 4, "0")), F.lit('"}')), "$.c")
    term = F.concat(F.lit("2036.01.1"), _text(F.col("n") % 5))

    def where(cases: dict[int, Column]) -> Column:
        return F.coalesce(*[F.when(kind == k, v) for k, v in cases.items()])

    boxes = _boxes(rows.select("n", _text("n").alias("doc_id"), F.lit(1).alias("page_id")), [
        (where({0: F.lit("姓名"), 1: F.concat(F.lit("姓名李"), sign), 2: F.lit("姓名"), 3: F.lit("签发机关某局"), 4: F.lit("签发机关某局"), 5: F.lit("其他材料")}), 0.0, 0.0, 80.0),
        (where({0: F.lit("张")}), 100.0, 2.0, 60.0), (where({0: sign}), 180.0, 2.0, 60.0),
        (where({2: F.lit("王五")}), 100.0, 300.0, 80.0),  # a row too far below
        (where({0: F.lit("性别男"), 1: F.lit("性别男"), 2: F.lit("性别男")}), 0.0, 80.0, 80.0),
        (where({3: F.concat(F.lit("有效期限2016.01.14-"), term), 4: F.lit("有效期限")}), 0.0, 100.0, 80.0),
        (where({4: F.lit("2016.01.14-")}), 100.0, 100.0, 100.0), (where({4: term}), 220.0, 100.0, 100.0)])
    return layout.fields_by_layout(boxes.drop("n")).select("doc_id", "side", "name", "valid_until")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS INTEGER) AS attempt FROM orders""")
def page_readings(spark: SparkSession, sf: str) -> DataFrame:
    """The best of several readings, by words, place of head and foot, confidence, the earlier of equals, and dates of the red channel."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), _text("o_orderkey").alias("doc_id"), F.lit(1).alias("page_id"))
    case = F.col("n") % 5
    head, foot = F.lit("营业执照"), F.lit("登记机关")

    def reading(attempt: int, boxes: list[tuple[Column, float, float, float]], score: Column, seal: bool = False) -> DataFrame:
        return _boxes(rows, boxes).withColumns({"attempt": F.lit(attempt), "is_seal": F.lit(seal), "page_height": F.lit(200.0), "confidence": score})

    dated, plain = F.lit("有效期至：2030年01月02日"), F.lit("有效期至：2030年01月")
    made = [
        # attempt 0: head above foot; in case 2 the page is upside down
        reading(0, [(F.when(case == 2, foot).otherwise(head), 0.0, 10.0, 90.0), (F.when(case == 2, head).otherwise(foot), 0.0, 150.0, 90.0), (plain, 0.0, 80.0, 90.0)], F.lit(0.8)),
        # attempt 1: more words in case 0, the same as before otherwise
        reading(1, [(F.when(case == 2, foot).otherwise(head), 0.0, 10.0, 90.0), (F.when(case == 2, head).otherwise(foot), 0.0, 150.0, 90.0), (plain, 0.0, 80.0, 90.0),
                    (F.when(case == 0, "注册资本"), 0.0, 110.0, 90.0)], F.when(case == 1, 0.7).otherwise(0.8)),
        # attempt 2: upright in case 2, poor otherwise
        reading(2, [(head, 0.0, 10.0, 90.0), (F.when(case == 2, foot), 0.0, 150.0, 90.0), (plain, 0.0, 80.0, 90.0)], F.lit(0.8)),
        # the red channel: a complete date in case 3
        reading(3, [(F.when(case == 3, dated).otherwise(plain), 0.0, 80.0, 90.0)], F.lit(0.9), True)]
    whole = made[0]
    for more in made[1:]:
        whole = whole.unionByName(more)
    return layout.best_reading(whole.drop("n")).select("doc_id", "attempt")
