"""State, audit, retention, comparison, layout, sources, sinks and streams."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gatehouse import schemas
from gatehouse.functions import dates, numbers, ordering
from gatehouse.functions import text as tx
from gatehouse.operators import audit, compare, layout, masking, registry, retention, state
from gatehouse.operators.extract import confidence_distribution, to_extract
from gatehouse.sources import readers, writers
from gatehouse.streaming import jobs

from .helpers import frame


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_scalars(spark):
    def numeral(t):
        return numbers.numeral_value(F.lit(t))

    r = one(spark, a=numeral("贰仟"), b=numeral("壹佰贰拾"), c=numeral("壹亿陆仟陆佰伍拾伍万"), d=numeral("十"),
            e=numbers.licence_capital(F.lit("注册资本 人民币元 壹亿陆仟陆佰伍拾伍万元整")), f=numbers.licence_capital(F.lit("注册资本：人民币1,100万元")),
            g=numbers.registry_capital(F.lit("2000万元")), h=numbers.registry_capital(F.lit("500万美元")), i=numbers.registry_capital(F.lit("12.5")),
            j=numbers.signed_number(F.lit("(1,234.50)")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == (2000, 120, 166550000, 10, 16655.0, 1100.0, 2000.0, None, 12.5, -1234.5)
    values = [0.0, 500.0, 499.99, 1863.84, 0.5, 99999.94, 100000.0, 999999.0, 1234567.0, -532.11, 12.0, 1e7, 0.001234]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", numbers.short_number(F.col("v")).alias("t"))
    for row in df.collect():
        assert row.t == f"{row.v:g}", (row.v, row.t)
    d = one(spark, a=dates.valid_until(F.lit("证书有效期：2023年05月14日至2026年05月13日"))["date"].cast("string"), b=dates.valid_until(F.lit("长期"))["longterm"],
            c=dates.canonical_term(F.lit("2016.01.14-203601.14")), d=dates.canonical_term(F.lit("2018.12.26-长期")), e=dates.is_term(F.lit("2011.0111-2031.01.11")),
            f=F.array_join(F.transform(dates.find_dates(F.lit("2024年2月30日 2024-02-29 2024/3/1x")), lambda x: x.cast("string")), ","),
            g=dates.parse_iso(F.lit("2026-01-02T03:04:05Z")).cast("string"))
    assert (d.a, d.b, d.c, d.d, d.e, d.f, d.g) == ("2026-05-13", True, "2016.01.14-2036.01.14", "2018.12.26-长期", True, "2024-02-29,2024-03-01",
                                                  "2026-01-02 03:04:05")
    s = one(spark, a=tx.name_close(F.lit("陈昊"), F.lit("陈 吴")), b=tx.name_close(F.lit("陈昊"), F.lit("陈昊")), c=tx.html_escape(F.lit("<a '\">&")),
            d=tx.safe_name(F.lit('a/b:c*"d'), 5), e=tx.compare_form(F.lit("Ａ b（c）。")), f=tx.file_stem(F.lit("x/12_环境.a.png")))
    assert (s.a, s.b, s.c, s.d, s.f) == (True, False, "&lt;a &#x27;&quot;&gt;&amp;", "a_b_c", "12_环境.a")


def test_spot_ordinal_equals_window(spark, monkeypatch):
    """Crowded places are cut by names with long common beginnings, outliers, repeats and nulls."""
    monkeypatch.setattr(ordering, "CROWDED", 20)
    monkeypatch.setattr(ordering, "BOUNDS", 60)
    names = [f"2026/documents/scan-{i:05d}.png" for i in range(0, 3000, 7)] + ["a", "2026/documents/scan-", "2027/x", "2026/documents/scan-00007.png", "漢字", ""]
    rows = [("k", 0, n) for n in names] + [("k", 0, None), ("k", 1, "z"), ("k", 600, "y"), ("k", None, "b")] + [("j", i % 3, f"n{i}") for i in range(50)] + [(None, 0, "q")] * 2
    df = spark.createDataFrame(rows, "k string, at int, name string")
    got = ordering.spot_ordinal(df, ["k"], F.col("at"), "name", [F.floor(F.col("__place") / 512), F.col("__place")], "n", "t")
    ranked = Window.partitionBy("k").orderBy("at", "name")
    want = df.select("k", "at", "name", F.row_number().over(ranked).alias("n"), F.count("*").over(Window.partitionBy("k")).alias("t"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    spots = df.groupBy("k", "at", "name").count()
    cut, marks = ordering.name_cells(spots, ["k"], [F.col("at")], "name")
    assert max(r.n for r in cut.groupBy("k", *marks).agg(F.count("*").alias("n")).collect()) <= 60


def test_split_ordinal_equals_window(spark):
    rows = [("hot" if i % 3 else None, (i * 7919) % 100, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = ordering.split_ordinal(df, ["k"], [F.col("v"), F.col("id")], [F.col("v"), F.floor(F.col("id") / 64)], "n", total="t")
    expected = {}
    for key in ("hot", None):
        part = sorted((v, i) for k, v, i in rows if k == key)
        expected.update({i: (n, len(part)) for n, (_, i) in enumerate(part, 1)})
    assert {r.id: (r.n, r.t) for r in got.collect()} == expected
    text = ordering.joined_text(df.filter("id < 40"), ["k"], F.col("id"), F.col("id").cast("string"), F.floor(F.col("id") / 8), ",")
    assert {r.k: r.text for r in text.collect()} == {
        "hot": ",".join(str(i) for i in range(40) if i % 3), None: ",".join(str(i) for i in range(40) if not i % 3)}


def test_audit_chain(spark):
    events = spark.createDataFrame([("a", i, f"t{i}", "k", json.dumps({"n": i})) for i in range(1, 7)] + [("b", 7, "t", "k", "{}")],
                                   "key string, seq bigint, at string, kind string, payload string")
    built = audit.build_chain(events, ["key"], size=4).cache()
    previous = "0" * 64
    for r in built.filter("key = 'a' and segment = 0").orderBy("seq").collect():
        assert r.previous == previous
        previous = hashlib.sha256((previous + r.at + r.kind + r.payload).encode()).hexdigest()
        assert r.hash == previous
    heads = {(r.key, r.segment): (r.events, r.head) for r in audit.chain_heads(events, ["key"], size=4).collect()}
    assert heads["a", 0] == (3, previous) and set(heads) == {("a", 0), ("a", 1), ("b", 1)}
    assert audit.verify_chain(built, ["key", "segment"]).count() == 0
    edited = built.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload"))).filter("seq <> 5")
    assert {(r.seq, r.broken_link, r.broken_hash) for r in audit.verify_chain(edited, ["key", "segment"]).collect()} == {
        (2, False, True), (6, True, False)}
    claims = spark.createDataFrame([("x", 1, 5), ("x", 2, 3), ("y", 3, 1)], "key string, seq int, at int")
    assert {r.seq: r.accepted for r in state.first_claims(claims).collect()} == {1: False, 2: True, 3: True}


def test_writes_and_masks(spark):
    good = ("1", "b", "t", "p", "a", "P0702")
    columns = "todo_id string, business_bill_id string, task_id string, proc_inst_id string, act_inst_id string, bill_type string"
    planned = spark.createDataFrame([(str(i), *good[1:]) for i in range(6)], columns)
    fresh = spark.createDataFrame([("0", *good[1:], 0), ("1", "other", *good[2:], 0), ("2", "b", "other", *good[3:], 0),
                                   ("3", *good[1:5], "P0701", 0), ("4", *good[1:], 1)], columns + ", work_item_status int")
    got = {r.todo_id: r.mismatches for r in state.verify_fresh(planned, fresh).collect()}
    assert got == {"0": [], "1": ["business_bill_id"], "2": ["task_id"], "3": ["bill_type"], "4": ["work_item_status"], "5": ["todo_id"]}
    ids = spark.createDataFrame([("1", "x y", "P0702", 3), ("2", "ok-1", "P9", 5), ("3", "ok", "P0704", 2)],
                                "todo_id string, task_id string, bill_type string, oper_code int")
    assert {r.todo_id: r.violations for r in state.identity_violations(ids, ["todo_id", "task_id"]).collect()} == {
        "1": ["task_id"], "2": ["bill_type", "oper_code"]}
    files = spark.createDataFrame([("1", "a", b"x"), ("1", "b", b"y")], "todo_id string, file string, content binary")
    records = spark.createDataFrame([("1", "a", hashlib.sha256(b"x").hexdigest()), ("1", "b", "no")], "todo_id string, file string, masked_sha256 string")
    assert [r.file for r in audit.verify_masked(files, records).collect()] == ["a"]
    docs = frame(spark, schemas.OCR_DOC, [
        {"doc_id": "1", "doc_type": "legal_person_id", "text": "<!-- 住址 x -->姓名 张三\n性别 男\n有效期限 2020.01.01-2030.01.01\n公民身份号码 1"},
        {"doc_id": "2", "doc_type": "tax_cert", "text": "原文"}])
    assert {r.doc_id: r.text for r in masking.mask_documents(docs).collect()} == {"1": "姓名 张三 有效期限 2020.01.01-2030.01.01", "2": "原文"}


def test_retention(spark):
    files = frame(spark, schemas.FILE, [
        {"todo_id": "old-1", "length": 7, "modified": datetime(2026, 8, 27)}, {"todo_id": "old-1", "length": 6, "modified": datetime(2026, 9, 1)},
        {"todo_id": "new", "length": 1, "modified": datetime(2026, 9, 15)}, {"todo_id": "dir", "modified": datetime(2026, 8, 1)}])
    entries = spark.createDataFrame([("old-1", "", None, "旧供应商/9", datetime(2026, 8, 20)), ("undated", "n", None, None, None)],
                                    "todo_id string, name string, apply_unit string, title string, fetched_at timestamp")
    results = spark.createDataFrame([("old-1", "离线结果供应商")], "todo_id string, name string")
    got = retention.expired_inventory(files, entries, results, "2026-09-16 00:00:00")
    rows = [(r.todo_id, r.name, r.age_days, r.file_count, r.size_bytes) for r in retention.in_order(got).collect()]
    assert rows == [("dir", "未知供应商（dir）", 46, 0, 0), ("old-1", "离线结果供应商", 15, 2, 13)]
    with pytest.raises(ValueError):
        retention.expired_inventory(files, entries, results, "2026-09-16", days=-1)
    kept = retention.purge({"files": files}, got)["files"]
    assert {r.todo_id for r in kept.collect()} == {"new"}
    lines = spark.createDataFrame([('{"todoId":"old-1"}',), ('{"todoId":"keep-2"}',), ("not-json",)], "value string")
    assert [r.value for r in retention.purge_progress(lines, got).collect()] == ['{"todoId":"keep-2"}', "not-json"]
    cache = spark.createDataFrame([("离线结果供应商/base",), ("保留/base",)], "key string")
    assert [r.key for r in retention.purge_registry_cache(cache, got).collect()] == ["保留/base"]


def test_keyed_state(spark):
    log = frame(spark, schemas.TASK_STATUS, [
        {"todo_id": "1", "seq": 1, "status": "running"}, {"todo_id": "1", "seq": 2, "status": "done"},
        {"todo_id": "2", "seq": 3, "status": "running", "ocr_mode": "offline", "updated_at": datetime(2026, 1, 1)},
        {"todo_id": "3", "seq": 4, "status": "error", "ocr_mode": "online"}])
    assert {r.todo_id: r.status for r in state.task_overview(log, "online").collect()} == {"1": "done", "3": "error"}
    results = spark.createDataFrame([("1", "skip", "online"), ("3", "reject", "online"), ("4", None, "online"), ("5", "manual", "offline")],
                                    "todo_id string, decision string, ocr_mode string")
    assert {r.todo_id for r in state.has_valid_result(results, log, "online").collect()} == {"1", "5"}
    ocr = spark.createDataFrame([("1", "online"), ("5", "online")], "todo_id string, ocr_mode string")
    assert {r.todo_id for r in state.valid_results(results, ocr).collect()} == {"1"}
    new = spark.createDataFrame([("1", "manual")], "todo_id string, decision string")
    merged = {r.todo_id: r.decision for r in state.merge_results(results.select("todo_id", "decision"), new, ocr).collect()}
    assert merged == {"1": "manual", "5": "manual"}
    stale = {r.todo_id: r.status for r in jobs.mark_stale(jobs.latest_tasks(log), "2026-01-01 01:00:00", 30).collect()}
    assert stale == {"1": "done", "2": "error", "3": "error"}
    calls = spark.createDataFrame([("2026-01-01 01:00:00", "a"), ("2026-01-01 02:00:00", "b"), ("2026-01-02 01:00:00", "a")], "at string, kind string")
    counts = {(str(r.day), r.endpoint): r.calls for r in state.call_counts(calls.withColumn("at", F.to_timestamp("at"))).collect()}
    assert counts["2026-01-01", None] == 2 and counts["2026-01-01", "b"] == 1 and len(counts) == 5
    live = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-01-02 12:00:00"), ("c", None)], "key string, at string")
    assert [r.key for r in state.live_cache(live.withColumn("at", F.to_timestamp("at")), "2026-01-02 13:00:00").collect()] == ["b"]


def test_comparison(spark):
    schema = "doc_id string, doc_type string, fields map<string,string>, checks map<string,boolean>, issues array<string>"
    a = spark.createDataFrame([("1", "tax", {"级别": "A", "年": ""}, {"c": True, "d": None}, []), ("2", "iso", {"x": "1"}, {"c": False}, ["i"])], schema)
    b = spark.createDataFrame([("1", "tax", {"级别": "ａ a", "年": "1"}, {"c": True, "d": None}, []), ("2", "iso", {"x": "(1)"}, {"c": True}, [])], schema)
    low = spark.createDataFrame([("1", False)], "doc_id string, is_low boolean")
    got = {r.doc_type: r.asDict() for r in compare.engine_agreement(a, b, low).collect()}
    assert (got[None]["documents"], got[None]["comparable_fields"], got[None]["matching_fields"]) == (2, 2, 1)
    assert (got[None]["comparable_checks"], got[None]["matching_checks"], got[None]["low_confidence_documents"]) == (3, 2, 1)
    assert (got["iso"]["same_pass_decision"], got["iso"]["auto_pass_b"], got["tax"]["same_pass_decision"]) == (0, 1, 1)
    assert {r.item for r in compare.mismatch_counts(a, b).collect()} == {"tax:级别", "iso:c"}
    minimum = spark.createDataFrame([(v,) for v in (0.5, 0.72051, 0.85, 0.95)], "min_confidence double")
    row = confidence_distribution(minimum).first()
    assert (row.document_minimum_median, row.documents_below_0_70, row.documents_below_0_80, row.documents_below_0_90) == (0.85, 1, 2, 3)
    files = spark.createDataFrame([(i, "k" if i < 11 else "m", i % 5) for i in range(14)], "id int, kind string, size int")
    picks = compare.stratified_sample(files, 2, "kind", [F.col("size"), F.col("id")], [F.col("size"), F.floor(F.col("id") / 4)])
    assert sorted((r.kind, r.pick, r.id) for r in picks.collect()) == [("k", 1, 0), ("k", 2, 2), ("m", 1, 11), ("m", 2, 12)]
    docs = spark.createDataFrame([("1", "a", "x", "e"), ("2", "a", "x", "e"), ("3", "a", "y", "e"), ("4", "a", "z", "f")],
                                 "doc_id string, doc_type string, sha256 string, engine string")
    cache = spark.createDataFrame([("y", "e"), ("z", "e")], "sha256 string, engine string")
    assert {r.doc_id for r in to_extract(docs, cache).collect()} == {"1", "4"}
    asked = spark.createDataFrame([("1", "c1", "n1"), ("2", "", "n2"), ("3", "zz", "zz")], "todo_id string, code string, name string")
    known = spark.createDataFrame([("c1", 1), ("n1", 2), ("n2", 3)], "key string, v int")
    assert {r.todo_id: (r.match_rank, r.v) for r in registry.match_registry(asked, known, ["code", "name"]).collect()} == {"1": (0, 1), "2": (1, 3)}


def box(doc, n, text, x, y, w=60, h=20, **extra):
    return {"doc_id": doc, "page_id": 1, "line_no": n, "text": text, "confidence": .99,
            "position": [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]], **extra}


def test_layout(spark):
    rows = [box("a", 0, "500万元", 110, 50), box("a", 1, "营业执照", 0, 0), box("a", 2, "注册资本", 0, 51), box("a", 3, "尾行", 0, 400)]
    text = layout.page_reading(layout.reading_order(layout.with_bounds(frame(spark, schemas.OCR_LINE, rows))))
    assert text.first().page_text == "营业执照\n注册资本 500万元\n尾行"
    cards = [
        box("front", 0, "姓名", 0, 0), box("front", 1, "张", 100, 2), box("front", 2, "三", 180, 2), box("front", 3, "性别男", 0, 80), box("front", 4, "民族汉", 0, 160),
        box("back", 0, "签发机关某局", 0, 0), box("back", 1, "有效期限", 0, 100), box("back", 2, "2016.01.14-", 100, 100), box("back", 3, "203601.14", 220, 100),
        box("fuzzy", 0, "城名李四", 0, 0), box("fuzzy", 1, "性别男", 0, 80), box("fuzzy", 2, "民族汉", 0, 160),
        box("seal", 0, "签发机关", 0, 0), box("seal", 1, "X效期限20160114-20360114", 0, 100),
        box("none", 0, "其他材料", 0, 0),
        box("placed", 0, "#王五", 0, 0), box("placed", 1, "出生1990年1月2日", 0, 200), box("placed", 2, "11010119900102123X", 200, 400),
    ]
    got = {r.doc_id: (r.side, r.name, r.valid_until) for r in layout.fields_by_layout(layout.with_bounds(frame(spark, schemas.OCR_LINE, cards))).collect()}
    assert got == {"front": ("front", "张三", None), "back": ("back", None, "2016.01.14-2036.01.14"), "fuzzy": ("front", "李四", None),
                   "seal": ("back", None, "2016.01.14-2036.01.14"), "none": ("unknown", None, None), "placed": ("front", "王五", None)}
    readings = [dict(box("l", i, t, 10, y, w=20, h=80), attempt=0, is_seal=False, page_height=240.0) for i, (t, y) in enumerate([("营业执照", 20), ("统一社会信用代码", 20)])]
    readings += [dict(box("l", i, t, 10, y), attempt=1, is_seal=False, page_height=120.0) for i, (t, y) in enumerate([("营业执照", 85), ("登记机关", 5)])]
    readings += [dict(box("l", i, t, 10, y), attempt=2, is_seal=False, page_height=120.0) for i, (t, y) in enumerate(
        [("营业执照", 5), ("统一社会信用代码", 30), ("法定代表人", 55), ("登记机关", 85)])]
    df = layout.with_bounds(frame(spark, schemas.OCR_LINE + ", attempt int, is_seal boolean, page_height double", readings))
    assert layout.best_reading(df).first().attempt == 2


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path
    (root / "pages").mkdir()
    (root / "pages" / "1.json").write_text(json.dumps({"data": {"recordsTotal": 2, "rows": [
        {"id": "1", "title": "甲/1", "applyTime": "2026-01-01 00:00:00"}, {"todoId": "2"}, {"id": "1"}]}}, indent=1), encoding="utf-8")
    apps, counts = readers.read_todo_pages(spark, str(root / "pages"))
    assert {r.todo_id for r in apps.collect()} == {"1", "2"}
    assert counts.first().asDict() == {"stated": 2, "landed": 3, "distinct_requests": 2, "complete": True}
    (root / "lists").mkdir()
    (root / "lists" / "a.json").write_text(json.dumps({"todoId": "1", "data": {"supFilesBOList": [{"fileName": "a"}, {"fileName": "b"}]}}) + "\n"
                                           + json.dumps({"todoId": "2", "data": {}}), encoding="utf-8")
    assert [(r.position, r.file_name) for r in readers.read_material_lists(spark, str(root / "lists")).orderBy("position").collect()] == [(None, ""), (0, "a"), (1, "b")]
    (root / "cache.json").write_text(json.dumps({"7": {"todo": {"billType": "P0701", "title": "乙/2"}, "supplier": {"name": "乙", "registered_capital": 5.0,
        "certifications": ["ISO9001"]}, "materials_detail": [{"fileName": "x", "types": ["tax_cert"]}]}}), encoding="utf-8")
    entries = readers.read_keyed_json(spark, str(root / "cache.json"))
    assert readers.keyed_applications(entries).first().bill_type == "P0701"
    assert readers.keyed_suppliers(entries).first().registered_capital == 5.0
    assert readers.keyed_materials(entries).first().types == ["tax_cert"]
    (root / "files" / "9").mkdir(parents=True)
    (root / "files" / "9" / "a.PDF").write_bytes(b"fixture")
    (root / "files" / "9" / "a.txt").write_bytes(b"no")
    found = readers.scan_materials(spark, str(root / "files")).collect()
    assert [(r.todo_id, r.file, r.length, r.sha256) for r in found] == [("9", "a.PDF", 7, hashlib.sha256(b"fixture").hexdigest())]
    (root / "ocr.json").write_text(json.dumps({"doc_id": "d", "markdown": "t", "detail": [{"page_id": 2, "text": "x", "confidence": .5}]}))
    docs, lines = readers.read_ocr(spark, str(root / "ocr.json"))
    assert docs.first().text == "t" and lines.first().page_id == 2
    assert readers.read_rules(spark).filter("id = 'A08'").first().review_order == 7
    results = spark.createDataFrame([("1", "甲/有限", "reject", "text"), ("2", "乙", None, "t")], "todo_id string, name string, decision string, final_opinion string")
    writers.append_progress(results, str(root / "progress"), "2026-01-01T00:00:00")
    writers.append_progress(results.withColumn("decision", F.lit("manual")), str(root / "progress"), "2026-01-02T00:00:00")
    (root / "progress" / "broken.json").write_text("{broken\n")
    latest = {r.todo_id: r.decision for r in readers.read_progress(spark, str(root / "progress")).collect()}
    assert latest == {"1": "manual", "2": "manual"}
    out = str(root / "decisions")
    legacy = spark.createDataFrame([("old", "skip")], "todo_id string, decision string")
    writers.write_decisions(results.select("todo_id", "decision"), out, "offline")
    assert [r.todo_id for r in readers.read_results(spark, out, "online", legacy).collect()] == ["old"]
    writers.write_decisions(results.select("todo_id", "decision").limit(1), out, "online")
    assert readers.read_results(spark, out, "online", legacy).count() == 1 and readers.read_results(spark, out, "offline").count() == 2
    writers.write_opinions(results, str(root / "opinions"))
    names = {r.file for r in spark.read.json(str(root / "opinions")).collect()}
    assert names == {"最终审批意见_1_甲_有限.txt", "最终审批意见_2_乙.txt"}


def test_a_keyed_store_is_read_in_blocks(spark, tmp_path):
    """Entries that cross blocks, brackets and quotes inside texts, an entry that is no JSON, several files and one line."""
    store = {str(i): {"todo": {"billType": f"P0{i % 3}", "title": '乙"{[\\'}, "supplier": {"name": "a\\", "registered_capital": i + .5},
                      "materials_detail": [{"fileName": "x}"}] * (i % 3)} for i in range(120)}
    text = json.dumps(store, ensure_ascii=False, indent=1).replace('"P00"', '"P00" "broken"', 1)
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"b": store["5"]}), encoding="utf-8")
    (tmp_path / "c.json").write_text("{}", encoding="utf-8")
    (tmp_path / "d.json").write_text("not json", encoding="utf-8")
    small = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "10"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        assert readers._numbered_lines(spark, str(tmp_path / "a.json")).select("block").distinct().count() > 5
        entries = readers.read_keyed_json(spark, str(tmp_path))
        found = {r.todo_id: (r.entry.todo.title, r.entry.supplier.name, r.entry.supplier.registered_capital, len(r.entry.materials_detail)) for r in entries.collect()}
    finally:
        for key in small:
            spark.conf.unset(key)
    wanted = {k: (v["todo"]["title"], v["supplier"]["name"], v["supplier"]["registered_capital"], len(v["materials_detail"])) for k, v in store.items()}
    del wanted["0"]
    assert found == {**wanted, "b": wanted["5"]}


def test_lines_are_judged_like_the_pattern_in_steps_of_any_size(spark, monkeypatch):
    """Quotes that stay open, backslashes outside of strings and before the end of a line as Java knows it, long indents, empty lines."""
    import random

    import pyarrow as pa
    from gatehouse.functions import fixed
    from gatehouse.sources import blocks

    pick = random.Random(1)
    lines = ["".join(pick.choices('"\\{}[], \tsx中\u2028\x85', [4, 3, 2, 2, 2, 2, 1, 2, 1, 1, 1, 1, 1, 1], k=pick.randrange(14))) for _ in range(4000)]
    lines += [" " * 200 + '"a": {', "\t" * 70, ',  "\\\\": [', '"\\\\\\"{"}', "", '"' * 3000 + "[" * 7]
    bare = F.regexp_replace("line", fixed.JSON_STRING, "s")
    step = F.length(F.translate(bare, "}]", "")) - F.length(F.translate(bare, "{[", ""))
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, line string").select("n", step.alias("step"), F.ltrim(bare, F.lit(" \t,")).startswith("s").alias("named")).orderBy("n").collect()
    for size in (64, 1 << 20):
        monkeypatch.setattr(blocks, "CHUNK_BYTES", size)
        for values in (pa.array(["}", *lines], pa.string()).slice(1), pa.array(lines, pa.large_string())):
            steps, named = blocks.judged(values)
            assert steps.tolist() == [r.step for r in rows] and named.tolist() == [r.named for r in rows]


def test_lines_of_a_keyed_store_are_not_dealt_and_its_entries_are_parsed_once(spark, tmp_path):
    import pyarrow as pa
    import pytest
    from gatehouse.sources import blocks

    (tmp_path / "a.json").write_text('{\n "k": {\n  "todo": {"title": "t"}\n },\n "l": {"todo": {}}\n}')
    entries = readers.read_keyed_json(spark, str(tmp_path))
    assert sorted((r.todo_id, r.entry.todo.title) for r in entries.collect()) == [("k", "t"), ("l", None)]
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    # the text is read to count its blocks and to cut it into entries; what is gathered by entry is all that is shuffled of it
    assert [plan.count(word) for word in ("from_json", "Relation [value", "MapInArrow", "Aggregate")] == [1, 2, 2, 1]
    assert [line for line in plan.split("\n") if "Window" in line and "value" in line] == []
    # a file of one block has nothing before it to be counted
    assert [line for line in plan.split("\n") if "Filter" in line and "file_block_length" in line and "file_size" in line]
    columns = {"file": [1, 1], "check": [1, 1], "block": [0, 0], "at": [5, 4], "value": ["{", "}"], "base": [0, 0], "first": [0, 0]}
    with pytest.raises(ValueError, match="in order"):
        list(blocks.entry_pieces(iter([pa.RecordBatch.from_pydict(columns)])))


def test_streams(spark, tmp_path):
    source, out, held = tmp_path / "in", str(tmp_path / "out"), []
    schema = "todo_id string, apply_time timestamp"

    def land(name, rows):
        spark.createDataFrame([(k, t and datetime.fromisoformat(t)) for k, t in rows], schema).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = jobs.decide_stream(stream, lambda df: df.withColumn("decision", F.lit("manual")), out, str(tmp_path / "ck"), "0 seconds")
        query.awaitTermination()
        held.append(max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators))
        return sorted(r.todo_id for r in spark.read.parquet(out).collect())

    land("a", [("1", "2026-01-01T00:00:00"), ("1", "2026-01-01T00:00:00"), ("2", "2026-01-02T00:00:00")])
    assert run() == ["1", "2"]
    land("b", [("2", "2026-01-03T00:00:00"), ("3", "2026-01-03T00:00:00")])
    assert run() == ["1", "2", "3"]
    # what arrived before has left the state, and is still decided once
    land("c", [("1", "2026-01-09T00:00:00"), ("2", "2025-01-09T00:00:00"), ("2", None)])
    assert run() == ["1", "2", "3"]
    for n in range(3):
        land("d", [(str(10 * n + k), "2026-02-01T00:00:00") for k in range(4)])
        run()
    assert max(held) <= 8
    log = str(tmp_path / "log")

    def count():
        events = spark.readStream.schema("at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(log)
        counted = jobs.run_to_table(jobs.call_counts_stream(events), str(tmp_path / "calls"), ["day", "endpoint"])
        return {(str(r.day), r.endpoint): r.calls for r in counted.collect()}

    def log_calls(*rows):
        spark.createDataFrame([(datetime.fromisoformat(t), k) for t, k in rows], "at timestamp, kind string").coalesce(1).write.mode("append").parquet(log)

    log_calls(("2026-01-01T01:00:00", "a"), ("2026-01-01T02:00:00", "a"), ("2026-01-02T02:00:00", "b"))
    assert count() == {("2026-01-01", "a"): 2, ("2026-01-02", "b"): 1}
    log_calls(("2026-01-02T03:00:00", "b"), ("2026-01-09T00:00:00", "a"))
    expected = {("2026-01-01", "a"): 2, ("2026-01-02", "b"): 2, ("2026-01-09", "a"): 1}
    assert count() == expected
    # the watermark has passed the first days: a late row changes nothing
    log_calls(("2026-01-01T05:00:00", "a"), ("2026-01-09T05:00:00", "a"))
    assert count() == {**expected, ("2026-01-09", "a"): 2}


def test_task_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "todo_id string, seq long, status string, step string, error string, at timestamp"

    def land(*rows):
        spark.createDataFrame([(k, n, status, "s", None, datetime.fromisoformat(t)) for k, n, status, t in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        found = jobs.run_to_table(jobs.task_stream(stream, 30), out, ["todo_id"])
        return {r.todo_id: (r.status, r.step) for r in found.collect()}

    land(("1", 1, "running", "2026-01-01T00:00:00"), ("2", 2, "running", "2026-01-01T00:00:00"), ("2", 3, "done", "2026-01-01T00:10:00"))
    assert run() == {"1": ("running", "s"), "2": ("done", "s")}
    # event time passes the limit of the first task; an older record of the second changes nothing
    land(("3", 9, "running", "2026-01-01T05:00:00"), ("2", 1, "running", "2026-01-01T00:05:00"))
    run()
    land(("3", 10, "running", "2026-01-01T05:10:00"))
    assert run() == {"1": ("error", "stale_running_reset"), "2": ("done", "s"), "3": ("running", "s")}


def test_live_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*rows):
        spark.createDataFrame([(k, n, t and datetime.fromisoformat(t)) for k, n, t in rows], "key string, seq long, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, seq long, at timestamp").parquet(source)
        found = jobs.run_to_table(jobs.live_stream(stream, 3600, "1 minute"), out, ["key"], "-entries")
        return {r.key: (r.entries, r.newest) for r in found.collect()}

    assert run(("a", 1, "2026-01-01T00:00:00"), ("a", 2, "2026-01-01T00:00:00"), ("a", 3, "2026-01-01T00:30:00"), ("b", 4, None), ("c", 5, "2026-01-01T00:10:00")) == {"a": (3, 3), "c": (1, 5)}
    # two of three entries of a and the only one of c have lived their hour; a late entry no longer counts
    assert run(("d", 6, "2026-01-01T01:20:00")) == {"a": (1, 3), "c": (0, 5), "d": (1, 6)}
    assert run(("c", 7, "2026-01-01T00:15:00"), ("d", 8, "2026-01-01T01:25:00")) == {"a": (1, 3), "c": (0, 5), "d": (2, 8)}


def test_live_stream_of_a_busy_key(spark, tmp_path, monkeypatch):
    """Blocks of moments end as they expire, whole and in part, while entries of the open block stay; repeated moments count each."""
    monkeypatch.setattr(jobs.LiveEntries, "BLOCK", 8)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = datetime(2026, 1, 1)
    log = [("busy", i, start + timedelta(seconds=10 * (i // 2))) for i in range(600)] + [("idle", 900 + i, start + timedelta(minutes=15 * i)) for i in range(4)]
    for low, high in ((0, 20), (20, 35), (35, 60)):
        part = [r for r in log if low * 60 <= (r[2] - start).total_seconds() < high * 60]
        spark.createDataFrame(part, "key string, seq long, at timestamp").coalesce(1).write.mode("append").parquet(source)
        found = jobs.run_to_table(jobs.live_stream(spark.readStream.schema("key string, seq long, at timestamp").parquet(source), 600, "1 minute"), out, ["key"], "-entries")
        seen = [r for r in log if (r[2] - start).total_seconds() < high * 60]
        least = max(r[2] for r in seen) - timedelta(seconds=660)
        for key in ("busy", "idle"):
            own = [r for r in seen if r[0] == key]
            row = found.where(F.col("key") == key).first()
            assert (row.entries, row.newest) == (sum(r[2] >= least for r in own), max(own, key=lambda r: (r[2], r[1]))[1])


def test_an_entry_costs_no_call_to_the_state(monkeypatch):
    """Calls to the state and its timers per key and batch do not grow with its entries."""
    from types import SimpleNamespace

    import pandas as pd

    calls = []

    def state(name, *_):
        known = {}
        return SimpleNamespace(get=lambda: calls.append("get") or known.get(0), update=lambda v: calls.append("update") or known.update({0: v}), exists=lambda: calls.append("exists") or 0 in known,
                               getValue=lambda k: calls.append("value") or known[k], containsKey=lambda k: calls.append("contains") or k in known,
                               updateValue=lambda k, v: calls.append("put") or known.update({k: v}))

    handle = SimpleNamespace(getValueState=state, getMapState=state, registerTimer=lambda at: calls.append("timer"), deleteTimer=lambda at: calls.append("timer"))
    watch = jobs.LiveEntries(3600)
    watch.init(handle)
    rows = pd.DataFrame({"seq": range(1000), "at": pd.date_range("2026-01-01", periods=1000, freq="s")})
    (found,) = watch.handleInputRows(("k",), iter([rows]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    assert (found.entries[0], found.newest[0]) == (1000, 999) and len(calls) <= 3


def test_a_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from gatehouse.session import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    bare = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        shared_folder(bare)


def test_readings_are_shared(spark):
    from gatehouse.operators.extract import shared_results, to_extract

    columns = "doc_id string, todo_id string, doc_type string, file string, position int, text string, sha256 string, engine string, error string"
    docs = spark.createDataFrame([
        ("a", "1", "t", "a.png", 0, "x", "h", "e", None), ("b", "2", "t", "b.png", 1, "x", "h", "e", None), ("c", "3", "u", "c.png", 0, "x", "h", "e", None),
        ("d", "4", "t", "d.png", 0, "y", None, None, None), ("f", "5", "t", "f.png", 0, "z", None, "e", None), ("g", "6", "t", "g.png", 0, "w", "k", "e", None)], columns)
    cache = spark.createDataFrame([("k", "e", "t", "old", None)], "sha256 string, engine string, doc_type string, fields string, error string")
    chosen = to_extract(docs, cache)
    assert sorted(r.doc_id for r in chosen.collect()) == ["a", "c", "d", "f"]
    results = chosen.select("doc_id", F.concat(F.lit("read "), "doc_id").alias("fields"), F.lit(None).cast("string").alias("error"))
    found = {r.doc_id: (r.todo_id, r.file, r.fields) for r in shared_results(docs, results, cache).collect()}
    assert found == {"a": ("1", "a.png", "read a"), "b": ("2", "b.png", "read a"), "c": ("3", "c.png", "read c"), "d": ("4", "d.png", "read d"),
                     "f": ("5", "f.png", "read f"), "g": ("6", "g.png", "old")}


def test_every_keyed_store_is_one_object_however_its_rows_are_joined(spark, tmp_path, monkeypatch):
    """Stores of a few keys each, written by plans that shuffle every join, hold all entries but the broken ones."""
    from gatehouse.plans import round_trips

    monkeypatch.setattr(round_trips, "STORED", 40)
    spark.range(1, 201).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "id + 0.25D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 401).selectExpr("(id + 1) div 2 AS l_orderkey", "CAST(id % 2 AS INT) AS l_linenumber", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    # entries are more parts than what is known of each store
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "2kb"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = {(r.todo_id, r.place): (r.bill_type, r.supplier, r.capital, r.file_name) for r in round_trips.keyed_store(spark, str(tmp_path)).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert rows == {(str((i + 1) // 2), i % 2): (f"P0{(i + 1) // 2 % 7 % 3}", f'公司"{(i + 1) // 2 % 7}"{{', (i + 1) // 2 + 0.25, f"f{i}\\n.pdf")
                    for i in range(1, 401) if (i + 1) // 2 % round_trips.BROKEN}


def test_spot_ordinal_orders_small_groups_in_one_window_and_large_ones_in_cells(spark, monkeypatch):
    rows = [("hot", i % 3, f"n{i % 90}") for i in range(400)] + [("hot", None, None)] + [(f"k{i % 40}", i % 2, f"n{i}") for i in range(200)] + [(None, 0, "q")] * 2
    df = spark.createDataFrame(rows, "k string, at int, name string")
    ranked = Window.partitionBy("k").orderBy("at", "name")
    want = sorted(map(str, df.select("k", "at", "name", F.row_number().over(ranked).alias("n"), F.count("*").over(Window.partitionBy("k")).alias("t")).collect()))

    def numbered():
        return ordering.spot_ordinal(df, ["k"], F.col("at"), "name", [F.floor(F.col("__place") / 512), F.col("__place")], "n", "t").select("k", "at", "name", "n", "t")

    plain = numbered()
    assert sorted(map(str, plain.collect())) == want
    # no group is large: one shuffle by the keys is all
    assert plain._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(ordering, "WHOLE", 50)
    monkeypatch.setattr(ordering, "CROWDED", 20)
    assert sorted(map(str, numbered().collect())) == want
