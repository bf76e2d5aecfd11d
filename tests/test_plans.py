"""What plans must not contain: work that grows faster than its rows, or methods that the JVM does not compile."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatehouse.operators import classify
from gatehouse.operators.extract.certificates import page_texts, read_production, read_transport
from gatehouse.schemas import OCR_LINE


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def largest_method(spark, df) -> int:
    """Bytes of the largest generated method; -1 stands for one that does not compile at all."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
        sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return -1 if min(sizes, default=0) < 0 else max(sizes, default=0)


def test_flagged_uploads_match_like_arrays(spark):
    rows = [("a", "旧 营业执照.jpg", "组织机构代码证图片", None), ("a", "营业执照.jpg", "营业执照副本图片", None), ("b", "旧 营业执照.jpg", "开户许可证图片", None),
            ("c", "环境管理.jpg", "环境管理体系认证证书图片", None), ("d", "环境管理.jpg", "环境管理体系认证证书图片", "含ID_Card"), ("e", "ISO9001 CNAS.pdf", "营业执照", "cma"),
            ("e", "ISO9001 CNAS.pdf", None, "审计"), ("f", "９００１ CNAS.pdf", "质量管理体系认证证书扫描件", None), ("g", "道路运输.pdf", "x", None), ("h", None, "营业执照", None)]
    mats = spark.createDataFrame(rows, "todo_id string, file_name string, type_name string, file_desc string").withColumn("file_summ", F.lit(None).cast("string"))
    flagged = classify.with_type_flags(mats)
    files = mats.select("todo_id", F.concat(F.lit("7_"), F.coalesce("file_name", F.lit("x"))).alias("file")).distinct()
    with_arrays = classify.match_files(files, classify.classify_materials(mats))
    with_flags = classify.match_files(files, flagged)
    assert sorted(map(tuple, with_flags.collect())) == sorted(map(tuple, with_arrays.collect()))
    assert "ObjectHashAggregate" not in plan_of(with_flags) and "SortAggregate" not in plan_of(with_flags)


def test_files_meet_one_shuffle_of_their_uploads(spark):
    """Two joins and the owners read the same narrow rows; files that repeat, prefixes of prefixes and nulls come out as they went in."""
    rows = [("a", "2_ISO9001.pdf", "营业执照", None), ("a", "ISO9001.pdf", "开户许可证图片", None), ("a", "1_2_ISO9001.pdf", "x", "审计"), ("b", "", "营业执照", None), ("b", None, "营业执照", None),
            ("b", "旧 营业执照.jpg", "营业执照副本图片", None), ("c", "旧 营业执照.jpg", None, "cma"), ("c", "x", "营业执照", None), (None, "营业执照.jpg", "营业执照", None)]
    mats = spark.createDataFrame(rows, "todo_id string, file_name string, type_name string, file_desc string").withColumn("file_summ", F.lit(None).cast("string"))
    names = [("a", "1_2_ISO9001.pdf"), ("a", "2_ISO9001.pdf"), ("a", "2_ISO9001.pdf"), ("a", "ISO9001.pdf"), ("a", "7_ISO9001.pdf"), ("b", "3_旧 营业执照.jpg"), ("b", "4_"), ("b", ""), ("b", None),
             ("c", "5_旧 营业执照.jpg"), ("c", "6_x"), (None, "营业执照.jpg"), ("d", "营业执照.jpg")]
    files = spark.createDataFrame([(*name, i) for i, name in enumerate(names)], "todo_id string, file string, size int")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        matched = classify.match_files(files, classify.with_type_flags(mats))
        lines = [line for line in plan_of(matched).split("\n") if "Exchange" in line]
        found = {r.size: (r.todo_id, r.file, sorted(r.types)) for r in matched.collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    # files by name, by bare name and by owner, uploads once, owners once
    assert [sum("ReusedExchange" in line for line in lines), sum("ReusedExchange" not in line for line in lines)] == [2, 5]
    wanted = classify.match_files(files, classify.classify_materials(mats))
    assert found == {r.size: (r.todo_id, r.file, sorted(r.types)) for r in wanted.collect()} and len(found) == len(names)


def test_public_gate_is_compiled(spark):
    from gatehouse.plans.driver_queries import public_gate
    from gatehouse.plans.operator_queries import public_files

    for run in (public_gate, public_files):
        assert 0 < largest_method(spark, run(spark, "/root/testdata/sf0.001")) < 8000


def test_texts_without_pages_are_read_in_their_row(spark):
    docs = spark.createDataFrame([
        ("p", "全国工业产品生产许可证 许可证编号：XK07-002-00417 有效期至：2091年10月30日"), ("q", "营业执照"), (None, "食品生产许可证"), ("r", None)],
        "doc_id string, text string").repartition(2)
    pages = page_texts(spark.createDataFrame([], OCR_LINE))
    production, transport = read_production(docs, pages), read_transport(docs, pages)
    assert {r.doc_id: (r.kind, r.actual) for r in production.collect()} == {
        "p": ("工业产品生产许可证", None), "q": (None, "营业执照"), None: ("食品生产许可证", None), "r": (None, "其他材料")}
    for read in (production, transport):
        assert not [line for line in plan_of(read).split("\n") if "Filter" in line and "regexp_replace" in line]


def test_items_look_their_documents_up_in_one_map(spark):
    from gatehouse.plans.operator_queries import certificate_merge

    lines = plan_of(certificate_merge(spark, "/root/testdata/sf0.001")).split("\n")
    made = [line for line in lines if "map_from_arrays" in line]
    assert made and all("Generate" in line for line in made)


def test_boxes_of_a_page_are_dealt_once(spark):
    from gatehouse.operators import layout

    rows = [("a", 1, i, f"t{i}", float(i * 37 % 11), float(i // 4 * (90 if i < 20 else 7)), float(i // 4 * (90 if i < 20 else 7) + 20)) for i in range(40)]
    rows += [("b", 1, 0, "x", 0.0, 0.0, 20.0), ("b", 2, 0, None, 5.0, 3.0, 23.0), ("b", 2, 1, "y", 0.0, 1.0, 21.0), (None, 1, 0, "z", 0.0, 0.0, 20.0)]
    boxes = spark.createDataFrame(rows, "doc_id string, page_id int, line_no int, text string, x1 double, y1 double, y2 double").repartition(3)
    expected = sorted(map(tuple, layout.page_reading(layout.reading_order(boxes)).collect()))
    assert len(expected) == 3 and ("b", 2, "y") in expected
    for most in (1, 5, 40):
        assert sorted(map(tuple, layout.read_pages(boxes, most).collect())) == expected
        assert sorted(map(tuple, layout.page_reading(layout.reading_order(boxes, most)).collect())) == expected
    assert plan_of(layout.read_pages(boxes)).count("Exchange hash") == 1


def test_a_card_term_is_read_once(spark):
    from gatehouse.plans.operator_queries import id_cards

    plan = id_cards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.split("\n") if "regexp_extract_all" in line]
    assert len(lines) == 1 and lines[0].count("regexp_extract_all") == 2 and "Generate" in lines[0]
    assert 0 < largest_method(spark, id_cards(spark, "/root/testdata/sf0.001")) < 8000
