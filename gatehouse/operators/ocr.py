"""Certificate results of a request: attachments combined, then merged into the checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ordering import computed_once, spot_ordinal
from ..functions.outcome import say
from ..functions.text import blank, bound, has_any, shown

CELL = 512
TYPE_CHECK = "材料类型正确"
NEEDS_TYPE = "未完成生产许可证/3C强制认证材料类型核验，需重新提取或人工核验"
_CHECKS = "map<string,boolean>"


def combine_attachments(extractions: DataFrame) -> DataFrame:
    """A5 + W6: each attachment with its ordinal within (request, type) and prefixed results.

    A single attachment stays as it is. With several, every check, field and
    issue carries `附件N(file)`, and a failed or unchecked attachment adds a null
    check, so that all of them must pass. One row per attachment: no group is collected. Attachments are numbered in cells of
    positions; a cell of very many, such as a request whose attachments all stand at one position, is cut by ranges of its document ids.
    """
    checks = F.coalesce("checks", F.create_map().cast(_CHECKS))
    fields = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    issues = F.coalesce("issues", F.array().cast("array<string>"))
    given = extractions.withColumn("checks", checks).withColumn("fields", fields).withColumn("issues", issues)
    # positions that are crowded by themselves are cells of their own before names cut them
    rows = spot_ordinal(given, ["todo_id", "doc_type"], F.col("position"), "doc_id", [F.floor(F.col("__place") / CELL), F.col("__place")],
                        "ordinal", "documents")
    many = F.col("documents") > 1
    prefix = F.when(many, F.concat(
        F.lit("附件"), F.col("ordinal").cast("string"), F.lit("("), blank(F.col("file")), F.lit(")"))).otherwise("")
    keyed = lambda name: F.transform_keys(
        name, lambda k, v: F.when(many, F.concat(prefix, F.lit(" "), k)).otherwise(k))
    unchecked = F.create_map(F.concat(prefix, F.lit(" 核验完成")), F.lit(None).cast("boolean"))
    notes = F.transform("issues", lambda i: F.when(many, F.concat(prefix, F.lit("："), i)).otherwise(i))
    broken = F.array_compact(F.array(F.when(
        many & F.col("error").isNotNull(), F.concat(prefix, F.lit("：识别失败，需人工核验")))))
    return rows.select(
        *[c for c in rows.columns if c not in ("checks", "fields", "issues")],
        F.col("checks").alias("own_checks"), F.col("fields").alias("own_fields"), F.col("issues").alias("own_issues"),
        F.col("checks")[TYPE_CHECK].alias("type_check"),
        (F.coalesce(F.col("checks")[TYPE_CHECK] & F.col("checks")["在有效期内"], F.lit(False))
         & (F.size("issues") == 0) & F.col("error").isNull()).alias("is_valid"),
        F.coalesce(F.col("checks")[TYPE_CHECK] & ~F.col("checks")["在有效期内"], F.lit(False)).alias("is_expired"),
        F.when(many & (F.size(F.map_keys("checks")) == 0), unchecked).otherwise(keyed("checks")).alias("checks"),
        keyed("fields").alias("fields"), F.concat(notes, broken).alias("issues"))


def _keys(test) -> Column:
    return F.map_keys(F.map_filter("checks", lambda k, v: test(v)))


def ocr_summary(extractions: DataFrame) -> DataFrame:
    """What the checklist needs of each (request, type), in attachment order.

    Attachments meet in cells of at most 512 ordinals first; per request only
    the short cell summaries meet. Lists that are shown cut are cut per cell.
    """
    rows = combine_attachments(extractions)
    first = F.struct("position", "doc_id")
    shown_fields = F.transform(
        F.slice(F.map_entries("fields"), 1, 4), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    cells = rows.select(
        "todo_id", "doc_type", F.floor((F.col("ordinal") - 1) / CELL).alias("cell"), "documents", "type_check",
        "is_valid", "is_expired", F.struct(
            first.alias("at"), F.slice("issues", 1, 3).alias("issues"), F.size("issues").alias("n_issues"),
            _keys(lambda v: v).alias("yes"), _keys(lambda v: ~v).alias("no"),
            _keys(lambda v: v.isNull()).alias("open"), shown_fields.alias("fields")).alias("row"),
    ).groupBy("todo_id", "doc_type", "cell").agg(
        F.max("documents").alias("documents"), F.min("type_check").alias("type_check"),
        F.bool_and("is_valid").alias("all_valid"), F.bool_or("is_expired").alias("any_expired"),
        F.sort_array(F.collect_list("row")).alias("rows"))

    def flat(name: str) -> Column:
        return F.flatten(F.transform("rows", lambda r: r[name]))

    pieces = cells.select(
        "todo_id", "doc_type", "documents", "type_check", "all_valid", "any_expired", F.struct(
            "cell", F.slice(flat("issues"), 1, 3).alias("issues"),
            F.aggregate(F.transform("rows", lambda r: r["n_issues"]), F.lit(0), lambda a, n: a + n).alias("n_issues"),
            F.slice(flat("no"), 1, 3).alias("no"), F.size(flat("no")).alias("n_no"),
            F.array_join(flat("yes"), "；").alias("yes"), F.size(flat("yes")).alias("n_yes"),
            F.array_join(flat("open"), "; ").alias("open"), F.size(flat("open")).alias("n_open"),
            F.slice(flat("fields"), 1, 4).alias("fields")).alias("piece"))
    folded = pieces.groupBy("todo_id", "doc_type").agg(
        F.max("documents").alias("documents"), F.min("type_check").alias("type_check"),
        F.bool_and("all_valid").alias("all_valid"), F.bool_or("any_expired").alias("any_expired"),
        F.sum("piece.n_issues").alias("n_issues"), F.sum("piece.n_no").alias("n_no"),
        F.sum("piece.n_yes").alias("n_yes"), F.sum("piece.n_open").alias("n_open"),
        F.sort_array(F.collect_list("piece")).alias("pieces"))

    def joined(name: str, separator: str) -> Column:
        return F.array_join(F.filter(F.transform("pieces", lambda p: p[name]), lambda t: t != ""), separator)

    def top(name: str, size: int) -> Column:
        return F.slice(F.flatten(F.transform("pieces", lambda p: p[name])), 1, size)

    # a production licence needs its own, unprefixed type check
    typed = F.when(F.col("documents") == 1, F.col("type_check"))
    base = folded.select(
        "todo_id", "doc_type", "documents", "all_valid", "any_expired", typed.alias("type_check"),
        top("issues", 3).alias("issues"), "n_issues", top("no", 3).alias("no"), "n_no",
        joined("yes", "；").alias("yes"), "n_yes", joined("open", "; ").alias("open"), "n_open",
        F.array_join(F.transform(
            F.filter(top("fields", 4), lambda f: f["v"].isNotNull()),
            lambda f: F.concat(f["k"], F.lit("="), shown(f["v"]))), "，").alias("sample"))
    return _guard_production(base)


def _guard_production(base: DataFrame) -> DataFrame:
    """A production licence without a confirmed type can at most be manual."""
    production = F.col("doc_type") == "production_license"
    add_check = production & F.col("type_check").isNull() & ~F.concat_ws(
        "; ", F.lit(""), F.col("open"), F.lit("")).contains(f"; {TYPE_CHECK}; ")
    add_issue = production & F.col("type_check").isNull()
    return base.select(
        *[c for c in base.columns if c not in ("issues", "n_issues", "open", "n_open")],
        F.when(add_issue & (F.size("issues") < 3), F.concat("issues", F.array(F.lit(NEEDS_TYPE))))
        .otherwise(F.col("issues")).alias("issues"),
        (F.col("n_issues") + F.when(add_issue, 1).otherwise(0)).alias("n_issues"),
        F.when(add_check, F.concat_ws("; ", F.nullif("open", F.lit("")), F.lit(TYPE_CHECK)))
        .otherwise(F.col("open")).alias("open"),
        (F.col("n_open") + F.when(add_check, 1).otherwise(0)).alias("n_open"))


def feeds() -> Column:
    """Document type -> the first item of a request whose name has the words of that type."""
    kinds = F.array(*[F.lit(kind) for kind in fixed.ITEM_WORDS])

    def target(words: list[str]) -> Column:
        return F.try_element_at(F.filter("items", lambda i: has_any(i["name"], words)), F.lit(1))["rule_id"]

    return F.map_from_arrays(kinds, F.array(*[target(words) for words in fixed.ITEM_WORDS.values()]))


def _rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(r)) for s, r in fixed.STATUS_RANK.items()],
                      F.lit(fixed.UNKNOWN_RANK))


def _cut(lines: Column, total: Column) -> Column:
    return F.concat(F.array_join(F.slice(lines, 1, 3), "；"), F.when(
        total > 3, F.concat(F.lit("（另有"), (total - 3).cast("string"), F.lit("项）"))).otherwise(""))


def judge(summary: DataFrame) -> DataFrame:
    """K8 per (request, type): proposed status, detail and the text of the issue, if any."""
    failing = F.concat("issues", F.transform("no", lambda k: F.concat(k, F.lit("=False"))))
    bad = _cut(failing, F.col("n_issues") + F.col("n_no"))
    doubtful = F.concat(_cut(F.col("issues"), F.col("n_issues")), F.when(
        F.col("n_yes") > 0, say("（已确认：", F.col("yes"), "）")).otherwise(""))
    transport = F.col("doc_type") == "transport_license"
    moved = (F.when(F.col("all_valid"), "OCR核验通过：证书类型正确、在有效期内")
             .when(F.col("any_expired"), "OCR核验发现问题：运输承运证书已过期")
             .otherwise("运输承运资质未完成证书类型及有效期核验，转人工核查"))
    status = (
        F.when(transport, F.when(F.col("all_valid"), "pass").when(F.col("any_expired"), "fail").otherwise("manual"))
        .when(F.col("n_no") > 0, "fail").when(F.col("n_issues") > 0, "manual")
        .when((F.col("n_yes") > 0) & (F.col("n_open") == 0), "pass").when(F.col("n_yes") > 0, "partial"))
    detail = (
        F.when(transport, moved).when(status == "fail", say("OCR核验发现问题：", bad))
        .when(status == "manual", say("OCR核验需人工：", doubtful))
        .when(status == "pass", say("OCR核验通过：", F.col("sample")))
        .when(status == "partial", say(
            "OCR核验：自动确认", F.col("n_yes").cast("string"), "项，", F.col("n_open").cast("string"),
            "项需人工核验（", F.col("open"), "）")))
    issue = (F.when(transport, F.when(status != "pass", detail))
             .when(status == "fail", bad).when(status == "manual", doubtful))
    order = F.coalesce(*[F.when(F.col("doc_type") == kind, F.lit(i))
                         for i, kind in enumerate(fixed.ITEM_WORDS)])
    return summary.select("todo_id", "doc_type", order.alias("type_order"), status.alias("status"),
                          detail.alias("detail"), issue.alias("issue"))


DOCS = "array<struct<type_order:int,doc_type:string,status:string,detail:string,issue:string>>"


def ocr_documents(extractions: DataFrame) -> DataFrame:
    """K8 results of each request as one array in the order the types are applied (at most one per type)."""
    judged = judge(ocr_summary(extractions)).filter("type_order is not null")
    return judged.groupBy("todo_id").agg(F.sort_array(F.collect_list(F.struct(
        "type_order", "doc_type", "status", "detail", "issue"))).alias("ocr_documents"))


def enrich_ocr(requests: DataFrame) -> DataFrame:
    """Certificate results (`ocr_documents`) merged into the items they feed.

    Several types of one item keep the graver status; a registry conflict is
    never erased. Adds `ocr_issues` (array of struct(type_order, issue)) to each item.
    """
    # a value of the row: the lookup inside the lambdas would otherwise make the map again for every item and document
    staged = computed_once(requests, feeds(), "__feeds")
    docs = F.coalesce("ocr_documents", F.array().cast(DOCS))

    def merged(item: Column) -> Column:
        own = F.filter(docs, lambda d: F.try_element_at("__feeds", d["doc_type"]) == item["rule_id"])
        start = F.struct(
            item["status"].alias("status"), item["detail"].alias("detail"),
            F.lit(None).cast("string").alias("prior_status"), F.lit(None).cast("string").alias("prior_detail"),
            F.array().cast("array<struct<type_order:int,issue:string>>").alias("issues"))
        return F.struct(item.alias("item"), F.aggregate(own, start, lambda acc, d: _step(item, acc, d)).alias("after"))

    pairs = F.transform("items", merged)
    return (staged.withColumn("__pairs", pairs).withColumn("items", F.transform("__pairs", lambda p: (
        p["item"].withField("status", p["after"]["status"]).withField("detail", p["after"]["detail"])
        .withField("ocr_issues", p["after"]["issues"])))).drop("__pairs", "__feeds"))


def _step(item: Column, acc: Column, d: Column) -> Column:
    """One document type applied to an item."""
    transport = d["doc_type"] == "transport_license"
    stale = transport & (acc["status"] == "fail") & ~item["has_files"]
    own_status = F.coalesce(d["status"], acc["status"])
    own_detail = F.coalesce(d["detail"], acc["detail"])
    graver = acc["prior_status"].isNotNull() & (_rank(acc["prior_status"]) > _rank(own_status))
    conflict = F.coalesce(acc["status"].isin("fail", "manual", "partial")
                          & acc["detail"].contains("企查查"), F.lit(False))
    chosen = F.when(graver, F.struct(acc["prior_status"].alias("status"), acc["prior_detail"].alias("detail"))).otherwise(
        F.struct(own_status.alias("status"), own_detail.alias("detail")))

    def settled(c: Column) -> Column:
        return F.struct(
            F.when(conflict & (c["status"] == "pass"), acc["status"]).otherwise(c["status"]).alias("status"),
            F.when(conflict, F.concat(c["detail"], F.lit("；"), acc["detail"])).otherwise(c["detail"]).alias("detail"))

    text = F.when(transport, d["issue"]).otherwise(F.concat(item["name"], F.lit("："), d["issue"]))
    added = F.array_compact(F.array(F.when(
        ~stale & d["issue"].isNotNull(), F.struct(d["type_order"].alias("type_order"), text.alias("issue")))))

    def after(c: Column) -> Column:
        return F.struct(
            F.when(stale, acc["status"]).when(transport, d["status"]).otherwise(c["status"]).alias("status"),
            F.when(stale, acc["detail"]).when(transport, d["detail"]).otherwise(c["detail"]).alias("detail"),
            F.when(transport, acc["prior_status"]).otherwise(c["status"]).alias("prior_status"),
            F.when(transport, acc["prior_detail"]).otherwise(c["detail"]).alias("prior_detail"),
            F.concat(acc["issues"], added).alias("issues"))

    return bound(bound(chosen, settled), after)


def combine_severity(items: DataFrame, keys: list[str], status: str = "status",
                     order: str = "ordinal") -> DataFrame:
    """K9 as an aggregate: the gravest status of each key, the first of equals."""
    return items.groupBy(*keys).agg(
        F.max_by(status, F.struct(_rank(F.col(status)), -F.col(order))).alias(status))
