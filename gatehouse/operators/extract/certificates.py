"""Tax credit, authorisation, generic, production, transport and after-sales papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.dates import find_dates, is_long_term, last_date, term_text, valid_until
from ...functions.outcome import outcome, say
from ...functions.ordering import joined_text
from ...functions.text import (
    blank, bound, either_contains, find, find_all, grab, has, has_any, prepare_text, prepared, squeeze,
)
from .licence import company_name


def _validity(until: Column, day: Column) -> tuple[Column, Column]:
    """(check, is known) of a validity struct."""
    known = until["longterm"] | until["date"].isNotNull()
    return until["longterm"] | (until["date"] >= day), known


def _packed(docs: DataFrame) -> DataFrame:
    """`docs` with the prepared text without white space, in a step of its own like `prepared`."""
    return prepared(docs).withColumn("__n", F.when(F.col("__t").isNotNull(), squeeze(F.col("__t"))))


def read_tax_credit(docs: DataFrame) -> DataFrame:
    n = F.col("__n")
    return _packed(docs).select(
        *docs.columns,
        F.coalesce(*[find(n, p) for p in fixed.TAX_LEVELS]).alias("level"),
        F.coalesce(*[find(n, p) for p in fixed.TAX_YEARS]).alias("year"),
        has(n, fixed.TAX_SOURCE).alias("official"))


def check_tax_credit(read: DataFrame, as_of: str) -> DataFrame:
    """Level C or better, last year's assessment, official source."""
    required = (F.year(F.lit(as_of).cast("date")) - 1).cast("string")
    level, year = F.col("level"), F.col("year")
    return read.withColumn("result", outcome(
        fields=[("纳税信用级别", level), ("评价年度", year),
                ("来源标记", F.when(F.col("official"), "有税务机关字样").otherwise("未见税务机关字样"))],
        checks=[("C级及以上", level.isin("A", "B", "C"), level.isNotNull()),
                (F.concat(F.lit("评价年度="), required), year == required, year.isNotNull())],
        issues=[
            F.when(level == "D", say("纳税信用等级为", level, "级，低于C级要求"))
            .when(level.isNull(), F.lit("未能识别纳税信用等级（请人工核实文件内容）")),
            F.when(year != required, say("上传为", year, "年度纳税信用评价，按161号标准应为", required, "年度（上年度）")),
            F.when(~F.col("official"), F.lit("文件未见税务机关落款/来源（需人工确认是否国税总局网站下载）")),
        ]))


def read_authorization(docs: DataFrame) -> DataFrame:
    t = F.col("__t")
    return prepared(docs).select(
        *docs.columns, grab(t, fixed.GRANTOR_LABELS, fixed.VALUE_60).alias("grantor"),
        grab(t, fixed.GRANTEE_LABELS, fixed.VALUE_60).alias("grantee"), valid_until(t).alias("until"))


def check_authorization(read: DataFrame, as_of: str) -> DataFrame:
    """X12."""
    day = F.lit(as_of).cast("date")
    grantee, system, until = squeeze(F.col("grantee")), company_name(), F.col("until")
    comparable = (grantee != "") & (F.length(system) > 4)
    same = either_contains(grantee, system)
    valid, known = _validity(until, day)
    return read.withColumn("result", outcome(
        fields=[("授权方", F.col("grantor")), ("被授权方", F.col("grantee")), ("有效期至", term_text(until))],
        checks=[("被授权方为本公司", same, comparable), ("在有效期内", valid, known)],
        issues=[
            F.when(comparable & ~same, say("授权书被授权方「", grantee, "」与供应商「", system, "」不一致")),
            F.when(known & ~valid, say("授权已过期（", until["date"].cast("string"), "）"))
            .when(~known, F.lit("授权书未识别到有效期（需人工核验）")),
        ]))


def _generic_read() -> list[Column]:
    n = F.col("__n")
    labelled = has(n, fixed.LABELLED_RANGE) | has(n, fixed.LABELLED_EXPIRY) | has(n, fixed.LABELLED_ISSUE)
    return [labelled.alias("labelled"), valid_until(n).alias("until")]


def read_generic(docs: DataFrame) -> DataFrame:
    return _packed(docs).select(*docs.columns, *_generic_read())


def _generic_parts(day: Column) -> tuple[list, list, list]:
    labelled, until = F.col("labelled"), F.col("until")
    valid, known = _validity(until, day)
    fields = [("有效期至", F.when(labelled, term_text(until))),
              ("备注", F.lit("未识别到有效期标签"), ~labelled)]
    checks = [("在有效期内", F.when(labelled, valid), ~labelled | known)]
    issues = [
        F.when(~labelled, F.lit("未识别到有效期标签（材料可能为开票资料/其他证明，或 OCR 未能识别，需人工核验）"))
        .when(known & ~valid, say("证书已过期（", until["date"].cast("string"), "）"))
        .when(~known, F.lit("未识别到有效期（需人工核验）"))]
    return fields, checks, issues


def check_generic(read: DataFrame, as_of: str) -> DataFrame:
    """Validity counts only where it is labelled."""
    return read.withColumn("result", outcome(*_generic_parts(F.lit(as_of).cast("date"))))


def page_texts(lines: DataFrame) -> DataFrame:
    """Text of each page with something on it."""
    filled = lines.filter("coalesce(text, '') <> ''").withColumn("page_id", F.coalesce("page_id", F.lit(0)))
    return joined_text(filled, ["doc_id", "page_id"], F.struct("line_no", "text"), F.col("text"),
                       F.floor(F.col("line_no") / 512), "\n", "page_text")


def _production_type(packed: Column) -> Column:
    lowered = F.lower(packed)
    return F.coalesce(*[
        F.when(has_any(lowered, [m.lower() for m in markers]), F.lit(label))
        for label, markers in fixed.PRODUCTION_MARKERS])


def _first_marked(docs: DataFrame, pages: DataFrame, read: Callable[[Column], Column]) -> DataFrame:
    """`docs` with `__found`, what `read` finds on the first page (in page order) on which it finds something, else null.

    A document without page lines is one page of its whole text and read in its row: only pages are grouped. A page on which
    nothing is found has no place in the order; a filter on what is found would read each page once more for every use of it.
    """
    order = F.when(F.col("__read").isNotNull(), F.col("page_id").cast("string"))
    found = (pages.select("doc_id", "page_id", read(F.col("page_text")).alias("__read"))
             .groupBy("doc_id").agg(F.min_by("__read", order).alias("__paged"), F.lit(True).alias("__has_pages")))
    own = F.when(F.col("__has_pages").isNull(), read(blank(F.col("text"))))
    return docs.join(found, "doc_id", "left").withColumn("__found", F.coalesce(own, "__paged")).drop("__paged", "__has_pages")


def read_production(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The first page (in page order) that names a licence; dates of other pages do not count."""
    def licence(text: Column) -> Column:
        def of(block: Column) -> Column:
            kind = _production_type(block)
            return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), block.alias("block")))

        return bound(squeeze(prepare_text(text)), of)

    n = F.col("__n")
    actual = F.array_join(F.array_compact(F.array(*[
        F.when(has_any(n, words), F.lit(label)) for label, words in fixed.OTHER_MATERIALS])), "、")
    # what else the text may be is asked only where no licence was found
    staged = _first_marked(docs, pages, licence).withColumn(
        "__n", F.when(F.col("__found").isNull(), squeeze(prepare_text(F.col("text")))))
    block = F.col("__found.block")
    return staged.select(
        *docs.columns, F.col("__found.kind").alias("kind"), find(block, fixed.PRODUCTION_NUMBER).alias("number"),
        valid_until(block).alias("until"), blank(block).alias("block"),
        F.when(n.isNotNull(), F.when(actual == "", "其他材料").otherwise(actual)).alias("actual"))


def check_production(read: DataFrame, as_of: str) -> DataFrame:
    """X14."""
    day = F.lit(as_of).cast("date")
    kind, until = F.col("kind"), F.col("until")
    right = kind.isNotNull()
    name = company_name()
    named = right & (name != "")
    holds = F.col("block").contains(name)
    valid, known = _validity(until, day)
    return read.withColumn("result", outcome(
        fields=[("证书类型", kind), ("证书编号", F.col("number"), F.col("number").isNotNull()),
                ("有效期至", F.when(right, term_text(until)))],
        checks=[("材料类型正确", right), ("持证主体一致", F.when(holds, True), named),
                ("在有效期内", F.when(right & known, valid))],
        issues=[
            F.when(~right, say("上传材料实际为", F.col("actual"), "，应为生产许可证或3C强制认证证明")),
            F.when(named & ~holds, F.lit("未能确认生产许可/强制认证证书持证主体与供应商一致，需人工核验")),
            F.when(right, F.when(known & ~valid, say(kind, "已过期（", until["date"].cast("string"), "）"))
                   .when(~known, say(kind, "未识别到有效期，需人工核验"))),
        ]))


def read_transport(docs: DataFrame, pages: DataFrame) -> DataFrame:
    def licence(text: Column) -> Column:
        return bound(prepare_text(text), lambda t: F.when(has_any(squeeze(t), fixed.TRANSPORT_MARKERS), t))

    page = F.col("__found")
    staged = _first_marked(docs, pages, licence).withColumn(
        "__segment", squeeze(F.regexp_extract(blank(page), "(?dU)" + fixed.TRANSPORT_TERM, 0)))
    segment = F.col("__segment")
    return staged.select(*docs.columns, page.isNotNull().alias("marked"), find_dates(segment).alias("term_dates"),
                         is_long_term(segment).alias("longterm"))


def check_transport(read: DataFrame, as_of: str) -> DataFrame:
    """A licence that is not valid yet stays unknown."""
    day = F.lit(as_of).cast("date")
    dates, longterm, marked = F.col("term_dates"), F.col("longterm"), F.col("marked")
    until = F.try_element_at(dates, F.lit(-1))
    early = (F.size(dates) >= 2) & (F.try_element_at(dates, F.lit(1)) > day)
    current = F.when(marked & ~early, F.coalesce(until >= day, F.when(longterm, True)))
    return read.withColumn("result", outcome(
        fields=[("有效期至", F.coalesce(until.cast("string"), F.when(longterm, F.lit("长期"))), marked)],
        checks=[("材料类型正确", F.when(marked, True)), ("在有效期内", current)],
        issues=[
            F.when(~marked, F.lit("未识别到道路运输许可证或官方无船承运证书，转人工核查"))
            .when(current.isNull(), F.lit("未确认有效期或证书尚未生效，转人工核查"))
            .when(~current, F.lit("证书已过期"))]))


def _statement_parts(day: Column) -> tuple[list, list, list]:
    signed = F.col("signed")
    days = F.datediff(day, signed)
    fields = [("落款日期", signed.cast("string"))]
    checks = [("落款时间在3个月内", (days >= 0) & (days <= fixed.STATEMENT_DAYS))]
    issues = [
        F.when(days < 0, say("落款日期", signed.cast("string"), "晚于今天（日期异常，需人工核验）"))
        .when(days > fixed.STATEMENT_DAYS, say(
            "落款日期", signed.cast("string"), "距今已", days.cast("string"), "天（超过3个月），要求供应商重新出具"))
        .when(signed.isNull(), F.lit("未识别到落款日期（需人工核验）"))]
    return fields, checks, issues


def signature_date(text: Column) -> Column:
    """Last labelled date that can be read, else the last date of the text."""
    labelled = F.array_compact(F.transform(find_all(text, fixed.SIGN_DATE, 1), last_date))
    return F.coalesce(F.try_element_at(labelled, F.lit(-1)), last_date(text))


def read_statement(docs: DataFrame) -> DataFrame:
    return prepared(docs).select(*docs.columns, signature_date(F.col("__t")).alias("signed"))


def check_statement(read: DataFrame, as_of: str) -> DataFrame:
    """X16."""
    return read.withColumn("result", outcome(*_statement_parts(F.lit(as_of).cast("date"))))


def read_after_sales(docs: DataFrame) -> DataFrame:
    n = F.col("__n")
    paper = (F.when(has_any(n, fixed.AFTER_SALES_CERT_MARKERS), "certificate")
             .when(has_any(n, fixed.AFTER_SALES_STATEMENT_MARKERS), "statement").otherwise("other"))
    return _packed(docs).select(*docs.columns, *_generic_read(), signature_date(F.col("__t")).alias("signed"), paper.alias("paper"))


def check_after_sales(read: DataFrame, as_of: str) -> DataFrame:
    """A certificate is judged by its validity, a statement by its signature."""
    day = F.lit(as_of).cast("date")
    paper = F.col("paper")
    cert, stmt = paper == "certificate", paper == "statement"

    def only(rows: list[tuple], when: Column) -> list[tuple]:
        return [(n, v, when & (p[0] if p else F.lit(True))) for n, v, *p in rows]

    cert_fields, cert_checks, cert_issues = _generic_parts(day)
    stmt_fields, stmt_checks, stmt_issues = _statement_parts(day)
    return read.withColumn("result", outcome(
        fields=[("材料类型", F.when(cert, "售后服务认证证书").when(stmt, "售后服务承诺函")),
                *only(cert_fields, cert), *only(stmt_fields, stmt)],
        checks=[("材料类型正确", cert | stmt), *only(cert_checks, cert), *only(stmt_checks, stmt)],
        issues=[F.when(cert, i) for i in cert_issues] + [F.when(stmt, i) for i in stmt_issues] + [
            F.when(paper == "other", F.lit(
                "上传材料未识别到售后服务认证或承诺内容，应提交售后服务五星认证或售后服务承诺函"))]))
