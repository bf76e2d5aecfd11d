"""Business licences: fields of the text and their comparison with the system record."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import fixed
from ...functions.dates import find_dates
from ...functions.numbers import float_text, licence_capital, short_number
from ...functions.ordering import computed_once
from ...functions.outcome import outcome, say
from ...functions.text import (
    blank, either_contains, find, find_all, fold_width, grab, has, join_labels, or_null, prepare_text,
    squeeze, swap, trim,
)


def company_name() -> Column:
    """Name the documents are compared with: the legal name, else the short one."""
    return squeeze(F.coalesce(or_null(F.col("full_name")), F.col("name")))


def _reversed_name(text: Column) -> Column:
    """Company at the end of a line whose last glyphs belong to a vertical name label."""
    lines = F.filter(F.split(text, "\n"), lambda line: has(line, fixed.REVERSED_NAME_LINE))

    def candidate(line: Column) -> Column:
        body = swap(F.btrim(line, F.lit(" \t　|。，,；;")), fixed.REVERSED_NAME_LINE, "")
        tokens = F.reverse(F.split(trim(body), r"(?U)\s+"))
        names = F.transform(tokens, lambda token: F.btrim(F.try_element_at(
            find_all(F.btrim(token, F.lit("()（） ")), fixed.COMPANY_TOKEN), F.lit(-1)), F.lit("()（） ")))
        return F.try_element_at(F.filter(
            names, lambda name: (F.length(name) >= 6) & ~name.isin(fixed.COMPANY_SUFFIXES)), F.lit(1))

    return F.try_element_at(F.array_compact(F.transform(lines, candidate)), F.lit(1))


def _legal_person(text: Column, value: Column) -> Column:
    """The labelled value without the debris of a neighbouring column."""
    cuts = "(?i)(?:" + "|".join(fixed.PERSON_CUTS) + r")[\s\S]*$"
    cleaned = F.btrim(swap(value, cuts, ""), F.lit(" \t" + fixed.VALUE_TRIM))
    cleaned = F.coalesce(find(cleaned, fixed.PERSON_DASH_NOISE), cleaned)
    cleaned = F.when(~squeeze(cleaned).isin(fixed.PERSON_NOT_NAMES), or_null(cleaned))
    below = find(text, fixed.PERSON_NEXT_LINE)
    return F.when(or_null(value).isNotNull(), F.coalesce(
        F.when(has(value, fixed.PERSON_RESIDENCE_NOISE), below), cleaned))


def _scope_of(text: Column) -> Column:
    """The whole scope paragraph up to the next field."""
    tail = find(text, fixed.SCOPE_LABEL + r"([\s\S]*)$")
    tail = swap(tail, "(?:" + fixed.SCOPE_END + r")[\s\S]*$", "")
    tail = swap(tail, fixed.SCOPE_INLINE_ADDRESS, " ")
    tail = swap(tail, fixed.SCOPE_TAIL_LABEL, "")
    return or_null(trim(swap(tail, fixed.SCOPE_NOTE_LINE, "", multiline=True)))


def read_licence(docs: DataFrame) -> DataFrame:
    """Text-only part: the fields of each licence."""
    text = swap(F.replace(join_labels(prepare_text(F.col("text"))), F.lit("名类称"), F.lit("名称")),
                r"^型(?=\s)", "类型", multiline=True)
    staged = docs.withColumn("__t", text)
    t = F.col("__t")
    staged = staged.withColumn("__person", grab(t, ["法定代表人"], fixed.VALUE_60))
    term = find(t, fixed.TERM)
    unbounded = has(F.regexp_extract(blank(F.col("text")), fixed.RAW_TERM, 0), fixed.STARS)
    return staged.select(
        *docs.columns,
        F.upper(F.coalesce(find(t, fixed.CREDIT_CODE), find(t, fixed.BARE_CREDIT_CODE))).alias("code"),
        F.coalesce(grab(t, ["名称"], fixed.VALUE_60), _reversed_name(t)).alias("company"),
        _legal_person(t, F.col("__person")).alias("person"),
        F.regexp_extract(t, fixed.PERSON_WINDOW, 0).alias("person_window"),
        grab(t, ["住所"], fixed.VALUE_120).alias("address"),
        licence_capital(t).alias("capital"),
        _scope_of(t).alias("scope"),
        term.alias("term"),
        (unbounded | has(term, fixed.LONG_TERM)).alias("term_unbounded"),
        find_dates(blank(term)).alias("term_dates"),
    )


def scope_items(scope: Column) -> Column:
    """Business items of a scope text, without layout, legal notes and letter case.

    Separators inside brackets belong to an item. The text is cut at brackets and
    folded with the depth as state; punctuation inside brackets is simply dropped.
    """
    text = swap(fold_width(blank(scope)), r"\s+", "")
    text = F.regexp_replace(F.regexp_replace(text, fixed.SCOPE_LEGAL_NOTE, ""), fixed.SCOPE_GROUP_HEAD, ";")
    parts = F.split(text, r"(?=[()])")

    def step(acc: Column, part: Column) -> Column:
        depth = (F.when(part.startswith("("), acc["depth"] + 1)
                 .when(part.startswith(")"), F.greatest(acc["depth"] - 1, F.lit(0)))
                 .otherwise(acc["depth"]))
        kept = F.when(depth > 0, F.regexp_replace(part, "[;:。；：]", "")).otherwise(part)
        return F.struct(depth.alias("depth"), F.concat(acc["text"], kept).alias("text"))

    flat = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step,
                       lambda acc: acc["text"])
    items = F.transform(F.split(flat, "[;:。；：]"), lambda item: F.lower(swap(item, r"[^\w]", "")))
    return F.array_distinct(F.filter(items, lambda item: item != ""))


SIMILARITY = T.StructType([
    T.StructField("ratio", T.DoubleType()), T.StructField("two", T.StringType()), T.StructField("whole", T.StringType())])


@lru_cache(maxsize=1 << 16)
def _similar(a: str, b: str) -> tuple[float, str, str]:
    ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
    return ratio, f"{ratio:.2%}", f"{ratio:.0%}"


@F.pandas_udf(SIMILARITY)
def similarity(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Share of matching blocks, only where both sides are given; a worker works out a pair that comes again once."""
    rows = [(None, None, None) if a is None or b is None else _similar(a, b) for a, b in zip(left, right)]
    return pd.DataFrame(rows, columns=["ratio", "two", "whole"])


def decided_ratio(a: Column, b: Column) -> Column:
    """The share of matching blocks of two different texts where it needs no matching, else null.

    If one text stands inside the other, the first block is all of it and nothing is left to match: twice its length over both
    lengths. Texts without a common character have no block: zero.
    """
    shorter, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    apart = ~F.arrays_overlap(F.split(a, ""), F.split(b, ""))
    return (F.when(either_contains(a, b), F.lit(2.0) * shorter / both)
            .when(apart, F.lit(0.0)))


def percent_of(ratio: Column, places: int) -> Column:
    """A share as percent, ties to even as the similarity writes them."""
    exact = (ratio * 100).cast("decimal(20,10)")
    return F.concat(F.bround(exact, places).cast(f"decimal(12,{places})").cast("string"), F.lit("%"))


def compare_scope(read: DataFrame) -> DataFrame:
    """Adds `scope_state` (ok / note / open / no), its issue, similarity and differences.

    Equal texts, texts of which one holds the other, and texts without a common character are decided in generated code. The share that is
    reported is exact, so a bound of it decides nothing more: the pairs that are left are matched in Python; all other rows
    carry nulls there.
    """
    doc, system = squeeze(F.col("scope")), squeeze(F.col("busi_scope"))
    general = doc.contains("具体经营项目") & (doc.contains("公示系统") | F.lower(doc).contains("gsxt"))
    state = (F.when((F.length(doc) < 4) | doc.isin(fixed.SCOPE_NOT_TEXT), "unread")
             .when(system == "", "no_system").when(general, "general").otherwise("compare"))
    staged = read.withColumn("__state", state)
    compared = F.col("__state") == "compare"
    sides = computed_once(staged, F.struct(
        F.when(compared, scope_items(doc)).alias("doc"), F.when(compared, scope_items(system)).alias("sys")), "__items")
    joined = computed_once(sides, F.struct(
        F.array_join("__items.doc", "").alias("a"), F.array_join("__items.sys", "").alias("b"),
        F.array_except("__items.doc", "__items.sys").alias("doc_only"), F.array_except("__items.sys", "__items.doc").alias("sys_only")), "__x")
    a, b = F.col("__x.a"), F.col("__x.b")
    # equal texts need no matching; sets that are equal in another order still report their share
    unequal = compared & (a != b)
    decided = F.when(compared & (a == b), F.lit(1.0)).when(unequal, decided_ratio(a, b))
    staged = joined.select(
        *staged.columns, F.col("__items.doc").alias("__doc"), F.col("__items.sys").alias("__sys"), a.alias("__a"), b.alias("__b"),
        F.col("__x.doc_only").alias("__doc_only"), F.col("__x.sys_only").alias("__sys_only"), decided.alias("__decided"))
    open_ = compared & F.col("__decided").isNull()
    staged = (staged.withColumn("__same", compared & (F.size("__doc") > 0) & (F.size("__sys") > 0)
                                & (F.size("__doc_only") == 0) & (F.size("__sys_only") == 0))
              .withColumn("__sim", similarity(F.when(open_, F.col("__a")), F.when(open_, F.col("__b")))))
    known = F.col("__decided").isNotNull()
    ratio = F.coalesce("__decided", F.col("__sim.ratio"))
    two = F.when(known, percent_of(F.col("__decided"), 2)).otherwise(F.col("__sim.two"))
    whole = F.when(known, percent_of(F.col("__decided"), 0)).otherwise(F.col("__sim.whole"))
    shorter = F.least(F.length("__a"), F.length("__b"))
    longer = F.greatest(F.length("__a"), F.length("__b"))
    verdict = (
        F.when(~compared, F.col("__state")).when(F.col("__same") | (ratio >= fixed.SCOPE_SAME), "same")
        .when(shorter < longer * fixed.SCOPE_LENGTH, "short")
        .when(ratio >= fixed.SCOPE_SIMILAR, "similar").otherwise("different"))
    differences = F.concat_ws(
        "；",
        F.when(F.size("__sys_only") > 0, say("仅系统含：", F.array_join("__sys_only", "、"))),
        F.when(F.size("__doc_only") > 0, say("仅执照OCR含：", F.array_join("__doc_only", "、"))))
    issue = (
        F.when(verdict == "unread", "经营范围提取不完整，需人工核验；不据此判定与系统不一致")
        .when(verdict == "no_system", "系统基本信息栏经营范围缺失，需人工核验")
        .when(verdict == "general", "执照为概括式经营范围（新版执照样式），无法与系统填写逐项比对，需人工核验")
        .when(verdict == "short", say("经营范围文本长度差异较大，可能提取不完整（相似度", whole, "），需人工核验"))
        .when(verdict == "similar", say("执照经营范围与系统填写高度相似但有差异（相似度", whole, "），需人工确认：",
                                        differences))
        .when(verdict == "different", say("执照经营范围与系统基本信息栏填写不一致（相似度", whole, "）")))
    return staged.select(
        *read.columns, verdict.alias("scope_state"), issue.alias("scope_issue"), two.alias("scope_similarity"),
        F.when(verdict == "similar", differences).alias("scope_differences"),
        F.when(verdict == "same", True).when(verdict == "different", False).alias("scope_check"))


def check_licence(read: DataFrame, as_of: str) -> DataFrame:
    """`result` of each licence row that carries its supplier's columns."""
    day = F.lit(as_of).cast("date")
    staged = compare_scope(read)
    expected = trim(blank(F.col("legal_person")))
    seen = (expected != "") & squeeze(F.col("person_window")).contains(squeeze(expected))
    staged = staged.withColumn("__person", F.coalesce("person", F.when(seen, expected)))
    code, system_code = F.upper(squeeze(F.col("code"))), F.upper(squeeze(F.col("social_credit_code")))
    name, system_name = squeeze(F.col("company")), company_name()
    person, system_person = squeeze(F.col("__person")), squeeze(F.col("legal_person"))
    capital, system_capital = F.col("capital"), F.coalesce("registered_capital", F.lit(0.0))
    both_code = (code != "") & (system_code != "")
    both_name = (name != "") & (F.length(system_name) > 4)
    both_person = (person != "") & (system_person != "")
    both_capital = F.coalesce(capital != 0, F.lit(False)) & (system_capital != 0)
    name_ok = either_contains(name, system_name)
    capital_ok = F.abs(capital - system_capital) / F.greatest(system_capital, F.lit(1.0)) <= 0.01
    dates = F.col("term_dates")
    half_range = (F.size(dates) == 1) & F.col("term").rlike("至|到")
    until = F.when((F.size(dates) > 0) & ~half_range, F.array_max(dates))
    term_known = F.col("term").isNotNull() & (F.col("term_unbounded") | until.isNotNull())
    term_ok = F.col("term_unbounded") | (until >= day)
    nothing = F.coalesce("code", "company", "__person", "address", F.when(capital != 0, "1")).isNull()
    lacking = F.array_join(F.array_compact(F.array(
        F.when(F.col("company").isNull(), F.lit("名称")),
        F.when(F.col("__person").isNull(), F.lit("法定代表人")),
        F.when(F.coalesce(capital, F.lit(0.0)) == 0, F.lit("注册资本")),
        F.when(F.col("scope").isNull(), F.lit("经营范围")))), "、")
    result = outcome(
        fields=[
            ("统一社会信用代码", F.col("code")), ("名称", F.col("company")), ("法定代表人", F.col("__person")),
            ("住所", F.col("address")), ("注册资本_万", float_text(capital)), ("经营范围", F.col("scope")),
            ("经营范围相似度", F.col("scope_similarity"), F.col("scope_similarity").isNotNull()),
            ("经营范围差异", F.col("scope_differences"), F.col("scope_differences").isNotNull()),
        ],
        checks=[
            ("信用代码一致", code == system_code, both_code),
            ("名称一致", name_ok, both_name),
            ("法人一致", person == system_person, both_person),
            ("注册资本一致", capital_ok, both_capital),
            ("营业期限长期或有效", term_ok, term_known),
            ("经营范围一致", F.col("scope_check")),
        ],
        issues=[
            F.when(nothing, F.lit("营业执照未能识别关键字段（需人工核验扫描件清晰度）")),
            F.when(both_code & (code != system_code), say("执照信用代码", code, "与系统", system_code, "不一致")),
            F.when(both_name & ~name_ok, say("执照名称「", name, "」与系统「", system_name, "」不一致")),
            F.when(both_person & (person != system_person),
                   say("执照法人", person, "与系统", system_person, "不一致")),
            F.when(both_capital & ~capital_ok, say(
                "执照注册资本", short_number(capital), "万与系统", short_number(system_capital), "万不一致")),
            F.when(term_known & ~term_ok, say("营业执照营业期限已到期（", until.cast("string"), "）")),
            F.col("scope_issue"),
            F.when(lacking != "", say(
                "营业执照识别不完整，缺少字段：", lacking, "（需人工核验扫描件清晰度，或改用企查查比对）")),
        ],
    )
    return staged.withColumn("result", result)
