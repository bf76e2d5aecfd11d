"""Financial reports: title years of uploads and periods in public data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import blank, find_all, has, has_any


def is_financial() -> Column:
    typed = F.array_contains(F.coalesce("types", F.array().cast("array<string>")), "financial_report")
    words = F.concat_ws(" ", blank(F.col("file_name")), blank(F.col("type_name")))
    return typed | has_any(words, fixed.FINANCIAL_TITLE)


def title_text() -> Column:
    return F.concat_ws(" ", *[blank(F.col(c)) for c in (
        "file_name", "file_title", "file_desc", "file_summ", "remark")])


FIRST_YEAR = 2000


def year_bits(financial: Column) -> tuple[Column, Column]:
    """Years 2000-2099 in the title as two bit sets, so that they combine as numbers."""
    years = F.when(financial, find_all(title_text(), fixed.TITLE_YEAR, 1))

    def bits(first: int, last: int) -> Column:
        return F.aggregate(years, F.lit(0).cast("bigint"), lambda acc, y: F.when(
            y.cast("int").between(first, last), acc.bitwiseOR(F.call_function(
                "shiftleft", F.lit(1).cast("bigint"), y.cast("int") - first))).otherwise(acc))

    any_year = financial & has(title_text(), fixed.TITLE_YEAR)
    zero = F.lit(0).cast("bigint")
    return (F.when(any_year, bits(FIRST_YEAR, FIRST_YEAR + 59)).otherwise(zero),
            F.when(any_year, bits(FIRST_YEAR + 60, FIRST_YEAR + 99)).otherwise(zero))


def years_of(low: Column, high: Column) -> Column:
    def members(bits: Column, first: int, count: int) -> Column:
        return F.filter(F.sequence(F.lit(first), F.lit(first + count - 1)), lambda y: F.getbit(bits, y - first) == 1)

    none = F.array().cast("array<int>")
    return (F.when((low == 0) & (high == 0), none)
            .otherwise(F.concat(members(low, FIRST_YEAR, 60), members(high, FIRST_YEAR + 60, 40))))


def title_years(mats: DataFrame) -> DataFrame:
    """Years in the titles of each request's financial uploads, and whether there are any uploads."""
    low, high = year_bits(is_financial())
    rolled = mats.groupBy("todo_id").agg(
        F.bool_or(is_financial()).alias("submitted"), F.bit_or(low).alias("low"), F.bit_or(high).alias("high"))
    return rolled.select("todo_id", "submitted", years_of(F.col("low"), F.col("high")).alias("title_years"))


def year_status(submitted: Column, years: Column, as_of: Column) -> Column:
    """K4: matched / mismatch / unknown / missing; unknown too where it is not known whether a report was uploaded."""
    required = F.year(as_of) - 1
    return (F.when(submitted.isNull(), "unknown").when(~submitted, "missing").when(F.array_contains(years, required), "matched")
            .when(F.size(years) > 0, "mismatch").otherwise("unknown"))


def financial_title_check(mats: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """K4 for every request. An empty list of uploads means: not submitted.

    Where `requests` say with `has_list` whether a list has landed, a request without one keeps what its profile
    states in `has_financial_report`, and null, not known, where it states nothing.
    """
    day = F.lit(as_of).cast("date")
    listed = F.col("has_list") if "has_list" in requests.columns else F.lit(True)
    stated = F.col("has_financial_report") if "has_financial_report" in requests.columns else F.lit(None).cast("boolean")
    known = requests.select("todo_id", listed.alias("__listed"), stated.alias("__stated"))
    checked = known.join(title_years(mats), "todo_id", "left").select(
        "todo_id", F.coalesce("submitted", F.when(F.col("__listed"), False).otherwise(F.col("__stated"))).alias("submitted"),
        F.coalesce("title_years", F.array().cast("array<int>")).alias("title_years"))
    return checked.select(
        "*", (F.year(day) - 1).alias("required_year"),
        year_status(F.col("submitted"), F.col("title_years"), day).alias("status"))


#: How deep objects may be nested in a registry payload; a deeper one is an error.
PAYLOAD_DEPTH = 8
_OBJECT = r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'


def report_periods(payload: Column) -> Column:
    """Reporting periods stated anywhere in a nested JSON payload, sorted.

    Each object gives the first of its own keys in PERIOD_KEYS that is not empty. Objects are taken from the inside out, a
    level at a time; a payload nested deeper than PAYLOAD_DEPTH raises an error, and text that is no JSON has no periods.
    """
    # braces inside strings would look like objects, so strings lose them
    tokens = F.regexp_extract_all(blank(payload), F.lit(r'"(?:[^"\\]|\\.)*"|[^"]+'), F.lit(0))
    text = F.array_join(F.transform(tokens, lambda t: F.when(t.startswith('"'), F.translate(t, "{}", "")).otherwise(t)), "")
    text = F.when(F.try_parse_json(payload).isNotNull(), text).otherwise("")

    def period(item: Column) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(item, rf'"{key}"\s*:\s*"?([^",}}\]]*)', 1)), F.lit("")) for key in fixed.PERIOD_KEYS])

    def stated(value: Column) -> Column:
        return F.nullif(F.nullif(value, F.lit("null")), F.lit(""))

    found = F.array().cast("array<string>")
    for _ in range(PAYLOAD_DEPTH):
        found = F.concat(found, F.transform(F.regexp_extract_all(text, F.lit(_OBJECT), F.lit(0)), lambda o: stated(period(o))))
        text = F.regexp_replace(text, _OBJECT, "0")
    deep = F.when(text.contains("{"), F.raise_error(F.lit(f"payload nested deeper than {PAYLOAD_DEPTH}")).cast("array<string>"))
    return F.coalesce(deep, F.array_sort(F.array_distinct(F.array_compact(found))))


def assessment_detail(periods: Column, submitted: Column, as_of: Column) -> Column:
    """K5: wording of the assessment; public data never prove an audited report."""
    manual = "公开财务数据不能证明上传财报已经审计；转人工核验上年度经审计财报。"
    required = (F.year(as_of) - 1).cast("string")
    detail = (
        F.when(F.size(periods) == 0, F.lit("未取得带报告期的公开财务数据；" + manual))
        .when(~F.exists(periods, lambda p: p.startswith(required)), F.concat(
            F.lit("公开数据非上年度，报告期："), F.array_join(periods, "、"), F.lit("；" + manual)))
        .otherwise("已取得上年度公开财务数据，仍需核对三表完整性及审计意见；" + manual))
    return (F.when(submitted.isNull(), F.concat(F.lit("财报上传状态未确认；"), detail))
            .when(~submitted, F.lit("缺少经审计的上年度财报；请补交后转人工核查年度、三表完整性及审计意见；"
                                    "公开财务数据不能替代应上传的经审计财报。"))
            .otherwise(detail))


def assess_financial(registry: DataFrame, as_of: str) -> DataFrame:
    """K5 per registry record (column `financial`, optional boolean `submitted`)."""
    day = F.lit(as_of).cast("date")
    submitted = F.col("submitted") if "submitted" in registry.columns else F.lit(None).cast("boolean")
    periods = report_periods(F.col("financial"))
    return registry.select("*", periods.alias("periods"),
                           assessment_detail(periods, submitted, day).alias("assessment"))
