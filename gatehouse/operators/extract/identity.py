"""Identity cards: name and validity only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.dates import as_date
from ...functions.ordering import computed_once
from ...functions.outcome import outcome, say, unknown
from ...functions.text import blank, find, has, name_close, or_null, prepared, squeeze


def _result(name: Column, readable: Column, longterm: Column, until: Column, as_of: str) -> Column:
    """Checks shared by both sources of card fields."""
    day = F.lit(as_of).cast("date")
    person = squeeze(F.col("legal_person"))
    has_name, has_term = F.coalesce(name != "", F.lit(False)), F.coalesce(readable, F.lit(False))
    known = has_name & (person != "")
    close = name_close(name, person)
    return outcome(
        fields=[("姓名", name),
                ("有效期至", F.when(longterm, F.lit("长期")).otherwise(until.cast("string")))],
        checks=[
            ("正反面齐全", F.when(has_name & has_term, True).when(~has_name & ~has_term, False)),
            ("姓名与法人一致", F.when(name == person, True).when(~close, False), known),
            ("在有效期内", longterm | (until >= day), longterm | until.isNotNull()),
        ],
        issues=[
            F.when(~has_name & ~has_term, F.lit("身份证正反面均未能识别，请确认是否上传了完整的身份证正反面")),
            F.when(~has_name & has_term, F.lit("身份证正面（姓名）未能识别，需人工核验是否缺面或图片不清晰")),
            F.when(has_name & ~has_term, F.lit("身份证背面（有效期限）未能识别，需人工核验是否缺面或图片不清晰")),
            F.when(known & (name != person), F.when(close, say(
                "身份证姓名「", name, "」与系统法人「", person, "」仅差1字，疑似OCR识别误差，需人工复核"
            )).otherwise(say("身份证姓名「", name, "」与系统法人「", person, "」不一致"))),
            F.when(~longterm & (until < day), say("身份证已过期（", until.cast("string"), "）")),
        ],
    )


def card_fields(cards: DataFrame) -> DataFrame:
    """Name of the last front and validity of the last back of each document."""
    place = F.struct(F.coalesce("page", F.lit(0)), "card_index")
    front = (F.col("side") == "front") & (F.col("name") != "")
    back = (F.col("side") == "back") & (F.col("valid_until") != "")
    return cards.groupBy("todo_id", "doc_id", "file").agg(
        F.max_by("name", F.when(front, place)).alias("card_name"),
        F.max_by("valid_until", F.when(back, place)).alias("card_term"))


def idcard_checks(cards: DataFrame, suppliers: DataFrame, as_of: str) -> DataFrame:
    """Result of each document from its card rows."""
    term = F.col("card_term")
    longterm = F.coalesce(term.contains("长期") | term.contains("永久"), F.lit(False))
    found = F.concat(*[F.regexp_extract_all(blank(term), F.lit(p), F.lit(0)) for p in fixed.CARD_DATES])
    # '203601.14' and the like: the separator after the year was lost
    days = F.array_compact(F.transform(found, lambda x: as_date(
        F.regexp_replace(x, r"^(\d{4})(\d{2})([.\-/])", "$1-$2$3"))))
    until = F.when(~longterm, F.array_max(days))
    # the term is read before the join, once per document, and the result is made once, however many of its checks are asked for
    fields = card_fields(cards)
    read = computed_once(fields, F.struct(longterm.alias("longterm"), until.alias("until")), "__term")
    rows = read.join(suppliers, "todo_id", "left")
    found = _result(F.col("card_name"), term.isNotNull(), F.col("__term.longterm"), F.col("__term.until"), as_of)
    return computed_once(rows, found, "result").drop("__term")


def read_idcard_text(docs: DataFrame) -> DataFrame:
    staged = prepared(docs)
    staged = staged.withColumn("__n", F.when(F.col("__t").isNotNull(), squeeze(F.col("__t"))))
    text, packed = F.col("__t"), F.col("__n")
    end = find(text, fixed.ID_RANGE, 4)
    longterm = packed.contains("有效期限") & has(packed, fixed.LONG_TERM)
    longterm = longterm | F.coalesce(end.rlike(fixed.LONG_TERM), F.lit(False))
    labelled = F.concat(*[part for g in (1, 2, 3) for part in (F.lit("-"), find(packed, fixed.ID_UNTIL, g))])
    until = F.coalesce(as_date(end), as_date(labelled))
    return staged.select(
        *docs.columns, find(text, fixed.ID_NAME).alias("card_name"), longterm.alias("longterm"),
        F.when(~longterm, until).alias("until"))


def idcard_text_checks(read: DataFrame, as_of: str) -> DataFrame:
    """The same checks from text lines."""
    longterm, until = F.col("longterm"), F.col("until")
    return read.withColumn("result", _result(
        F.col("card_name"), longterm | until.isNotNull(), longterm, until, as_of))


def failed_card(reason: Column) -> Column:
    """Result of an identity card that could not be read."""
    return outcome(
        fields=[("姓名", F.lit(None)), ("有效期至", F.lit(None))],
        checks=[("正反面齐全", unknown())],
        issues=[say("身份证打码识别失败：", reason, "（转人工核验，请供应商确认身份证格式/清晰度）")])


def keep_allowed_fields(text: Column) -> Column:
    """Only the name and the validity survive."""
    name = find(text, fixed.ID_KEEP_NAME)
    term = find(text, fixed.ID_KEEP_TERM)
    return or_null(F.concat_ws(" ", say("姓名 ", name), say("有效期限 ", term)))
