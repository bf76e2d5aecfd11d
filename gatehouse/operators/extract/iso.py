"""Management-system certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.dates import term_text, valid_until
from ...functions.outcome import outcome, say
from ...functions.text import (
    blank, either_contains, find, find_all, has, prepared, rx, squeeze, trim_value,
)
from .licence import company_name

_LINE = r"^\s*(" + fixed.ISO_COMPANY + r")\s*$"
_LINE_AHEAD = _LINE + r"(?=([\s\S]{0,240}))"


def _standalone(text: Column) -> Column:
    """Lines that are just an organisation: (name, heads a certificate title)."""
    names = find_all(text, _LINE_AHEAD, 1, multiline=True)
    ahead = find_all(text, _LINE_AHEAD, 2, multiline=True)

    def row(name: Column, after: Column) -> Column:
        title = F.regexp_instr(after, F.lit(rx(fixed.ISO_TITLE)))
        other = F.regexp_instr(after, F.lit(rx(_LINE, multiline=True)))
        return F.struct(trim_value(name).alias("name"),
                        ((title > 0) & ((other == 0) | (title < other))).alias("heads_title"))

    return F.zip_with(names, ahead, row)


def _labelled(text: Column, label: str) -> Column:
    return trim_value(find(text, rf"^\s*{label}\s*[:：]\s*({fixed.ISO_COMPANY})\s*$", multiline=True))


def _plain(name: Column) -> Column:
    return F.when(~has(name, fixed.ISO_OBLIGATION), name)


def iso_holder(text: Column, lines: Column) -> Column:
    """struct(name, origin): declaration, recognition sentence, label, else first plain line."""
    declared = trim_value(find(text, fixed.ISO_DECLARED))
    recognised = trim_value(find(text, fixed.ISO_RECOGNISED))
    guesses = F.filter(lines, lambda r: ~r["heads_title"] & ~has(r["name"], fixed.ISO_OBLIGATION))
    options = [(declared, "兹证明"), (recognised, "我公司认定下列组织")]
    options += [(_plain(_labelled(text, label)), label) for label in fixed.ISO_HOLDER_LABELS]
    options.append((F.try_element_at(guesses, F.lit(1))["name"], "证书版面推断（无标签）"))
    return F.coalesce(*[
        F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(origin).alias("origin")))
        for name, origin in options])


def certification_body(text: Column, lines: Column, holder: Column) -> Column:
    headers = F.filter(lines, lambda r: r["heads_title"] & (squeeze(r["name"]) != squeeze(holder)))
    return F.coalesce(*[_labelled(text, label) for label in fixed.ISO_BODY_LABELS],
                      F.try_element_at(headers, F.lit(1))["name"])


def read_iso(docs: DataFrame) -> DataFrame:
    staged = prepared(docs)
    t = F.col("__t")
    staged = staged.withColumn("__lines", _standalone(t))
    staged = staged.withColumn("__holder", iso_holder(t, F.col("__lines")))
    code = F.substring("doc_type", 4, 5)
    staged = staged.withColumn("__n", F.when(t.isNotNull(), squeeze(t)))
    packed = F.col("__n")
    marker = F.coalesce(*[F.when(F.col("doc_type") == kind, F.lit(word))
                          for kind, word in fixed.ISO_MARKERS.items()])
    # the number must not continue with another digit
    numbered = F.coalesce(*[F.when(F.col("doc_type") == kind, has(packed, rf"(?i){kind.upper()}(?!\d)"))
                            for kind in fixed.ISO_TYPES])
    return staged.select(
        *docs.columns, code.alias("iso_code"),
        F.col("__holder.name").alias("holder"), F.col("__holder.origin").alias("holder_origin"),
        certification_body(t, F.col("__lines"), blank(F.col("__holder.name"))).alias("body"),
        find(t, fixed.ISO_NUMBER).alias("number"), find(t, fixed.ISO_STATE).alias("state"),
        valid_until(t).alias("until"),
        (numbered | F.coalesce(packed.contains(marker), F.when(marker.isNotNull(), F.lit(False)))).alias("type_seen"))


def check_iso(read: DataFrame, as_of: str) -> DataFrame:
    """X11: a certificate with under 90 days to run stays valid but raises an issue."""
    day = F.lit(as_of).cast("date")
    holder, system = squeeze(F.col("holder")), company_name()
    title = F.concat(F.lit("ISO"), F.col("iso_code"))
    comparable = (holder != "") & (F.length(system) > 4)
    same = either_contains(holder, system)
    until, longterm = F.col("until.date"), F.col("until.longterm")
    days = F.datediff(until, day)
    state = F.col("state")
    result = outcome(
        fields=[
            ("获证组织", F.col("holder")),
            ("获证组织_来源", F.col("holder_origin"), F.col("holder_origin").isNotNull()),
            ("认证机构", F.col("body"), F.col("body").isNotNull()),
            ("证书编号", F.col("number")), ("有效期至", term_text(F.col("until"))), ("证书状态", state),
        ],
        checks=[
            ("材料类型正确", F.when(F.col("type_seen"), True)),
            ("持有人一致", same, comparable),
            ("证书状态有效", state == "有效", state.isNotNull()),
            ("在有效期内", longterm | (days >= 0), longterm | until.isNotNull()),
        ],
        issues=[
            F.when(~F.col("type_seen"), say(
                "未确认", title, "证书类型，需人工核验；文件名及上传位置不能作为通过依据")),
            F.when(comparable & ~same, say(
                title, "证书持有人「", holder, "」与供应商「", system, "」不一致（贸易商代理厂家认证时需人工确认授权链）")),
            F.when(state != "有效", say(title, "证书状态为「", state, "」")),
            F.when(days < 0, say(title, "证书已过期（", until.cast("string"), "）"))
            .when(days < fixed.ISO_REMINDER_DAYS, say(
                title, "证书将于", until.cast("string"), "到期（90天内，提醒续证）")),
            F.when(~longterm & until.isNull(), say(title, "证书未识别到有效期（需人工核验）")),
        ],
    )
    return read.withColumn("result", result)
