"""Confidence review of local readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.outcome import say
from ...functions.text import has_any, squeeze

CHECK = "OCR文字置信度充足"


def confidence_review(extractions: DataFrame, lines: DataFrame) -> DataFrame:
    """Any low or unscored line makes the check unknown.

    For management-system certificates only the lines that carry the evidence
    count, each by its best score. Lines are folded per document in one partial
    aggregate, so a document of any length costs a handful of numbers.
    """
    kind = F.col("doc_type")
    is_iso = kind.isin(fixed.ISO_TYPES)
    evidence = extractions.select(
        "doc_id", "doc_type",
        F.when(F.col("checks")["材料类型正确"], F.coalesce(*[
            F.when(kind == t, F.lit(word)) for t, word in fixed.ISO_MARKERS.items()])).alias("__marker"),
        F.when(F.col("checks")["材料类型正确"], F.upper(kind)).alias("__number"),
        F.when(F.col("checks")["持有人一致"], F.nullif(squeeze(F.col("fields")["获证组织"]), F.lit(""))).alias("__holder"),
        F.when(F.col("checks")["在有效期内"], F.col("fields")["有效期至"]).alias("__until"))
    text = squeeze(F.col("text"))
    digits = F.regexp_replace(text, r"\D", "")
    score = F.col("confidence")
    is_type = F.upper(text).contains(F.col("__number")) | text.contains(F.col("__marker"))
    is_holder = text.contains(F.col("__holder"))
    is_term = F.when(F.col("__until") == "长期", has_any(text, ["长期", "永久", "无固定期限"])).otherwise(
        digits.contains(F.regexp_replace("__until", r"\D", "")))
    folded = (lines.join(evidence, "doc_id").groupBy("doc_id", "doc_type").agg(
        F.bool_or(F.coalesce(score < fixed.CONFIDENCE_FLOOR, F.lit(True))).alias("__low"),
        F.max(F.when(is_type, score)).alias("__type"),
        F.max(F.when(is_holder, score)).alias("__owner"),
        F.max(F.when(is_term, score)).alias("__term")))
    rows = (extractions.join(folded, ["doc_id", "doc_type"], "left")
            .join(evidence.drop("__number"), ["doc_id", "doc_type"], "left"))

    def problem(label: str, asked: Column, best: Column) -> Column:
        return F.when(asked.isNotNull(), F.when(best.isNull(), F.lit(f"{label}缺少OCR置信度")).when(
            best < fixed.CONFIDENCE_FLOOR, say(f"{label}文字置信度较低（", F.format_string("%.2f", best), "）")))

    asked = F.coalesce("__marker", "__holder", "__until").isNotNull()
    problems = F.array_compact(F.array(
        problem("证书类型", F.col("__marker"), F.col("__type")),
        problem("获证组织", F.col("__holder"), F.col("__owner")),
        problem("有效期", F.col("__until"), F.col("__term"))))
    unread = F.col("__low").isNull()
    issue = (
        F.when(unread, F.lit("OCR置信度明细缺失，转人工核验"))
        .when(~is_iso & F.col("__low"), F.lit("存在低置信度或缺失置信度文字，转人工核验"))
        .when(is_iso & (F.size(problems) > 0), say(
            "ISO关键字段", F.array_join(problems, "、"), "，转人工核验")))
    good = is_iso & ~unread & asked & (F.size(problems) == 0)
    entry = F.when(issue.isNotNull(), F.create_map(F.lit(CHECK), F.lit(None).cast("boolean"))).when(
        good, F.create_map(F.lit(CHECK), F.lit(True)))
    base = F.coalesce("checks", F.create_map().cast("map<string,boolean>"))
    return rows.select(*[
        F.when(entry.isNotNull(), F.map_concat(F.map_filter(base, lambda k, v: k != CHECK), entry))
        .otherwise(base).alias("checks") if c == "checks" else
        F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.array_compact(F.array(issue))).alias("issues")
        if c == "issues" else F.col(c) for c in extractions.columns])


def confidence_distribution(minimums: DataFrame, value: str = "min_confidence") -> DataFrame:
    """Upper median of the per-document minimum and counts below the marks.

    The result is stated to four decimals, so documents are counted per rounded
    value first: at most ten thousand rows meet for the median.
    """
    from pyspark.sql import Window

    per_value = minimums.groupBy(F.round(value, 4).alias("v")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(value) < 0.7).alias("b70"), F.count_if(F.col(value) < 0.8).alias("b80"),
        F.count_if(F.col(value) < 0.9).alias("b90"))
    total = per_value.agg(F.sum("n").alias("total"), F.sum("b70").alias("documents_below_0_70"),
                          F.sum("b80").alias("documents_below_0_80"), F.sum("b90").alias("documents_below_0_90"))
    # a window over the (bounded) values, never over the documents
    running = per_value.select("v", F.sum("n").over(
        Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    return (running.join(F.broadcast(total), running.upto > F.floor(total.total / 2))
            .groupBy("total", "documents_below_0_70", "documents_below_0_80", "documents_below_0_90")
            .agg(F.min("v").alias("document_minimum_median"))
            .select(F.col("total").alias("documents"), "document_minimum_median",
                    "documents_below_0_70", "documents_below_0_80", "documents_below_0_90"))
