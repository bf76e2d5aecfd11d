"""What may leave the house: allow-list masking and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ordering import computed_once
from ..functions.outcome import say
from ..functions.text import blank, has, has_any, strip_comments
from .classify import is_sensitive, match_files
from .extract.identity import keep_allowed_fields


def public_flag(types: Column, name: Column, public: list[str] | None = None,
                sensitive: str | None = None) -> Column:
    """Some type, all of them public, and no sensitive word in the name."""
    public = fixed.PUBLIC_TYPES if public is None else public
    allowed = F.array(*[F.lit(kind) for kind in public])
    return ((F.size(types) > 0) & (F.size(F.array_except(types, allowed)) == 0)
            & ~(is_sensitive(blank(name)) if sensitive is None else has(blank(name), sensitive)))


def with_public_flag(df: DataFrame, types: str = "types", name: str = "file") -> DataFrame:
    return df.withColumn("is_public", public_flag(F.col(types), F.col(name)))


def looks_like_id_card(name: Column) -> Column:
    """P20: a bare person name as image name, without any material word."""
    return ~has_any(name, fixed.NOT_ID_CARD_WORDS) & has(name, fixed.PERSON_IMAGE_NAME)


def mask_documents(docs: DataFrame) -> DataFrame:
    """An identity card keeps name and validity only; other texts stay as they are."""
    card = F.col("doc_type") == "legal_person_id"
    kept = keep_allowed_fields(strip_comments(F.col("text")))
    return docs.withColumn("text", F.when(card, blank(kept)).otherwise(F.col("text")))


def mask_patterns(docs: DataFrame, patterns: list[tuple[str, ...]], column: str = "text") -> DataFrame:
    """The same job for free text: every pattern is replaced by its mark.

    A pattern may come with a piece of text that each of its matches holds: texts without it are not searched.
    """
    for pattern, mark, *held in patterns:
        text = F.col(column)
        masked = F.regexp_replace(text, pattern, mark)
        docs = docs.withColumn(column, F.when(text.contains(held[0]), masked).otherwise(text) if held else masked)
    return docs


def public_subset(files: DataFrame, mats: DataFrame) -> DataFrame:
    """Files that pass type matching and the gate.

    The flag is worked out once per file: a filter on it would otherwise go down to the uploads, word by word, with the making of their names.
    """
    matched = match_files(files, mats)
    return computed_once(matched, public_flag(F.col("types"), F.col("file")), "is_public").filter("is_public")


def mask_outcomes(files: DataFrame, cards: DataFrame, mats: DataFrame) -> DataFrame:
    """D3: per identity-card file: read, unsupported format, or no result, with the reason."""
    typed = match_files(files, mats)
    is_card = F.array_contains("types", "legal_person_id") | has_any(
        F.lower("file"), fixed.ID_CARD_NAME_WORDS)
    suffix = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    found = cards.groupBy("todo_id", "file").agg(F.count(F.lit(1)).alias("cards"))
    joined = typed.filter(is_card).join(found, ["todo_id", "file"], "left")
    supported = suffix.isin(fixed.ID_CARD_EXTENSIONS)
    outcome = F.when(~supported, "unsupported").when(F.col("cards") > 0, "cards").otherwise("no_result")
    reason = (
        F.when(~supported, say("身份证文件格式 ", suffix, " 不受支持（仅支持 jpg/png/bmp/tif/webp/pdf），无法打码识别"))
        .when(F.coalesce("cards", F.lit(0)) == 0, "PaddleOCR 未返回识别结果"))
    return joined.select("todo_id", "file", outcome.alias("outcome"), reason.alias("reason"),
                         F.coalesce("cards", F.lit(0)).alias("cards"))
