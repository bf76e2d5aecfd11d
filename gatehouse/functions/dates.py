"""Dates in certificate texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import bound, find, find_all, has, squeeze, swap


def as_date(text: Column) -> Column:
    """A date from 'y m d' written with any separators, null where there is no such day."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[^0-9]+", "-"), r"^-|-$", "")
    return F.try_to_timestamp(plain, F.lit("y-M-d")).cast("date")


def find_dates(text: Column) -> Column:
    return F.array_compact(F.transform(find_all(text, fixed.DATE), as_date))


def last_date(text: Column) -> Column:
    return F.try_element_at(find_dates(text), F.lit(-1))


def is_long_term(text: Column) -> Column:
    return has(text, fixed.LONG_TERM)


def valid_until(text: Column) -> Column:
    """End of validity as struct(date, longterm): labelled range, labelled day, else the latest date."""
    longterm = is_long_term(squeeze(text))
    labelled = fixed.NOT_PREVIOUS_CYCLE + fixed.VALID_LABEL + fixed.DATE + fixed.RANGE_END

    def labelled_day(hit: Column) -> Column:
        # the match alone matches again, with the same groups
        parts = [find(hit, labelled, group) for group in range(1, 7)]
        return F.when(parts[3].isNotNull(), as_date(F.concat_ws("-", *parts[3:]))).when(
            parts[0].isNotNull(), as_date(F.concat_ws("-", *parts[:3])))

    expiry = find(text, fixed.NOT_PREVIOUS_CYCLE + fixed.EXPIRY_LABEL + f"({fixed.DATE})")
    hit = find(text, labelled, 0)
    day = F.coalesce(bound(hit, labelled_day), as_date(expiry), F.array_max(find_dates(text)))
    return F.struct(F.when(~longterm, day).alias("date"), longterm.alias("longterm"))


def term_text(until: Column) -> Column:
    return F.coalesce(until["date"].cast("string"), F.when(until["longterm"], F.lit("长期")))


def parse_iso(text: Column) -> Column:
    """Timestamp from ISO text, with or without an offset or Z."""
    return F.coalesce(
        F.try_to_timestamp(swap(text, "Z$", "+00:00")),
        F.try_to_timestamp(text),
    )


def age_days(moment: Column, as_of: Column) -> Column:
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(moment)
    return F.floor(seconds / F.lit(86400)).cast("int")


def day8(digits: Column) -> Column:
    """'YYYY.MM.DD' from eight digits that form a day."""
    return F.date_format(F.try_to_timestamp(digits, F.lit("yyyyMMdd")), "yyyy.MM.dd")


def plain_term(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(squeeze(text), "[:：]", ""), "[—–~]", "-")


def canonical_term(text: Column) -> Column:
    """Stable validity text where OCR lost separators or the first day."""
    plain = plain_term(text)
    digits = F.regexp_replace(plain, r"\D", "")
    first, second = day8(F.substring(digits, 1, 8)), day8(F.substring(digits, 9, 8))
    return (
        F.when(plain.contains("长期") & (F.length(digits) == 8),
               F.coalesce(F.concat(first, F.lit("-长期")), plain))
        .when((F.length(digits) == 16) & second.isNotNull(),
              F.coalesce(F.concat(first, F.lit("-"), second), second))
        .otherwise(plain)
    )


def is_term(text: Column) -> Column:
    plain = plain_term(text)
    digits = F.regexp_replace(plain, r"\D", "")
    day = r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}"
    return (
        plain.rlike(rf"^{day}-(?:{day}|长期)$")
        | F.when(plain.contains("长期"), F.length(digits) == 8).otherwise(F.length(digits) == 16)
    )
