"""Amounts: parsing and the text forms used in messages."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import find, has_any


def _lookup(table: dict[str, int], key: Column) -> Column:
    literals = chain.from_iterable((F.lit(k), F.lit(v).cast("bigint")) for k, v in table.items())
    return F.try_element_at(F.create_map(*literals), key)


def numeral_value(text: Column) -> Column:
    """Value of a Chinese numeral, section by section (万, 亿)."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("digit"))

    def step(acc: Column, ch: Column) -> Column:
        digit = _lookup(fixed.NUMERAL_DIGITS, ch)
        unit = _lookup(fixed.NUMERAL_UNITS, ch)
        block = _lookup(fixed.NUMERAL_SECTIONS, ch)
        one = F.greatest(acc["digit"], F.lit(1).cast("bigint"))
        total = F.when(block.isNotNull(), acc["total"] + (acc["section"] + acc["digit"]) * block)
        section = F.when(unit.isNotNull(), acc["section"] + one * unit).when(block.isNotNull(), zero)
        return F.struct(
            F.coalesce(total, acc["total"]).alias("total"),
            F.coalesce(section, acc["section"]).alias("section"),
            F.coalesce(digit, zero).alias("digit"),
        )

    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    return F.aggregate(chars, start, step, lambda acc: acc["total"] + acc["section"] + acc["digit"])


def licence_capital(text: Column) -> Column:
    """Registered capital of a licence text in units of 10,000."""
    digits = find(text, fixed.CAPITAL_DIGITS)
    numerals = find(text, fixed.CAPITAL_NUMERALS)
    value = numeral_value(F.coalesce(numerals, F.lit("")))
    return (
        F.when(digits.isNotNull(), F.regexp_replace(digits, "[,，]", "").try_cast("double"))
        .when(numerals.isNotNull() & (value > 0), value.cast("double") / F.lit(10000.0))
    )


def registry_capital(text: Column) -> Column:
    """Registered capital of a registry text in units of 10,000; null for foreign money."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(
        ~has_any(plain, fixed.FOREIGN_MONEY),
        F.coalesce(find(plain, r"([\d.]+)\s*万"), find(plain, r"^([\d.]+)$")).try_cast("double"),
    )


def signed_number(text: Column) -> Column:
    """Amount with thousands separators; brackets or a minus sign make it negative."""
    plain = F.regexp_replace(F.trim(text), "[,，]", "")
    negative = plain.startswith("-") | plain.startswith("（-") | (plain.contains("(") & plain.endswith(")"))
    value = F.regexp_replace(plain, r"[^\d.]", "").try_cast("double")
    return F.when(negative, -value).otherwise(value)


def percent_value(text: Column) -> Column:
    """'12.5%' as 0.125; a number without the sign stays as it is, other text is null."""
    plain = F.regexp_replace(F.trim(text), "[,，\\s]", "")
    sign = plain.endswith("%") | plain.endswith("％")
    value = F.regexp_replace(plain, "[%％]$", "").try_cast("double")
    return F.when(sign, value / 100).otherwise(value)


def percent_text(value: Column, digits: int = 2) -> Column:
    """0.125 as '12.50%'."""
    return F.concat(F.format_string(f"%.{digits}f", value * 100), F.lit("%"))


def short_number(value: Column) -> Column:
    """At most six significant digits, no trailing zeros, exponent from a million on."""
    size = F.abs(value)
    text = F.format_string("%.0f", value)
    for whole in range(5, -4, -1):
        text = F.when(size < F.lit(10.0 ** whole - 0.5 * 10.0 ** (whole - 6)),
                      F.format_string(f"%.{6 - whole}f", value)).otherwise(text)
    text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    large = F.regexp_replace(F.format_string("%.5e", value), r"\.?0+e", "e")
    return (
        F.when(value.isNull(), F.lit("0"))
        .when(size == 0, F.lit("0"))
        .when((size >= 999999.5) | (size < 1e-4), large)
        .otherwise(text)
    )


def float_text(value: Column) -> Column:
    """Plain decimal text with at least one decimal."""
    plain = value.cast("decimal(38,6)").cast("string")
    plain = F.regexp_replace(plain, r"0+$", "")
    return F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
