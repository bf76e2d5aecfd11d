"""String helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def rx(pattern: str, multiline: bool = False) -> str:
    """Unicode character classes; only \\n ends a line."""
    return ("(?dmU)" if multiline else "(?dU)") + pattern


def find(col: Column, pattern: str, group: int = 1, multiline: bool = False) -> Column:
    """First match of the group, null where there is none; unlike nullif this searches once, also inside a condition."""
    return F.get(F.array_remove(F.array(F.regexp_extract(col, rx(pattern, multiline), group)), ""), 0)


def find_all(col: Column, pattern: str, group: int = 0, multiline: bool = False) -> Column:
    return F.regexp_extract_all(col, F.lit(rx(pattern, multiline)), F.lit(group))


def has(col: Column, pattern: str, multiline: bool = False) -> Column:
    return F.coalesce(col.rlike(rx(pattern, multiline)), F.lit(False))


def swap(col: Column, pattern: str, by: str, multiline: bool = False) -> Column:
    return F.regexp_replace(col, rx(pattern, multiline), by)


def has_any(col: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words; a word that holds another one decides nothing.

    Every comparison is code of its own in the method that reads the row, and a method of more than 8,000 bytes is not compiled by the JVM.
    """
    deciding = [w for w in dict.fromkeys(words) if not any(other != w and other in w for other in words)]
    return F.coalesce(reduce(Column.__or__, [col.contains(word) for word in deciding]), F.lit(False))


def first_word(col: Column, pairs: list[tuple[str, str]]) -> Column:
    """The value of the first word, in the order given, that the text contains."""
    return F.coalesce(*[F.when(col.contains(word), F.lit(value)) for word, value in pairs])


def blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


_SPACES = "".join(chr(c) for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000])
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94))


def squeeze(col: Column) -> Column:
    """Drop every kind of white space."""
    return F.translate(blank(col), _SPACES, "")


def trim(col: Column) -> Column:
    return swap(col, r"^\s+|\s+$", "")


def trim_value(col: Column) -> Column:
    return F.btrim(col, F.lit(fixed.VALUE_TRIM))


def or_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def fold_width(col: Column) -> Column:
    """Full-width letters, digits and punctuation become their plain forms."""
    return F.translate(col, _WIDE + "\u3000\u00a0", _NARROW + "  ")


def fold_squeeze(col: Column) -> Column:
    """Both at once."""
    return F.translate(blank(col), _WIDE + _SPACES, _NARROW)


def drop_number_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^\d+_", "")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def safe_name(name: Column, length: int | None = None) -> Column:
    """Replace the characters file systems refuse."""
    cleaned = F.regexp_replace(name, r'[\\/:*?"<>|]', "_")
    return F.substring(cleaned, 1, length) if length else cleaned


def clip(col: Column, length: int = 100) -> Column:
    text = blank(col)
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def html_escape(col: Column) -> Column:
    text = blank(col)
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def compare_form(col: Column) -> Column:
    """Form used when two engines' readings are compared."""
    return F.lower(swap(blank(col), r"[\s|_*#:：,，。;；（）()]", ""))


def strip_comments(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)<!--.*?-->", "")


def prepare_text(col: Column) -> Column:
    """Plain text of a certificate: no table rules, bars, bold marks or headings, labels joined."""
    text = swap(blank(col), fixed.TABLE_RULE, "", multiline=True)
    text = F.replace(F.replace(text, F.lit("|"), F.lit(" ")), F.lit("**"), F.lit(""))
    text = swap(text, fixed.SPLIT_LABEL, "$1", multiline=True)
    return swap(text, fixed.HEADING, "", multiline=True)


def prepared(df: DataFrame, name: str = "__t") -> DataFrame:
    """`df` with the prepared text in a step of its own; a row without a text has none, and nothing that reads it does any work."""
    return df.withColumn(name, F.when(F.col("text").isNotNull(), prepare_text(F.col("text"))))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once however often it is read, also inside a condition."""
    return F.element_at(F.transform(F.array(value), use), 1)


def join_labels(col: Column) -> Column:
    """Close the gaps inside known licence labels."""
    for label in fixed.LICENCE_LABELS:
        col = swap(col, r"\s*".join(label), label)
    return col


def grab(col: Column, labels: list[str], value: str) -> Column:
    """Labelled value up to the next known label, the first label that has one."""
    stop = rf"(?=\s*[:：]?\s*(?:{fixed.FIELD_STOP}|\n|$))"
    return trim_value(F.coalesce(*[
        find(col, rf"(?<![一-龥]){label}\s*[:：]?\s*({value}){stop}") for label in labels
    ]))


def name_close(a: Column, b: Column) -> Column:
    """Two non-empty names that differ by exactly one character."""
    left, right = squeeze(a), squeeze(b)
    return (left != "") & (right != "") & (F.levenshtein(left, right) == 1)


def either_contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def numbered(items: Column, indent: str = "  ", gap: str = ". ", start: Column | int = 1) -> Column:
    """'1. first', '2. second' for a (bounded) array of lines."""
    first = start if isinstance(start, Column) else F.lit(start)
    return F.transform(items, lambda x, i: F.concat(
        F.lit(indent), (i + first).cast("string"), F.lit(gap), x))


def shown(col: Column, length: int = 30) -> Column:
    return F.when(F.length(col) > length, F.concat(F.substring(col, 1, length), F.lit("…"))).otherwise(col)


def title_of(label: Column) -> Column:
    """The part before the first slash."""
    return trim(F.split(label, "/")[0])
