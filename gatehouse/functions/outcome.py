"""The result shape of every certificate check: fields, three-valued checks, issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOME_TYPE = "struct<fields:map<string,string>,checks:map<string,boolean>,issues:array<string>>"


def _entries(rows: list[tuple], kind: str) -> Column:
    """rows of (name, value) or (name, value, present)."""
    kept = []
    for name, value, *present in rows:
        key = name if isinstance(name, Column) else F.lit(name)
        entry = F.struct(key.alias("key"), value.cast(kind).alias("value"))
        kept.append(F.when(present[0], entry) if present else entry)
    empty = F.array().cast(f"array<struct<key:string,value:{kind}>>")
    return F.map_from_entries(F.array_compact(F.array(*kept)) if kept else empty)


def outcome(fields: list[tuple], checks: list[tuple], issues: list[Column]) -> Column:
    """Entries keep their order; an issue that is null is left out."""
    notes = F.array_compact(F.array(*issues)) if issues else F.array().cast("array<string>")
    return F.struct(
        _entries(fields, "string").alias("fields"),
        _entries(checks, "boolean").alias("checks"),
        notes.alias("issues"),
    )


def say(*parts) -> Column:
    """A message; null as soon as one part is null."""
    return F.concat(*[part if isinstance(part, Column) else F.lit(part) for part in parts])


def unknown() -> Column:
    return F.lit(None).cast("boolean")
