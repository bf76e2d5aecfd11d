"""Digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def payload_digest(**fields: Column) -> Column:
    """Digest of a payload whose fields are taken in name order."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def event_digest(previous: Column, at: Column, kind: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, at, kind, payload), 256)
