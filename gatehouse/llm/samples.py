"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A document longer than this is not drawn into a sample; it is scored whole all the same.
LONGEST = 200_000


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id, parts: int, remainder: int):
    return F.coalesce(fold(doc_id, parts) == remainder, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, remainder: int, most: dict[int, int]) -> DataFrame:
    """Texts and labels (doc_id, text, label) of at most most[0] and most[1] documents, those of the least hashes of their ids.

    Only labels outside the held-out fold count. An id with several labels has the largest of them.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out(F.col("doc_id"), parts, remainder))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n")).where(F.col("n").between(1, LONGEST))
    order = F.xxhash64("doc_id")
    known = usable.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(n) for k, n in most.items()]
    chosen = picked[0].unionByName(picked[1])
    # at most sum(most.values()) ids: small enough to send to every task
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, remainder: int, most: dict[int, int]) -> pd.DataFrame:
    """The rows of `labelled_rows` on the driver (columns text, label), in the order of their ids."""
    found = labelled_rows(docs, labels, label, parts, remainder, most).toPandas()
    return found.sort_values("doc_id").reset_index(drop=True)[["text", "label"]]
