"""Vectors of whole numbers, dealt into shards of rows and blocks of queries that meet in groups of bounded size.

A row's components become floor(256 * x); a magnitude beyond `LARGEST` stops there, so that products stay whole numbers of 64 bits. Every
row has a number of its own (`row`), so rows of one id, or of none, stay apart. Shards and blocks are dealt by the hash of that number:
a vector that a third of all rows share is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

SCALE = 256
LARGEST = 1 << 24
#: Stands for a missing id in numpy; it comes after all others.
NO_ID = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", also: tuple[str, ...] = ()) -> DataFrame:
    """row, id, v (array of long) and the columns `also`; rows whose vector is null or holds null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    limit = F.lit(LARGEST).cast("long")
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * SCALE), limit), -limit))
    good = rows.where(F.col(vector).isNotNull()).where(~bad)
    named = good.select(F.col(key).cast("long").alias("id"), whole.alias("v"), *also)
    return checkpoint(named.select(F.monotonically_increasing_id().alias("row"), *named.columns))


def meet(rows: DataFrame, asked: DataFrame, shards: int, blocks: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`work(rows of a shard, queries of a block)` for every shard and block; `rows` has `shard`, `asked` has `block`."""
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    return cogrouped(rows.withColumn("block", every_block), asked.withColumn("shard", every_shard), ["shard", "block"], work, schema)


def cogrouped(left: DataFrame, right: DataFrame, by: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    # both sides come from one table: columns of new names keep them apart
    left, right = (side.select(*(F.col(c).alias(c) for c in side.columns)) for side in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, schema)


def dealt(frame: DataFrame, name: str, parts: int, salt: int = 0) -> DataFrame:
    return frame.withColumn(name, F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int"))


def parts_of(count: int, size: int) -> int:
    return max(1, math.ceil(count / size))


def matrix_of(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers; shorter vectors end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    values, lengths = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths(), np.int64)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = values
    return out


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.fill_null(NO_ID), np.int64)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
