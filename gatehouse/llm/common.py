"""What the operators share: tables, checkpoints, Arrow columns as byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder as named_folder

#: Records of one Arrow batch: texts of a few kilobytes make batches of some megabytes.
BATCH_RECORDS = 1000
#: Bytes of text that one numpy step looks at; a longer single text is one step.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_RECORDS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the one that the session names, as `session.shared_folder` tells."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named_folder(spark))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def measured_checkpoint(df: DataFrame) -> DataFrame:
    """A checkpoint whose size the optimizer knows, for loops that join what they made before."""
    return checkpoint_and(df, F.count(F.lit(1)))[0]


def checkpoint_and(df: DataFrame, *facts: Column) -> tuple[DataFrame, Row]:
    """A measured checkpoint and aggregates of its rows, taken in the pass that measures.

    A plain checkpoint keeps the size that was estimated, for a join the product of both sides: in a loop that number squares with each turn,
    until its digits alone fill the driver. Rows that were cached once have the size they took there.
    """
    cached = df.persist()
    row = cached.agg(*facts).first()
    try:
        return checkpoint(cached), row
    finally:
        cached.unpersist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more offset at the end). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    text = np.frombuffer(data, dtype=np.uint8)[places[0]:places[-1]]
    return text, places - places[0]


def join_utf8(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    places = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=places[1:])
    return np.frombuffer(b"".join(texts), np.uint8), places


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, records: int = 4000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together; a longer text stands alone."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), first + records, count)
        yield first, last
        first = last
