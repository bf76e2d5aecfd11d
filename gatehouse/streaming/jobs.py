"""The append-and-react parts of the review as Structured Streaming queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import shared_folder


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one stream under the one that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state outside the heap, as processors with timers need it."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def decide_stream(requests: DataFrame, decide: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                  delay: str = "1 day", once: bool = True) -> StreamingQuery:
    """Decide arriving requests, each key (todo_id) once however late it comes again.

    The state of the stream holds the keys that arrived within the last `delay` only, and drops repeats among them. It follows the time of
    arrival, so no request is ever late. A key that comes again after that is found in the table of decided requests: the batch's own
    keys meet its key column, and only what is not in it is decided. A batch writes its own partition in overwrite mode and looks at
    those of earlier batches, so one that is run again after a failure replaces its own output.
    """
    spark = requests.sparkSession
    schema = "todo_id " + requests.schema["todo_id"].dataType.simpleString() + ", batch long"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.drop("__arrived").persist()
        try:
            # before the first output there is no folder to read
            decided = spark.read.schema(schema).parquet(out).where(F.col("batch") < batch_id) if batch_id and _exists(spark, out) else None
            fresh = batch.dropDuplicates(["todo_id"])
            if decided is not None:
                seen = decided.select("todo_id").join(batch.select("todo_id"), "todo_id", "left_semi").distinct()
                fresh = fresh.join(seen, "todo_id", "left_anti")
            decide(fresh).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            batch.unpersist()

    arrived = requests.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", delay)
    recent = arrived.dropDuplicatesWithinWatermark(["todo_id"])
    writer = recent.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


STALE = "上次处理被中断（服务重启），请重新点击后台审批"


def latest_tasks(log: DataFrame) -> DataFrame:
    """Last task state per request; partial aggregation keeps a busy key cheap."""
    values = [c for c in log.columns if c != "todo_id"]
    return (log.groupBy("todo_id").agg(F.max_by(F.struct(*values), "seq").alias("v"))
            .select("todo_id", "v.*"))


def mark_stale(tasks: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """A task still running after the limit counts as failed and can be started again."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    stale = (F.col("status") == "running") & (F.col("updated_at") < limit)
    return (tasks.withColumn("error", F.when(
                stale, STALE).otherwise(F.col("error")))
            .withColumn("step", F.when(stale, "stale_running_reset").otherwise(F.col("step")))
            .withColumn("status", F.when(stale, "error").otherwise(F.col("status"))))


def _milliseconds(moment) -> int:
    return int(moment.value // 1_000_000)


class TaskWatch(StatefulProcessor):
    """Last state of each request, and a timer that fires when a running task has not reported for too long."""

    OUTPUT = "todo_id string, status string, step string, error string, at timestamp"
    STATE = "status string, step string, error string, at long, seq long"

    def __init__(self, minutes: int):
        self.limit = 60_000 * minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        before = newest = self.last.get()
        for batch in rows:
            row = batch.iloc[np.lexsort((batch["seq"].to_numpy(), batch["at"].to_numpy()))[-1]]
            found = (row["status"], row["step"], row["error"], _milliseconds(row["at"]), int(row["seq"]))
            if newest is None or found[3:] >= tuple(newest[3:]):
                newest = found
        status, step, error, at, _ = newest
        # every call to the state costs a round trip: the one timer there can be is known from the state before
        waits, due = self._due(before), self._due(newest)
        if waits != due:
            if waits is not None:
                self.handle.deleteTimer(waits)
            if due is not None:
                self.handle.registerTimer(due)
        self.last.update(tuple(newest))
        yield self._frame(key, status, step, error, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = self.last.get()[3]
        self.last.clear()
        yield self._frame(key, "error", "stale_running_reset", STALE, at)

    def close(self) -> None:
        pass

    def _due(self, state) -> int | None:
        return state[3] + self.limit if state is not None and state[0] == "running" else None

    @staticmethod
    def _frame(key, status, step, error, at):
        return pd.DataFrame({"todo_id": [key[0]], "status": [status], "step": [step], "error": [error], "at": [pd.Timestamp(at, unit="ms")]})


def task_stream(log: DataFrame, minutes: int, delay: str = "1 minute") -> DataFrame:
    """Task states (todo_id, seq, status, step, error, at) as a stream, in update mode.

    Each batch gives the latest state of the requests it touches. A running task that no record follows within `minutes`
    of event time comes out once more as failed, and its state ends. Records behind the watermark are dropped. The stream is started inside `keyed_store`.
    """
    rows = log.withWatermark("at", delay).select(
        F.col("todo_id").cast("string").alias("todo_id"), "status", "step", "error", "at", F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("todo_id").transformWithStateInPandas(
        statefulProcessor=TaskWatch(minutes), outputStructType=TaskWatch.OUTPUT, outputMode="Update", timeMode="EventTime")


class LiveEntries(StatefulProcessor):
    """How many entries of one key are younger than their time to live; one timer waits for the oldest of them.

    A state's own time to live counts the clock of the machine, so a log that is read again would keep everything; timers
    follow the times in the log. Every call to the state costs a round trip, so the moments of a key are one packed value while they are
    few; each `BLOCK` of them is put away by itself, and the value keeps its number and oldest moment. A busy key reads and writes
    only blocks that hold ended entries.
    """

    OUTPUT = "key string, entries long, newest long, at timestamp"
    STATE = "entries long, newest long, at long, open binary, blocks binary"
    BLOCK = 4096

    def __init__(self, ttl_seconds: int):
        self.ttl, self.block = 1000 * ttl_seconds, self.BLOCK

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", self.STATE)
        self.held = handle.getMapState("held", "block long", "moments binary")

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        entries, newest, last, open_, blocks = self._state(self.total.get())
        waits = self._due(open_, blocks)
        for batch in rows:
            moments = batch["at"].astype("datetime64[ns]").astype("int64").to_numpy() // 1_000_000
            live = moments + self.ttl >= watermark
            moments, seqs = moments[live], batch["seq"].to_numpy()[live]
            if not len(moments):
                continue
            order = np.lexsort((seqs, moments))
            (last, newest), entries = max((last, newest), (int(moments[order[-1]]), int(seqs[order[-1]]))), entries + len(moments)
            open_ = np.sort(np.concatenate((open_, moments)))
            while len(open_) > self.block:
                number = int(blocks[:, 0].max()) + 1 if len(blocks) else 0
                self.held.updateValue((number,), (open_[:self.block].tobytes(),))
                blocks, open_ = np.vstack((blocks, (number, open_[0]))), open_[self.block:]
        if entries:
            due = self._due(open_, blocks)
            if due != waits:
                if waits is not None:
                    self.handle.deleteTimer(waits)
                self.handle.registerTimer(due)
            self.total.update((entries, newest, last, open_.tobytes(), blocks.tobytes()))
            yield self._frame(key, entries, newest, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        entries, newest, last, open_, blocks = self._state(self.total.get())
        least = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1) - self.ttl
        left, kept = open_[open_ >= least], []
        entries -= len(open_) - len(left)
        for number, oldest in blocks.tolist():
            if oldest < least:
                moments = np.frombuffer(self.held.getValue((number,))[0], np.int64)
                rest = moments[moments >= least]
                entries -= len(moments) - len(rest)
                if not len(rest):
                    self.held.removeKey((number,))
                    continue
                self.held.updateValue((number,), (rest.tobytes(),))
                oldest = int(rest[0])
            kept.append((number, oldest))
        if entries:
            blocks = np.array(kept, np.int64).reshape(-1, 2)
            self.handle.registerTimer(self._due(left, blocks))
            self.total.update((entries, newest, last, left.tobytes(), blocks.tobytes()))
        else:
            self.total.clear()
        yield self._frame(key, entries, newest, last)

    @staticmethod
    def _state(value):
        entries, newest, last, open_, blocks = value or (0, -1, -1, b"", b"")
        return entries, newest, last, np.frombuffer(open_, np.int64), np.frombuffer(blocks, np.int64).reshape(-1, 2)

    def _due(self, moments: np.ndarray, blocks: np.ndarray) -> int | None:
        oldest = np.concatenate((moments, blocks[:, 1]))
        return int(oldest.min()) + self.ttl if len(oldest) else None

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key, entries, newest, last):
        return pd.DataFrame({"key": [key[0]], "entries": [entries], "newest": [newest], "at": [pd.Timestamp(last, unit="ms")]})


def live_stream(log: DataFrame, ttl_seconds: int = 86400, delay: str = "1 hour") -> DataFrame:
    """T4: per key the number of entries (seq, key, at) in force, the latest of them and its time, in update mode.

    Undated entries never count, nor do entries that arrive behind the watermark. An entry leaves once the watermark has passed its time to live; what
    is left then is given out again, and a key without entries has the count 0 and no state. The stream is started inside `keyed_store`.
    """
    rows = log.where(F.col("at").isNotNull()).withWatermark("at", delay).select(
        F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "at")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=LiveEntries(ttl_seconds), outputStructType=LiveEntries.OUTPUT, outputMode="Update", timeMode="EventTime")


def call_counts_stream(events: DataFrame, at: str = "at", endpoint: str = "kind",
                       delay: str = "1 day") -> DataFrame:
    """Calls per day and endpoint; rows of days that the watermark has passed are dropped with their state."""
    return (events.withWatermark(at, delay).groupBy(F.window(at, "1 day"), F.col(endpoint).alias("endpoint"))
            .agg(F.count(F.lit(1)).alias("calls"))
            .select(F.to_date("window.start").alias("day"), "endpoint", "calls"))


def run_to_table(stream: DataFrame, folder: str, keys: list[str], within: str = "0") -> DataFrame:
    """Drain a stream in update mode and give back the last value of each key.

    A batch writes the keys it changed to its own partition, so one that is run again replaces its own output. `within` is an expression
    that tells which of several values of one key and batch is the last: the largest.
    """
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with keyed_store(stream.sparkSession):
        query = (stream.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    written = stream.sparkSession.read.parquet(out)
    values = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("batch", F.expr(within))).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
