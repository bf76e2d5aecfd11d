"""Tamper-evident chains of audit events.

The hash of an event covers the hash before it, so a chain is sequential. A chain
is therefore one (key, segment): segments are ranges of the unique sequence
number, which bounds every chain whatever a key holds, and chains run in parallel.
What links the segments of a key are the seals over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ordering import unnested
from ..functions.hashing import content_digest, event_digest

SEGMENT = 1024
#: Segments, and blocks of them, that one seal covers.
FOLD = 1024


def segment_of(seq: Column, size: int = SEGMENT) -> Column:
    return F.floor(seq / F.lit(size)).cast("bigint")


def build_chain(events: DataFrame, keys: list[str], size: int = SEGMENT) -> DataFrame:
    """Events (seq, at, kind, payload as text) with `previous` and `hash`.

    At most `size` events meet in a fold because seq is unique.
    """
    rows = F.struct("seq", "at", "kind", "payload")
    chains = (events.withColumn("segment", segment_of(F.col("seq"), size))
              .groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(rows)).alias("rows")))
    link = F.array().cast("array<struct<seq:bigint,at:string,kind:string,payload:string,previous:string,hash:string>>")
    start = F.struct(F.lit(fixed.GENESIS).alias("last"), link.alias("links"))

    def step(acc: Column, row: Column) -> Column:
        value = event_digest(acc["last"], row["at"], row["kind"], row["payload"])
        return F.struct(value.alias("last"), F.concat(acc["links"], F.array(F.struct(
            row["seq"].cast("bigint").alias("seq"), row["at"].alias("at"), row["kind"].alias("kind"),
            row["payload"].alias("payload"), acc["last"].alias("previous"), value.alias("hash")))).alias("links"))

    folded = F.aggregate("rows", start, step, lambda acc: acc["links"])
    return unnested(chains, [*keys, "segment"], folded, "link").select(*keys, "segment", "link.*")


def chain_heads(events: DataFrame, keys: list[str], size: int = SEGMENT) -> DataFrame:
    """Last hash and length of every chain."""
    rows = F.struct("seq", "at", "kind", "payload")
    head = F.aggregate("rows", F.lit(fixed.GENESIS), lambda acc, row: event_digest(
        acc, row["at"], row["kind"], row["payload"]))
    return (events.withColumn("segment", segment_of(F.col("seq"), size))
            .groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(rows)).alias("rows"))
            .select(*keys, "segment", F.size("rows").alias("events"), head.alias("head")))


def verify_chain(events: DataFrame, chain: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows whose `previous` is not the hash before them, or whose hash does not recompute."""
    order = [F.col("seq")] if order is None else order
    before = F.lag("hash", 1, fixed.GENESIS).over(Window.partitionBy(*chain).orderBy(*order))
    recomputed = event_digest(F.col("previous"), F.col("at"), F.col("kind"), F.col("payload"))
    checked = (events.withColumn("broken_link", ~F.col("previous").eqNullSafe(before))
               .withColumn("broken_hash", ~F.col("hash").eqNullSafe(recomputed)))
    return checked.filter("broken_link or broken_hash")


def seals(heads: DataFrame, keys: list[str], fold: int = FOLD) -> DataFrame:
    """The chain over the segments of each key (rows of `chain_heads`), so that none can go unnoticed.

    A chain of a million segments would be one row, so segments are sealed in blocks of `fold`, blocks in blocks of
    blocks, up to one block per key: each seal covers number, count and hash of all below it, in order, starting from the
    genesis hash. Level 0 are the segments themselves. Kept apart from the events (the top seals are enough), they tell deleted
    segments and tails.
    """
    level = heads.select(*keys, F.lit(0).alias("level"), F.col("segment").alias("block"), F.col("events").cast("bigint").alias("events"), F.col("head").alias("hash"))
    out, last = level, heads.agg(F.max("segment")).first()[0] or 0
    number = 0
    while True:
        number += 1
        rows = F.array_sort(F.collect_list(F.struct("block", "events", "hash")))
        digest = F.aggregate("rows", F.lit(fixed.GENESIS), lambda acc, r: F.sha2(
            F.concat_ws("|", acc, r["block"].cast("string"), r["events"].cast("string"), r["hash"]), 256))
        level = (level.groupBy(*keys, F.floor(F.col("block") / fold).cast("bigint").alias("up"))
                 .agg(F.sum("events").alias("events"), rows.alias("rows"))
                 .select(*keys, F.lit(number).alias("level"), F.col("up").alias("block"), "events", digest.alias("hash")))
        out, last = out.unionByName(level), last // fold
        if last == 0:
            return out


def verify_seals(heads: DataFrame, sealed: DataFrame, keys: list[str], fold: int = FOLD) -> DataFrame:
    """Seals that the present events no longer give: `missing`, `added` or `changed` (with the number of events lost)."""
    now = seals(heads, keys, fold)
    place = [*keys, "level", "block"]
    both = sealed.select(*place, F.col("events").alias("was"), F.col("hash").alias("sealed")).join(
        now.select(*place, F.col("events").alias("now"), "hash"), place, "full_outer")
    problem = (F.when(F.col("hash").isNull(), "missing").when(F.col("sealed").isNull(), "added")
               .when(F.col("hash") != F.col("sealed"), "changed"))
    return both.withColumn("problem", problem).filter("problem is not null").select(
        *place, "problem", (F.coalesce("was", F.lit(0)) - F.coalesce("now", F.lit(0))).cast("bigint").alias("lost"))


def verify_masked(files: DataFrame, records: DataFrame) -> DataFrame:
    """Masked files whose content is the one recorded at masking."""
    recorded = records.filter("masked_sha256 is not null").select("todo_id", "file", "masked_sha256").distinct()
    digest = F.col("sha256") if "sha256" in files.columns else content_digest(F.col("content"))
    return (files.withColumn("__digest", digest).join(recorded, ["todo_id", "file"])
            .filter(F.col("__digest") == F.col("masked_sha256")).drop("__digest"))
