"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Each source gets a share of all words by its weight; a target stops at `most_times` the
source's own words, and what is left over is shared by weight among the others until none is above. A source then takes every document
floor(target / words) times and once more each document whose hash is below the source's threshold. The threshold comes from
histograms: sizes summed by source and leading hash bits, the bucket where the budget ends found, and only that bucket
summed again by the next bits, until it holds one hash value. No document is sorted, and reruns agree. A second pass of the same
kind over the smaller documents behind the threshold uses up what a large document there left open.

Defined cases: a null or blank text has size 0 and is in the mix with 0 words; a null source is a source of its own, last in order; a null doc_id
hashes by its text; rows of equal id and equal text are taken alike, all or none at a threshold; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, measured_checkpoint, shuffle_partitions

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3.0
#: Hash bits of one histogram; 64 bits are seven levels at most.
LEVEL_BITS = 10
HASH_BITS = 63
#: Sources whose plan (about 60 bytes each) is sent to every task.
MOST_SOURCES = 200_000


def document_hash():
    """63 bits of id and text, so that a rerun or another order of rows takes the same documents, and rows of one id or none can be parted."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix"), "text"), 1)


def text_size():
    """The number of words of a text."""
    kept = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(kept, " \t\n\x0b\x0c\r", "")).cast("long")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and h, the 63-bit hash that orders documents inside their source."""
    size = text_size()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), document_hash().alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """source, source_size and target. Sources are numbered by a range sort, of which the driver sees one row per partition."""
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = sums.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    placed = checkpoint(dealt.withColumn("place", F.monotonically_increasing_id()))
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, rows = 0, {}
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        rows[r.part] = before
        before += r["count"]
    first = F.element_at(F.create_map(*[F.lit(int(x)).cast("long") for kv in rows.items() for x in kv]), part) if rows else F.lit(0)
    number = (first + row) % len(weights)
    known = checkpoint(placed.select("source", "source_size", F.element_at(F.lit([float(w) for w in weights]), (number + 1).cast("int")).alias("weight"),
                                     (F.col("source_size") * F.lit(float(most_times))).alias("most")))
    # capped sources leave the sharing; each turn is one sum over the sources
    per_weight = 0.0
    while True:
        over = F.col("weight") * F.lit(per_weight) > F.col("most")
        total = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("most"))).alias("fixed"),
                          F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not total["all"] or not total["open"]:
            break
        following = (total["all"] - (total["fixed"] or 0.0)) / total["open"]
        if following <= per_weight * (1 + 1e-12):
            break
        per_weight = following
    target = F.least(F.col("most"), F.col("weight") * F.lit(per_weight))
    return known.select("source", "source_size", target.alias("target"))


def _cut(sizes: DataFrame, budgets: DataFrame, nearest: bool) -> DataFrame:
    """source, threshold and `left` of its budget: documents of a smaller hash fit in. Reads source, size and hash only.

    The document at the threshold stays out, or with `nearest` goes in if that comes nearer. A source is settled once the bucket where its
    budget ends holds a single hash; after the first level only rows of buckets that are still open are read.
    """
    # prefix: leading bits already decided; budget: words still to take inside the bucket
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(None).cast("long").alias("threshold"))
    rows, left = sizes.where("size > 0").select("source", "size", "h"), HASH_BITS
    while left:
        above, bits = left, min(LEVEL_BITS, left)
        left -= bits
        open_ = state.where("threshold IS NULL").select(F.col("source").alias("s"), "budget", "prefix")
        inside = rows.join(open_, F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("h", above) == F.col("prefix"))
        sums = inside.groupBy("s", "budget", F.shiftright("h", left).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        # at most 1,024 buckets a source
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        edges = sums.withColumn("upto", upto).where("upto > budget")
        here = F.struct("bucket", "words", "low", "high", (F.col("budget") - F.col("upto") + F.col("words")).alias("budget"))
        edge = edges.groupBy("s").agg(F.min_by(here, "bucket").alias("e"))
        joined = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        # no edge: a source without words, or one whose words all fit
        past = F.shiftleft("prefix", above) + F.when(F.col("budget") > 0, F.lit((1 << above) - 1)).otherwise(F.lit(0).cast("long"))
        single = F.when(F.col("e.low") == F.col("e.high"), F.col("e.low"))
        if nearest:
            single = single + (F.col("e.budget") > F.col("e.words") / 2).cast("long")
        settled = F.coalesce("threshold", F.when(F.col("e").isNull(), past).otherwise(single))
        state = measured_checkpoint(joined.select("source", F.coalesce("e.budget", "budget").alias("budget"), F.coalesce("e.bucket", "prefix").alias("prefix"),
                                         settled.alias("threshold")))
        if state.where("threshold IS NULL").isEmpty():
            break
        if above == HASH_BITS:
            edge = state.where("threshold IS NULL").select(F.col("source").alias("s"), "prefix")
            rows = checkpoint(rows.join(edge, F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("h", left) == F.col("prefix")).select("source", "size", "h"))
    return state.select("source", "threshold", F.col("budget").alias("left"))


def mixing_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """One row per source: s (its name), source_size, target, `whole` (times that every document is taken), and who is taken once
    more: documents below `threshold`, and those of at most `small` words below `threshold2`.

    The second pass fills what a large document at the first threshold leaves open, with documents that are small enough.
    """
    targets = checkpoint(source_targets(sizes, weights, most_times))
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    rest = F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0))
    first = checkpoint(_cut(sizes, targets.select("source", rest.alias("budget")), False)).withColumnRenamed("source", "s")
    open_ = _with_plan(sizes, first).where((F.col("h") >= F.col("threshold")) & (F.col("size") <= F.col("left")))
    second = _cut(open_.select("source", "size", "h"), first.select(F.col("s").alias("source"), F.col("left").alias("budget")), True)
    second = second.select(F.col("source").alias("s2"), F.col("threshold").alias("threshold2"))
    plan = (targets.select("source", "source_size", "target", whole.alias("whole")).join(first, F.col("source").eqNullSafe(F.col("s")))
            .join(second, F.col("s").eqNullSafe(F.col("s2"))))
    return checkpoint(plan.select("s", "source_size", "target", "whole", "threshold", F.floor("left").alias("small"), "threshold2"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows beside the plan of their source. Up to MOST_SOURCES sources the plan is broadcast and no row is shuffled; beyond
    that it is an equi join whose hot sources adaptive execution splits."""
    if plan.count() <= MOST_SOURCES:
        plan = F.broadcast(plan)
    return rows.join(plan, rows["source"].eqNullSafe(plan["s"]))


def _copies(h, size, most_times: float):
    once_more = (h < F.col("threshold")) | ((h < F.col("threshold2")) & (size <= F.col("small")))
    return F.least(F.col("whole") + once_more.cast("long"), F.lit(int(most_times)).cast("long"))


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of `document_sizes`."""
    sizes = checkpoint(sizes)
    joined = _with_plan(sizes, mixing_plan(sizes, weights, most_times))
    return joined.select("doc_id", "size", "source_size", "target", (_copies(F.col("h"), F.col("size"), most_times) * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    return mix(document_sizes(docs), weights, most_times)


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """The rows of `docs` as the mix takes them, each as often as it is taken; texts are not shuffled."""
    plan = mixing_plan(checkpoint(document_sizes(docs)), weights, most_times)
    rows = _with_plan(docs, plan)
    copies = _copies(document_hash(), text_size(), most_times)
    taken = F.sequence(F.lit(1).cast("long"), copies)
    return rows.where(copies > 0).withColumn("_copy", F.explode(taken)).select(*(docs[c] for c in docs.columns))
