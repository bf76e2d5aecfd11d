"""SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Fingerprints that differ in two bits or fewer either differ in at most one bit of
the first segment, or agree in the second. So each distinct fingerprint looks up 33 values of the first segment (a Hamming
ball of radius 1) and one of the second in the table of segments, and complete distances are verified inside the join. A segment value that more than
`most_in_bucket` distinct fingerprints share would make a quadratic bucket; those fingerprints leave that table and
look up their whole ball of 2,081 fingerprints instead, which finds the same links. Links join fingerprints, never documents: equal documents
are one node. Components come from alternating stars over the links.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer words than a shingle: the
whole sequence is one shingle; a null doc_id stays null and names no component unless all members are null; repeated rows
each give a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpoint
from .graph import components
from .shingle_sets import near_components, row_key

SHINGLE = 3
SEED = 42
MOST_BITS = 2
MOST_IN_BUCKET = 2048
#: Shingles whose bits are counted in one numpy step.
BLOCK = 1 << 14


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_simhash(docs: DataFrame, text: str = "text", output: str = "simhash", size: int = SHINGLE) -> DataFrame:
    """`docs` with the fingerprint as a signed long; columns of clashing name are replaced."""
    names = [f.name for f in docs.schema.fields if f.name != output]
    schema = StructType([docs.schema[n] for n in names] + [StructField(output, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, size) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], [*names, output])

    return docs.mapInArrow(run, schema)


def _masks(low_bits: int, high_bits: int, most: int) -> list[int]:
    """All patterns of at most `most` bits among bits low_bits..high_bits-1, as signed longs."""
    ones = [1 << i for i in range(low_bits, high_bits)]
    out = [0]
    layer = [(0, -1)]
    for _ in range(most):
        layer = [(value | ones[j], j) for value, last in layer for j in range(last + 1, len(ones))]
        out += [value for value, _ in layer]
    return [v - (1 << 64) if v >> 63 else v for v in out]


def links(prints: DataFrame, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of column `p` that differ in one or two bits."""
    first, second = F.shiftrightunsigned("p", 32), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF))
    segments = F.array(F.struct(F.lit(0).alias("segment"), first.alias("value")), F.struct(F.lit(1).alias("segment"), second.alias("value")))
    table = prints.select("p", F.explode(segments).alias("s")).select("p", "s.segment", "s.value")
    full = table.groupBy("segment", "value").count().where(F.col("count") > most_in_bucket).select("segment", "value")
    crowded = checkpoint(table.join(full, ["segment", "value"], "left_semi"))
    rows = table.join(full, ["segment", "value"], "left_anti").withColumnRenamed("p", "b")
    ball = [m for m in _masks(0, 32, 1)]
    asked = F.concat(
        F.transform(F.lit(ball), lambda m: F.struct(F.lit(0).alias("segment"), first.bitwiseXOR(m).alias("value"))),
        F.array(F.struct(F.lit(1).alias("segment"), second.alias("value"))))
    probes = prints.select(F.col("p").alias("a"), F.explode(asked).alias("s")).select("a", "s.segment", "s.value")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    met = probes.join(rows, ["segment", "value"]).where(near & (F.col("a") != F.col("b"))).select("a", "b")
    whole = _masks(0, 64, 2)[1:]
    around = crowded.select("p").distinct().select(F.col("p").alias("b"), F.explode(F.lit(whole)).alias("m"))
    around = around.select("b", F.col("b").bitwiseXOR(F.col("m")).alias("a"))
    found = around.join(prints.select(F.col("p").alias("a")), "a").select("a", "b")
    both = met.unionByName(found)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """doc_id, fingerprint and component_id of each row; the component's id is the smallest doc_id it reaches."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = checkpoint(with_simhash(ids).select("doc_id", F.col("simhash").alias("p")))
    least = checkpoint(marked.groupBy("p").agg(F.min("doc_id").alias("least")))
    roots = components(links(least.select("p"), most_in_bucket)).withColumnRenamed("node", "p")
    classes = least.join(roots, "p", "left").withColumn("root", F.coalesce("root", "p"))
    classes = checkpoint(classes)
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("p", "root").join(names, "root").select("p", "component_id")
    return marked.join(named, "p").select("doc_id", F.lower(F.lpad(F.hex("p"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays, with or without an id: the one of the smallest doc_id, null last, then by text hash.

    Near copies have sets of five-word shingles of Jaccard similarity 0.8 or more, as `shingle_sets` finds them: that is six to
    eleven bits and more of a fingerprint, beyond what segments of 64 bits can look up. A row with neither id nor text has nothing
    to be compared and stays. Columns stay as they are.
    """
    nothing = F.col("doc_id").isNull() & F.col("text").isNull()
    texts = docs.where(~nothing)
    rows, roots = near_components(texts)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = rows.join(roots, "node").groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias("_row"))
    once = texts.withColumn("_row", row_key()).dropDuplicates(["doc_id", "_row"])
    return once.join(kept, "_row", "left_semi").select(*docs.columns).unionByName(docs.where(nothing))
