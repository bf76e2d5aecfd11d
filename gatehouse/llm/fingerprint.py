"""Document fingerprints by consistent weighted sampling over word shingles.

A term is a run of five lower-cased words (a shorter text: the whole of it), its weight the number of times it occurs.
For each of K samples a term of weight w draws, from its own hash, r and c ~ Gamma(2, 1) and b ~ U(0, 1):
    t = floor(ln w / r + b),   a = c / exp(r * (t - b)) / exp(r)
and the sample is the (term, t) of the smallest a. Two texts agree in a sample with a probability equal to their generalised
Jaccard similarity, sum(min w) / sum(max w). The draws come from a table of 65,536 triples that the hash
indexes; terms that meet in one triple are ordered by their hashes, so sampling stays consistent.

Defined cases: a null text is empty; an empty text has the fingerprint of all `f`, is like another empty text (1.0) and
like no other (0.0). Equal texts have equal fingerprints, repeated rows too. The document that follows is the next smaller doc_id (equal
doc_id: by the text's hash; null doc_id last), and after the last the first; a single document follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, join_utf8, shuffle_partitions
from .words import Words, mix, shingle_hashes

SAMPLES = 128
SHINGLE = 5
#: Weights up to this one have a table of their own; larger ones are computed where they occur.
TABLED_WEIGHTS = 16
EMPTY = 0xFFFF


class Sampler:
    """Signatures of K 16-bit values, the same on every machine."""

    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.samples, self.shingle = samples, shingle
        self.r, self.c = rng.gamma(2.0, size=1 << 16), rng.gamma(2.0, size=1 << 16)
        self.b = rng.random(1 << 16)
        self.salts = rng.integers(1, 1 << 63, samples // 4, dtype=np.uint64)
        self.tags = rng.integers(0, 1 << 32, samples, dtype=np.uint64)
        everything = np.arange(1 << 16)
        self.table = np.concatenate([self._keys(everything, np.float64(w)) for w in range(1, TABLED_WEIGHTS + 1)])

    def _keys(self, draw: np.ndarray, weight) -> np.ndarray:
        """The bits of a above 32 bits that stand for t."""
        r = self.r[draw]
        t = np.floor(np.log(weight) / r + self.b[draw])
        a = np.exp(np.log(self.c[draw]) - r * (t - self.b[draw]) - r).astype(np.float32)
        stands = (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        return (a.view(np.uint32).astype(np.uint64) << np.uint64(32)) | stands

    def signatures(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of `samples` values for each text; all values of an empty text are EMPTY."""
        out = np.full((len(offsets) - 1, self.samples), EMPTY, np.uint16)
        for first, last in chunks(offsets):
            base = offsets[first]
            out[first:last] = self._chunk(text[base:offsets[last]], offsets[first:last + 1] - base)
        return out

    def _chunk(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full((len(offsets) - 1, self.samples), EMPTY, np.uint16)
        hashes, doc = shingle_hashes(Words(text, offsets), self.shingle)
        if not len(hashes):
            return out
        bits = np.uint64(12)  # a chunk has fewer than 4,096 texts
        keyed = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
        fresh = np.flatnonzero(np.concatenate(([True], keyed[1:] != keyed[:-1])))
        weight = np.diff(np.concatenate((fresh, [len(keyed)])))
        keyed = keyed[fresh]
        doc = (keyed >> (np.uint64(64) - bits)).astype(np.int64)
        term = keyed & np.uint64((1 << 52) - 1)
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        tag = mix(term) & np.uint64(0xFFFFFFFF)
        place = ((np.minimum(weight, TABLED_WEIGHTS) - 1) << 16).astype(np.int64)
        large = np.flatnonzero(weight > TABLED_WEIGHTS)
        plain = not place.any()
        for group in range(self.samples // 4):
            quarters = mix(term ^ self.salts[group]).view(np.uint16).reshape(-1, 4)
            for j in range(4):
                k = 4 * group + j
                draw = quarters[:, j]
                keys = self.table.take(draw if plain else draw + place)
                if len(large):
                    keys[large] = self._keys(draw[large], weight[large])
                keys ^= tag ^ self.tags[k]
                best = np.minimum.reduceat(keys, starts)
                out[doc[starts], k] = (mix(best & np.uint64(0xFFFFFFFF)) & np.uint64(0xFFFF)).astype(np.uint16)
        return out


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal samples; an empty text is like empty texts only."""
    blank = (left == EMPTY).all(axis=1) | (right == EMPTY).all(axis=1)
    same = (left == right).mean(axis=1)
    return np.where(blank, (left == right).all(axis=1).astype(float), same)


def to_hex(signatures: np.ndarray) -> list[str]:
    width = 2 * signatures.shape[1]
    packed = signatures.astype(">u2").tobytes().hex()
    return [packed[i * 2 * width:(i + 1) * 2 * width] for i in range(len(signatures))] if len(signatures) else []


def fingerprints(docs: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """`docs` with one more column, the fingerprint of the whole text; no shuffle."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([f for f in docs.schema.fields if f.name != output] + [StructField(output, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import utf8_column

        sampler = Sampler()
        for batch in batches:
            found = to_hex(sampler.signatures(*utf8_column(batch.column(text))))
            kept = [n for n in batch.schema.names if n != output]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found, pa.string())], [*kept, output])

    return docs.mapInArrow(run, schema)


def _range_number(bounds: list[int]):
    """How many of the sorted `bounds` are below doc_id, found in two steps of a square root of their number each."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.lit(bounds[step - 1::step]) if len(bounds) >= step else F.array()
    steps = F.size(F.filter(coarse, lambda b: b < F.col("doc_id")))
    rest = F.slice(F.lit(bounds), steps * step + 1, F.lit(step))
    return (steps * step + F.size(F.filter(rest, lambda b: b < F.col("doc_id")))).cast("int")


def with_successors(docs: DataFrame) -> DataFrame:
    """doc_id and text dealt into ranges of doc_id, each sorted by descending doc_id and followed by the first document of the
    range after it (`guest`), so that a task that reads a range in order sees each document's successor.

    Only range bounds and range maxima come to the driver: as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shares = [i / parts for i in range(1, parts)]
    found = ids.approxQuantile("doc_id", shares, 0.25 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in found})
    number = _range_number(bounds) if bounds else F.lit(0)
    tops = ids.groupBy(number.alias("part")).agg(F.max("doc_id").alias("top")).orderBy(F.desc("part")).collect()
    top, target = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, row in enumerate(tops):
        top[row.part], target[row.part] = row.top, tops[i - 1].part
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                      number.alias("part"))
    top_of = F.element_at(F.lit(top).cast("array<bigint>"), F.col("part") + 1)
    goes = F.element_at(F.lit(target).cast("array<int>"), F.col("part") + 1)
    places = F.when(F.col("doc_id").eqNullSafe(top_of), F.array(
        F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(goes.alias("part"), F.lit(True).alias("guest")),
    )).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("guest"))))
    dealt = own.withColumn("place", F.explode(places)).select("doc_id", "text", "place.part", "place.guest")
    return dealt.repartition(parts, "part").withColumn("tie", F.xxhash64("text")).sortWithinPartitions(
        "part", "guest", F.desc_nulls_last("doc_id"), "tie")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    """The last half of the text replaced by the first code points of the one that follows."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = Sampler()
    texts: list[str] = []
    rows: list[tuple[int, int, int]] = []  # doc_id, its text's number, the next one's
    waiting: tuple[int, int] | None = None
    part, held = None, 0

    def flush() -> pa.RecordBatch:
        edited = [edited_text(texts[own], texts[after]).encode() for _, own, after in rows]
        found = sampler.signatures(*join_utf8([x.encode() for x in texts] + edited))
        own, after = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        mine, changed, other = found[own], found[len(texts):], found[after]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            pa.array(to_hex(mine), pa.string()), pa.array(to_hex(changed), pa.string()),
            pa.array(likeness(mine, changed), pa.float64()), pa.array(likeness(mine, other), pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for doc_id, text, now, guest in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "part", "guest")), strict=True):
            if now != part:
                part, waiting = now, None
            if guest and waiting is None:
                continue  # a second copy of the document that follows
            texts.append(text)
            held += len(text)
            if waiting is not None:
                rows.append((*waiting, len(texts) - 1))
            waiting = None if guest else (doc_id, len(texts) - 1)
            if held >= CHUNK_BYTES and rows:
                yield flush()
                texts, rows = ([texts[-1]], []) if waiting is not None else ([], [])
                waiting = (waiting[0], 0) if waiting is not None else None
                held = sum(map(len, texts))
    if rows:
        yield flush()


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document, of its edited text, and how like they are; one shuffle of the texts."""
    return with_successors(docs).select("doc_id", "text", "part", "guest").mapInArrow(_compare, RESULT)
