"""Line dedup with a sharded minimal perfect hash over the repeated lines.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys of at least `least_chars` code points that
occur in at least `least_docs` documents are repeated. Their 128-bit hashes are dealt into shards of about `SHARD_KEYS`, and a task
per shard builds its minimal perfect hash (levels of bit vectors; the index of a key is the rank of its bit) and two arrays in
that order: fingerprints of 64 bits, and the largest doc_id holding the key (with the count of documents). Where the
index is within `most_index_bytes` it is broadcast and every document probes the arrays as its text is read: no line is joined
and no text is shuffled. A larger index is not broadcast: then the hashes of lines, never their texts, meet the repeated
keys in an equi join that adaptive execution splits where it is skewed, and each document gets its list of hashes to drop.
Both ways give the same rows.

Defined cases: a null text is one empty line; a document is its doc_id, so repeated rows count once and are treated alike;
a row without doc_id counts as no document and loses every repeated line; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import checkpoint
from .words import mix

LEAST_CHARS = 40
LEAST_DOCS = 5
SHARD_KEYS = 50_000
#: 24 bytes a key at most: about 2.8 million repeated lines.
MOST_INDEX_BYTES = 64 << 20
SPACES = b" \t\n\x0b\x0c\r"
NO_DOC = np.iinfo(np.int64).min


def line_key(line: str, least_chars: int) -> tuple[int, int] | None:
    """The two halves of the key's hash, signed; None for a key that is too short to count."""
    if len(line) < least_chars:
        return None
    key = line.encode().strip(SPACES).lower()
    if len(key) < least_chars or len(key.decode()) < least_chars:
        return None
    low, high = np.frombuffer(xxhash.xxh3_128_digest(key), np.int64)
    return int(low), int(high)


def _keys(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lows, highs = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {line_key(x, least_chars) for x in (text or "").split("\n")} - {None}
                docs += [doc_id] * len(found)
                lows += [k[0] for k in found]
                highs += [k[1] for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, lows, highs)], ["doc_id", "low", "high"])

    return run


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(low, high, docs, keeper) of every key found in at least `least_docs` documents."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    keys = known.mapInArrow(_keys(least_chars), "doc_id long, low long, high long").distinct()
    return keys.groupBy("low", "high").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= least_docs)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: a bit vector a level, keys that collide go one level down."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels  # (size, 64-bit words, keys before each word)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, before, level = [], 0, 0
        while len(keys):
            size = max(64, 2 * len(keys) + 63 & ~63)
            place = cls._place(keys, level, size)
            alone = np.bincount(place, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            levels.append((size, words, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            keys = keys[~alone[place]]
            level += 1
            if level > 200:
                raise ValueError("keys must be distinct")
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; any index or -1 for a key that was not there when the hash was built."""
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            place = self._place(keys[open_], level, size)
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            found[open_[hit]] = (before[place >> 6] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return found

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *(size for size, _, _ in self.levels)], np.int64)
        return head.tobytes() + b"".join(w.tobytes() + b.tobytes() for _, w, b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, count, 8), 8 * (1 + count), []
        for size in map(int, sizes):
            n = size // 64
            levels.append((size, np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n)))
            at += 16 * n
        return cls(levels)


SHARD = "shard int, hash binary, prints binary, keepers binary, counts binary"


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    low, high = rows["low"].to_numpy().view(np.uint64), rows["high"].to_numpy().view(np.uint64)
    keys = mix(low ^ mix(high))
    found = PerfectHash.build(keys)
    order = np.argsort(found(keys))
    counts = np.minimum(rows["docs"].to_numpy(), np.iinfo(np.int32).max).astype(np.int32)
    return pd.DataFrame([(int(rows["shard"].iloc[0]), found.to_bytes(), low[order].tobytes(),
                          rows["keeper"].to_numpy()[order].tobytes(), counts[order].tobytes())],
                        columns=["shard", "hash", "prints", "keepers", "counts"])


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and the arrays it indexes. A shard holds about SHARD_KEYS keys."""
    shard = F.pmod(F.col("low"), F.lit(shards)).cast("int")
    return repeated.withColumn("shard", shard).groupBy("shard").applyInPandas(_build_shard, SHARD)


class Index:
    """The shards as a task holds them."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]], shards: int):
        self.shards = shards
        self.rows = {r[0]: (PerfectHash.from_bytes(r[1]), np.frombuffer(r[2], np.uint64), np.frombuffer(r[3], np.int64)) for r in rows}

    def keepers(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The doc_id that keeps each key's lines; NO_DOC where the key is not repeated."""
        out, shard = np.full(len(low), NO_DOC, np.int64), low % self.shards
        prints, keys = low.view(np.uint64), mix(low.view(np.uint64) ^ mix(high.view(np.uint64)))
        for number in np.unique(shard):
            if (row := self.rows.get(int(number))) is None:
                continue
            mine = np.flatnonzero(shard == number)
            at = row[0](keys[mine])
            true = (at >= 0) & (row[1][at] == prints[mine])
            out[mine[true]] = row[2][at[true]]
        return out


def _output(docs: DataFrame, extra: list[StructField]) -> StructType:
    new = {f.name for f in extra}
    return StructType([f for f in docs.schema.fields if f.name not in new] + extra)


COUNTS = [StructField("n_lines", LongType()), StructField("n_dropped", LongType())]


def _kept_lines(batch: pa.RecordBatch, decide, least_chars: int):
    """Texts without the lines to drop, the number of lines and of dropped ones. `decide` gets lines of a whole batch."""
    lines, at, owner, lows, highs = [], [], [], [], []
    ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
    for row, text in enumerate(batch.column("text").to_pylist()):
        lines.append((text or "").split("\n"))
        for i, line in enumerate(lines[-1]):
            if (key := line_key(line, least_chars)) is not None:
                at.append(i)
                owner.append(row)
                lows.append(key[0])
                highs.append(key[1])
    drop: list[set[int]] = [set() for _ in lines]
    if at:
        for i in np.flatnonzero(decide(batch, np.array(owner), ids, np.array(lows, np.int64), np.array(highs, np.int64))):
            drop[owner[i]].add(at[i])
    texts = ["\n".join(x for i, x in enumerate(all_) if i not in out) if out else "\n".join(all_) for all_, out in zip(lines, drop, strict=True)]
    return texts, [len(x) for x in lines], [len(x) for x in drop]


def _writer(names: list[str], decide, least_chars: int):
    """Batches of the columns `names` with the kept text, n_lines and n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, dropped = _kept_lines(batch, decide, least_chars)
            new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names)

    return run


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                most_index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """`docs` with the kept text, `n_lines` and `n_dropped`; columns of those names are replaced, others stay."""
    spark = docs.sparkSession
    repeated = checkpoint(repeated_lines(docs, least_chars, least_docs))
    keys = repeated.count()
    schema = _output(docs, COUNTS)
    names = schema.fieldNames()
    if keys * 24 <= most_index_bytes:
        shards = max(1, -(-keys // SHARD_KEYS))
        rows = build_index(repeated, shards).select("shard", "hash", "prints", "keepers").collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])
        held: list[Index] = []

        def probe(batch, owner, ids, low, high):
            if not held:
                held.append(Index(sent.value, shards))
            keeper = held[0].keepers(low, high)
            own = np.array([NO_DOC + 1 if x is None else x for x in ids], np.int64)[owner]
            return (keeper != NO_DOC) & (keeper != own)

        return docs.mapInArrow(_writer(names, probe, least_chars), schema)

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys_of = known.mapInArrow(_keys(least_chars), "doc_id long, low long, high long").distinct()
    lost = keys_of.join(repeated, ["low", "high"]).where("doc_id is null or doc_id <> keeper")
    lists = lost.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("low", "high")).alias("_lost"))
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(lists["_id"]), "left").drop("_id")
    joined = joined.withColumn("_lost", F.coalesce(F.transform("_lost", lambda x: F.array(x["low"], x["high"])), F.array().cast(ArrayType(ArrayType(LongType())))))

    def listed(batch, owner, ids, low, high):
        out = [{tuple(x) for x in lost_} for lost_ in batch.column("_lost").to_pylist()]
        return np.array([(int(a), int(b)) in out[row] for row, a, b in zip(owner, low, high, strict=True)])

    return joined.mapInArrow(_writer(names, listed, least_chars), schema)


def line_digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    kept = dedup_lines(docs.select("doc_id", "text"), **settings)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


