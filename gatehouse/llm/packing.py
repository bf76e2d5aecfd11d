"""Best-fit packing of token pieces into sequences of at most `capacity` tokens, by length patterns.

The histogram of piece lengths (at most `capacity` numbers) is all the driver sees. Patterns of one to three lengths that
fill a sequence exactly are enumerated, non-negative least squares fits how often each is repeated, the counts are rounded
down to what the histogram holds, and what remains is packed by best fit, whole runs of equal lengths at a time. The plan is a list of
slots (length, from which rank, how many, first sequence, place in it). On Spark each piece gets its
rank among the pieces of its length, from counts of (length, bucket) cells, so a length that a third of all pieces
have is spread over all tasks; a binary search in the plan gives its place. No piece is dropped and only texts longer than a sequence are
cut: into pieces of `capacity` tokens counted from the end, so that the first piece may be shorter.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; null doc_ids stay null; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of whole texts as the tokenizer gives them, as little-endian bytes.

    `ranks` is the same vocabulary as byte-pair ranks, for a faster encoder of equal results. It takes the texts that have
    only characters on whose classes all tables agree and no special token; other texts, or all if there are no ranks, go to the tokenizer.
    """

    PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                pairs = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.quick is None or not self.PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ranks: str | None = None) -> DataFrame:
    """One row per piece of each document; the text is read once and no ids are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path, ranks), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[i] for r in rows], t)
                for i, t in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])
            ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def patterns(capacity: int) -> np.ndarray:
    """All ways to fill `capacity` with one, two or three positive lengths, in descending order; unused places are 0."""
    found = [np.array([[capacity, 0, 0]])]
    a = np.arange((capacity + 1) // 2, capacity)
    found.append(np.column_stack([a, capacity - a, np.zeros_like(a)]))
    for first in range(-(-capacity // 3), capacity - 1):
        rest = capacity - first
        second = np.arange(-(-rest // 2), min(first, rest - 1) + 1)
        found.append(np.column_stack([np.full_like(second, first), second, rest - second]))
    return np.concatenate(found)


def fit_counts(ways: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts x of the patterns so that the lengths they use come near the histogram.

    Accelerated projected gradient. Each length's error is weighed by the length, as a short piece left over costs little.
    """
    size = len(histogram)
    weight = np.maximum(np.arange(size), 1) / size
    used = ways > 0
    per_length = np.bincount(ways[used], minlength=size)
    step = 1.0 / (3 * (weight**2 * per_length).max())

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(ways[:, i], weights=x * used[:, i], minlength=size) for i in range(3))

    x = y = np.zeros(len(ways))
    momentum = 1.0
    for _ in range(rounds):
        slope = weight**2 * (forward(y) - histogram)
        slope[0] = 0
        following = np.maximum(0, y - step * slope[ways].sum(axis=1))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = following + (momentum - 1) / faster * (following - x)
        x, momentum = following, faster
    return x


def _take(plan: list, left: np.ndarray, lengths: list[int], times: int, sequence: int) -> int:
    """Use a pattern `times` times: `left` shrinks and the plan gets one entry per different length."""
    offset, entries = 0, {}
    for length in lengths:
        entries.setdefault(length, []).append(offset)
        offset += length
    for length, offsets in entries.items():
        plan.append((length, offsets[0], len(offsets), times, sequence))
        left[length] -= times * len(offsets)
    return sequence + times


def plan_slots(histogram: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, end rank, occurrences in the pattern, first sequence, first offset), by length and rank."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    if left.sum():
        ways = patterns(capacity)
        counts = fit_counts(ways, left.astype(float))
        for index in np.argsort(-counts, kind="stable"):
            if counts[index] < 0.5:
                break
            lengths = [int(v) for v in ways[index] if v]
            most = min(int(left[v]) // lengths.count(v) for v in set(lengths))
            if (times := min(round(counts[index]), most)) > 0:
                sequence = _take(plan, left, lengths, times, sequence)
    while left.any():  # best fit, the longest first; each turn uses up a length or a pattern's shortest run
        lengths, room, free = [], capacity, left.copy()
        while room and len(fits := np.flatnonzero(free[:room + 1])):
            lengths.append(int(fits[-1]))
            free[fits[-1]] -= 1
            room -= lengths[-1]
        times = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        sequence = _take(plan, left, lengths, times, sequence)
    rows, rank = [], np.zeros(len(histogram), np.int64)
    for length, offset, occurrences, times, first in plan:
        rows.append((length, rank[length], rank[length] + occurrences * times, occurrences, first, offset))
        rank[length] += occurrences * times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _placed(plan: np.ndarray, schema_names: list[str]):
    shift = np.int64(1) << np.int64(40)  # ranks of a length stay below it
    keys = plan[:, 0] * shift + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)) for n in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * shift + rank, side="right") - 1] if len(length) else plan[:0]
            within = rank - row[:, 1]
            # a length that a pattern holds several times stands there in a row
            sequence = row[:, 4] + within // np.maximum(row[:, 3], 1)
            offset = row[:, 5] + within % np.maximum(row[:, 3], 1) * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in schema_names), pa.array(sequence), pa.array(offset)],
                [*schema_names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with `sequence_id` and `offset`."""
    spark = pieces.sparkSession
    pieces = checkpoint(pieces)
    lengths = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, count in lengths.items():
        histogram[length] = count
    plan = plan_slots(histogram, capacity)
    buckets = 4 * shuffle_partitions(spark)
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    dealt = pieces.withColumn("bucket", cell)
    cells = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(inside)).join(firsts, ["length", "bucket"])
    names = pieces.columns
    ranked = ranked.select(*names, (F.col("first") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(_placed(plan, names), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents cut and packed. `path` names a tokenizer of one's own; without it, the public one and its ranks are used."""
    ranks = ranks_path() if path is None else None
    return pack(token_pieces(docs, path or tokenizer_path(), capacity, end_id, ranks), capacity)
