"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Both tokenizers cut the same bytes. Where tokens of both end at one byte, a group ends; inside a group each stretch between two neighbouring
ends is one link of an A token with a B token. An array, made once from the two vocabularies, gives for each A id the B id of the same bytes. A
group of one token each, whose B id is the one the array gives, is counted in a vector as long as A's vocabulary, per task. All other links
are counted by pair of ids and go through a shuffle, added up before it.

Documents keep their distinct pairs with numbers of links in a table, so texts are encoded once. The counts of the identity pairs and of the
`HOT` most frequent pairs are sent to every task (at most 50,257 and 262,144 rows of 13 bytes); what a document holds beyond these
is joined by pair. A pair outside that list has at most a 262,144th of all links, so no key of the join is hot.

Defined cases: null or empty texts, and texts whose joined bytes differ from space and text in one of the tokenizers, have no tokens (zeros
and an empty digest); repeated rows count each; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, checkpoint, shared_folder
from .packing import Encoder

#: Pairs, beside the identity pairs, whose counts every task holds.
HOT = 1 << 18
#: Distinct pairs that a task adds up before it passes them on.
HELD_PAIRS = 1 << 19
#: A pair of ids is one number: A id times SHIFT and B id.
SHIFT = 16

NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
#: A row of a document, or (row null) pairs of many documents and how often they are linked.
ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
LOOKED_UP = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long, pairs array<long>, times array<long>"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the identity map from A ids to B ids (-1: none)."""

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None = None):
        import sentencepiece

        self.a = Encoder(a_path, a_ranks)
        # strings of special tokens inside a text are plain text here
        self.a.tokenizer.encode_special_tokens = True
        self.a.special = []
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        entries = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        own = {}
        for i in sorted(range(len(self.b_bytes)), key=self.b.is_byte):  # a byte's own piece comes before its hexadecimal one
            own.setdefault(self.b_bytes[i], i)
        self.same = np.array([own.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        numbers = [b"%d" % i for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        a, b = numbers[:len(self.a_bytes)], numbers[:len(self.b_bytes)]
        #: Ids as text with what follows them: a comma inside, a bar or semicolon at the end of a group's side.
        self.words = [x + end for ids, ends in ((a, (b",", b"|")), (b, (b",", b";"))) for end in ends for x in ids]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        # such tokens stand for no text: a byte that no text holds
        return b"\xff" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both tokenizers; none where their bytes are not those of space and text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        spaced = " " + text
        whole = spaced.encode()
        a = np.frombuffer(self.a(spaced), "<u4").astype(np.int64)
        b = self.b.encode(text, num_threads=1)
        # A merges bytes and loses none, so its tokens differ from the text only if their lengths do
        if self.a_length[a].sum() != len(whole) or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return none
        return a, np.array(b, np.int64)


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str, a_ranks: str | None = None) -> Vocabularies:
    """The last ones used: a Python worker builds them once and not for each of its tasks."""
    return Vocabularies(a_path, b_path, a_ranks)


class Aligned:
    """Groups and links of some documents whose tokens stand one document after the other."""

    def __init__(self, words: Vocabularies, a: list[np.ndarray], b: list[np.ndarray]):
        docs = len(a)
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        a_ids, b_ids = np.concatenate(a), np.concatenate(b)
        a_doc = np.repeat(np.arange(docs), self.n_a)
        a_end, b_end = np.cumsum(words.a_length[a_ids]), np.cumsum(words.b_length[b_ids])
        # one place per byte: where tokens end, and how many have ended before
        ends = int(a_end[-1]) + 1 if len(a_end) else 1
        ends_a, ends_b = np.zeros(ends, bool), np.zeros(ends, bool)
        ends_a[a_end], ends_b[b_end] = True, True
        ends_both = ends_a & ends_b
        before_a, before_b, before_both = (np.cumsum(x, dtype=np.int64) - x for x in (ends_a, ends_b, ends_both))
        cuts = np.flatnonzero(ends_a | ends_b)
        at_a, at_b, closing = before_a[cuts], before_b[cuts], ends_both[cuts]
        alone = closing & np.concatenate(([True], closing[:-1]))[:len(closing)]
        self.doc = a_doc[at_a]
        self.linked_a, self.linked_b = a_ids[at_a], b_ids[at_b]
        self.pair = self.linked_a << SHIFT | self.linked_b
        self.exact = alone & (words.same[self.linked_a] == self.linked_b)
        self.n_links = np.bincount(self.doc, minlength=docs)
        self.n_groups = np.bincount(self.doc[closing], minlength=docs)
        a_group, b_group = before_both[a_end], before_both[b_end]
        a_upto, b_upto = (np.cumsum(np.bincount(g, minlength=int(closing.sum()))) for g in (a_group, b_group))
        #: Both sides of each group in turn.
        self.written = np.empty(len(a_ids) + len(b_ids), np.int64)
        size = len(words.a_bytes)
        self.written[np.arange(len(a_ids)) + np.concatenate(([0], b_upto))[a_group]] = a_ids + size * ends_both[a_end]
        self.written[np.arange(len(b_ids)) + a_upto[b_group]] = b_ids + 2 * size + len(words.b_bytes) * ends_both[b_end]

    def digests(self, words: Vocabularies) -> list[str]:
        text = list(map(words.words.__getitem__, self.written.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [hashlib.sha256(b"".join(text[a:b])[:-1]).hexdigest() if b > a else "" for a, b in zip([0, *ends], ends, strict=False)]

    def pairs_by_doc(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, number of links of each, and where each document's pairs end."""
        keys, times = np.unique(self.doc << 40 | self.pair, return_counts=True)
        return keys & ((1 << 40) - 1), times, np.cumsum(np.bincount(keys >> 40, minlength=len(self.n_a)))


class Counts:
    """Numbers of links that a task has seen: identity pairs by A id, the others by pair."""

    def __init__(self, words: Vocabularies):
        self.same = words.same
        self.exact = np.zeros(len(words.same), np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, found: Aligned) -> None:
        self.exact += np.bincount(found.linked_a[found.exact], minlength=len(self.exact))
        fresh, times = np.unique(found.pair[~found.exact], return_counts=True)
        self.pairs, where = np.unique(np.concatenate((self.pairs, fresh)), return_inverse=True)
        times = np.bincount(where, weights=np.concatenate((self.times, times))).astype(np.int64)
        self.times = times if len(times) else np.zeros(0, np.int64)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        found = self.pairs, self.times
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return found

    def flush_exact(self) -> tuple[np.ndarray, np.ndarray]:
        seen = np.flatnonzero(self.exact)
        return seen << SHIFT | self.same[seen], self.exact[seen]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int64()))


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about CHUNK_BYTES together; a longer one stands alone."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > first and held + size > CHUNK_BYTES:
            yield first, i
            first, held = i, 0
        held += size
    if first < len(texts):
        yield first, len(texts)


def encoded(docs: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None) -> DataFrame:
    """A row per document with its groups' digest and its pairs, and rows of counted pairs, as `ENCODED` says; written to a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(a_path, b_path, a_ranks)
        counts = Counts(words)

        def counted(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            nothing = pa.nulls(1, pa.int64())
            end = np.array([len(pairs)])
            return pa.RecordBatch.from_arrays([*[nothing] * 6, pa.nulls(1, pa.string()), _lists(pairs, end), _lists(times, end)], NAMES)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in _steps(texts):
                sides = [words.encode(t) for t in texts[first:last]]
                found = Aligned(words, [a for a, _ in sides], [b for _, b in sides])
                counts.add(found)
                pairs, times, ends = found.pairs_by_doc()
                yield pa.RecordBatch.from_arrays([
                    batch.column("row")[first:last], batch.column("doc_id")[first:last],
                    *(pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                    pa.array(found.digests(words)), _lists(pairs, ends), _lists(times, ends)], NAMES)
                if len(counts.pairs) >= HELD_PAIRS:
                    yield counted(*counts.flush())
        yield counted(*counts.flush())
        yield counted(*counts.flush_exact())

    spark = docs.sparkSession
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    named.mapInArrow(run, ENCODED).write.parquet(folder)
    return spark.read.schema(ENCODED).parquet(folder)


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, times (links in the corpus that hold it) and best (no pair of its B id has more), of `encoded`'s rows."""
    counted = table.where(F.col("row").isNull()).select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = checkpoint(counted.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("times")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    # a row per B id at most: 32,000
    most = counts.groupBy(b_id.alias("b")).agg(F.max("times").alias("most"))
    return checkpoint(counts.join(most, b_id == F.col("b")).select("pair", "times", (F.col("times") == F.col("most")).alias("best")))


def _looked_up(hot: pa.Table):
    known = hot.sort_by("pair")
    keys, totals, best = (np.asarray(known[c].combine_chunks() if known.num_rows else [], t) for c, t in (("pair", np.int64), ("times", np.int64), ("best", np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (np.asarray(batch.column(c).flatten(), np.int64) for c in ("pairs", "times"))
            ends = np.cumsum(np.asarray(batch.column("pairs").value_lengths(), np.int64))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            held = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            values = []
            for known_value in (best, totals):
                part = np.zeros(len(pairs) + 1, np.int64)
                part[1:][held] = times[held] * known_value[at[held]]
                values.append(np.diff(np.cumsum(part)[np.concatenate(([0], ends))]))
            left = np.concatenate(([0], np.cumsum(~held)))[ends]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in NAMES[:7]), *(pa.array(v, pa.int64()) for v in values), _lists(pairs[~held], left), _lists(times[~held], left)],
                [*NAMES[:7], "best", "total", "pairs", "times"])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    table = encoded(docs, a_path, b_path, a_ranks)
    counts = pair_counts(table)
    hottest = counts.orderBy(F.desc("times"), "pair").limit(hot).toArrow()
    looked_up = checkpoint(table.where(F.col("row").isNotNull()).mapInArrow(_looked_up(hottest), LOOKED_UP))
    rest = looked_up.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    met = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("best_rest"), F.sum(F.col("n") * F.col("times")).alias("total_rest"))
    return looked_up.join(met, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("best_rest", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("total_rest", F.lit(0))).alias("count_sum"), "groups_sha256")


def align_documents(docs: DataFrame, **bounds: int) -> DataFrame:
    """The alignment of a byte-level vocabulary of 50,257 ids with a vocabulary of 32,000 pieces."""
    import public_tokenizers

    path = public_tokenizers.path
    return align(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), **bounds)
