"""Hard negatives by an inverted multi-index.

Vectors are cut into two half-spaces, each with a codebook of `CODES` centroids that is fitted on a bounded sample (`SAMPLE` rows, those of the
smallest hashes). A pair of codes is a cell. Inside a shard of rows each code knows its radius, the largest distance of a row to the centroid in
that half. A score cannot exceed the sum, over both halves, of query times centroid and length of the query times radius. The
cells of a shard are visited in descending order of these sums by a multi-sequence heap over the two sorted lists of half-score bounds, and
the visit ends when every window of the anchor is certified: no unvisited cell can hold a row that would change its list.

Positives come first: the best rows of the anchor's label, one window that is open above. Each positive then opens a window of scores in which
the best rows of other labels are wanted; all windows of an anchor share one visit. Shards give the best of each window, a window function merges them.
A search is exact: the codebooks decide how many rows are scored, never which are found.

Defined cases: rows with a null label or vector or with null or non-finite components take no part; missing components of shorter
vectors are zeros; rows of one id are rows of their own; a row without id is no anchor and can be found (as null, after equal scores); an anchor
without positives or a positive without negatives gives no rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .vector_blocks import NO_ID, dealt, id_column, ids_of, matrix_of, meet, parts_of, whole_vectors

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
CODES = 16
#: Rows that the codebooks are fitted on.
SAMPLE = 4096
SHARD_ROWS = 16384
BLOCK_ROWS = 256
#: Rows of visited cells that are scored together.
STEP_ROWS = 512
FOUND = "anchor_row long, anchor_id long, positive int, positive_id long, positive_score long, id long, score long"
NAMES = ["anchor_row", "anchor_id", "positive", "positive_id", "positive_score", "id", "score"]


def codebook(rows: np.ndarray, codes: int = CODES, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centroids by plain k-means; an emptied one starts again at the row farthest from its own."""
    if not rows.shape[1]:
        return np.zeros((1, 0))
    rows = np.unique(rows.astype(np.float64), axis=0)
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = rows[rng.choice(len(rows), min(codes, len(rows)), replace=False)]
    for _ in range(rounds):
        distance = _distances(rows, centres)
        own = distance.argmin(axis=1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(counts == 0)
        sums[empty] = rows[np.argsort(-distance.min(axis=1), kind="stable")[:len(empty)]]
        centres = sums / np.maximum(counts, 1)[:, None]
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, without the rows' own part."""
    return (centres**2).sum(axis=1) - 2 * rows @ centres.T + (rows**2).sum(axis=1)[:, None]


class MultiIndex:
    """The rows of one shard, ordered by cell."""

    def __init__(self, matrix: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        self.cut = books[0].shape[1]
        rows = matrix.astype(np.float64)
        halves = rows[:, :self.cut], rows[:, self.cut:]
        codes = [_distances(h, b).argmin(axis=1) for h, b in zip(halves, books, strict=True)]
        self.books = books
        self.radii = []
        for half, book, code in zip(halves, books, codes, strict=True):
            radius = np.full(len(book), -np.inf)
            np.maximum.at(radius, code, np.linalg.norm(half - book[code], axis=1))
            self.radii.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        self.order = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[self.order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.rows = matrix[self.order]
        self.largest = int(np.abs(matrix).max(initial=0))
        self.floats = rows[self.order]
        self.length = float(np.linalg.norm(rows, axis=1).max(initial=0))

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of the rows at these places of the cell order."""
        if self.largest * int(np.abs(query).max(initial=0)) * len(query) < 1 << 53:  # doubles are exact up to here
            return (self.floats[at] @ query.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ query

    def visit(self, query: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(the most that this cell's or a later row can score, places of the cell's rows), cells in descending order of that bound."""
        parts = query[:self.cut].astype(np.float64), query[self.cut:].astype(np.float64)
        bounds = []
        for part, book, radius in zip(parts, self.books, self.radii, strict=True):
            bound = np.where(np.isfinite(radius), book @ part + np.linalg.norm(part) * np.where(np.isfinite(radius), radius, 0), -np.inf)
            order = np.argsort(-bound, kind="stable")
            order = order[np.isfinite(bound[order])]
            bounds.append((order.tolist(), bound[order].tolist()))
        (first, high), (second, low) = bounds
        if not first or not second:
            return
        slack = 1 + 1e-9 * np.linalg.norm(query.astype(np.float64)) * self.length
        width = len(self.books[1])
        heap = [(-(high[0] + low[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (-(high[i + 1] + low[0]), i + 1, 0))
            if j + 1 < len(second):
                heapq.heappush(heap, (-(high[i] + low[j + 1]), i, j + 1))
            cell = first[i] * width + second[j]
            a, b = self.starts[cell], self.starts[cell + 1]
            yield slack - bound, np.arange(a, b)


class Best:
    """A window: the best `k` candidates with low <= 100 * score <= high."""

    def __init__(self, k: int, low: int | None, high: int | None):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.ones(len(scores), bool)
        if self.low is not None:
            fits &= 100 * scores >= self.low
        if self.high is not None:
            fits &= 100 * scores <= self.high
        if len(self.scores) == self.k:
            fits &= scores >= self.scores[-1]
        if fits.any():
            scores, ids = np.concatenate((self.scores, scores[fits])), np.concatenate((self.ids, ids[fits]))
            order = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[order], ids[order]

    def certified(self, bound: float) -> bool:
        """Nothing that scores `bound` or less can come in."""
        if self.low is not None and self.high is not None and self.low > self.high:
            return True
        if len(self.scores) == self.k and bound < self.scores[-1]:
            return True
        return self.low is not None and 100 * bound < self.low


def search(index: MultiIndex, query: np.ndarray, wanted: np.ndarray, ids: np.ndarray, windows: list[Best]) -> int:
    """Fill the windows with rows that are `wanted` (both arrays in the index's order); returns how many rows were scored."""
    held, count, scored = [], 0, 0

    def score() -> None:
        nonlocal held, count, scored
        at = np.concatenate(held)
        scored += len(at)
        at = at[wanted[at]]
        scores = index.scores(query, at)
        for w in windows:
            w.add(scores, ids[at])
        held, count = [], 0

    for bound, at in index.visit(query):
        if all(w.certified(bound) for w in windows):
            break
        if len(at):
            held.append(at)
            count += len(at)
        if count >= STEP_ROWS:
            score()
    if held:
        score()
    return scored


def _mine(rows: pa.Table, anchors: pa.Table, books: tuple[np.ndarray, np.ndarray], k: int) -> pa.Table:
    """The best rows of each window of each anchor; without positives the window is that of the anchor's own label."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    if not rows.num_rows or not anchors.num_rows:
        return pa.table([pa.array([], t) for t in types], NAMES)
    width = books[0].shape[1] + books[1].shape[1]
    index = MultiIndex(matrix_of(rows["v"], width), books)
    order = index.order
    ids, own, labels = ids_of(rows["id"])[order], np.asarray(rows["row"], np.int64)[order], np.asarray(rows["label"], np.int64)[order]
    queries = matrix_of(anchors["v"], width)
    out = [[] for _ in NAMES]
    for query, anchor in zip(queries, anchors.drop_columns(["v"]).to_pylist(), strict=True):
        positives = anchor.get("positives")
        if positives is None:
            wanted = (labels == anchor["label"]) & (own != anchor["row"])
            windows, of = [Best(k, None, None)], [{"positive": None, "id": None, "score": None}]
        else:
            wanted = labels != anchor["label"]
            of = positives
            windows = [Best(k, LOW * p["score"], HIGH * p["score"]) for p in positives]
        search(index, query, wanted, ids, windows)
        for p, w in zip(of, windows, strict=True):
            n = len(w.scores)
            for column, values in zip(out, ([anchor["row"]] * n, [anchor["id"]] * n, [p["positive"]] * n, [p["id"]] * n, [p["score"]] * n,
                                            [None if i == NO_ID else i for i in w.ids.tolist()], w.scores.tolist()), strict=True):
                column += values
    return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], NAMES)


def _fitted(rows: DataFrame, sample: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both half-spaces; the longest vector sets the width."""
    width = rows.agg(F.max(F.size("v")).alias("w")).first().w or 0
    drawn = rows.select("row", "v").orderBy(F.xxhash64("row", F.lit(3)), "row").limit(sample).toArrow()
    matrix = matrix_of(drawn["v"], width)
    cut = (width + 1) // 2
    return codebook(matrix[:, :cut], codes), codebook(matrix[:, cut:], codes)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, codes: int = CODES,
                   sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; both sides as `whole_vectors` gives them, with `label`."""
    total = rows.count()
    shards, blocks = parts_of(total, shard_rows), parts_of(anchors.count(), block_rows)
    books = _fitted(rows, sample, codes) if total else (np.zeros((0, 0)), np.zeros((0, 0)))
    rows = dealt(rows.select("row", "id", "v", "label"), "shard", shards)
    anchors = dealt(anchors.select("row", "id", "v", "label"), "block", blocks, 1)
    near = meet(rows, anchors, shards, blocks, lambda a, b: _mine(a, b, books, positives), FOUND)
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = near.select("anchor_row", "id", "score", F.row_number().over(order).alias("positive")).where(F.col("positive") <= positives)
    held = checkpoint(best.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("positive", "id", "score")).alias("positives")))
    found = meet(rows, anchors.join(held, "row"), shards, blocks, lambda a, b: _mine(a, b, books, negatives), FOUND)
    order = Window.partitionBy("anchor_row", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def negatives_of_every(vectors: DataFrame, every: int = 100, relabelled: int = 7, labels: int = 10, **sizes: int) -> DataFrame:
    """Hard negatives of each row whose vec_id is divisible by `every`; where it is divisible by `relabelled`, the label moves on by one first."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % relabelled == 0, (label + 1) % labels).otherwise(label)
    named = vectors.where(F.col("label").isNotNull()).withColumn("label", moved)
    rows = whole_vectors(named, also=("label",))
    return hard_negatives(rows, rows.where(F.col("id") % every == 0), **sizes)
