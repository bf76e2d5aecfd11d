"""Exact top-k search of vectors by integer inner product, with MaxScore.

Each component is a term: dimension and sign. A shard of rows keeps a posting list for each term (the rows that hold it, in the order of
their ids) and the term's largest magnitude, so a query knows the most that a dimension can add to a score. With the score to
beat, the dimensions of the smallest bounds, as long as their sum stays below it, are non-essential: a row that occurs in none of the other
posting lists cannot compete. Postings of essential terms are traversed and summed; what can still reach the score to beat
is probed in the other terms, from the largest bound down, and dropped as soon as it cannot. A signed term can also lower a score: lowering
terms have the bound 0 and are probed only.

The score to beat is real: each query first meets one shard, chosen by hash, and its k-th best there bounds it in all others. Shards
give at most k rows a query, and a window merges them. Rows times queries is the work; what is held at a time is one shard and one block.

Defined cases: vectors that are null or hold null or non-finite components take no part; missing components of shorter vectors are
zeros; rows of one id are rows of their own, and only the query's own row is no candidate; a row without id asks nothing and can be found (as null, after equal scores);
fewer than k other rows: all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .vector_blocks import cogrouped, dealt, id_column, ids_of, matrix_of, meet, parts_of, whole_vectors

K = 5
SHARD_ROWS = 8192
BLOCK_ROWS = 512
#: Probes between two clean-ups of the candidates.
PROBES = 4
FOUND = "query_row long, query_id long, id long, score long"


class Postings:
    """One shard: rows in the order of their ids, and for each dimension who holds it with which sign."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.columns = np.ascontiguousarray(matrix[order].T)
        self.lists = [{1: np.flatnonzero(c > 0), -1: np.flatnonzero(c < 0)} for c in self.columns]
        self.most = {1: self.columns.max(axis=1, initial=0), -1: -self.columns.min(axis=1, initial=0)}

    def top(self, query: np.ndarray, k: int, least: int | None, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows of score `least` or more, best first; `own` is the query's row."""
        dims = np.flatnonzero(query)
        signs = np.where(query > 0, 1, -1)
        bounds = np.abs(query) * np.where(query > 0, self.most[1], self.most[-1])
        dims = dims[np.argsort(bounds[dims], kind="stable")]
        sums = np.cumsum(bounds[dims])
        optional = 0 if least is None else int(np.searchsorted(sums, least, side="left"))
        rest = int(sums[optional - 1]) if optional else 0
        score = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        for d in dims[optional:]:
            docs = self.lists[d][signs[d]]
            score[docs] += query[d] * self.columns[d, docs]
            seen[docs] = True
        if least is None or least <= 0:  # a row that holds none of the terms has score 0 or less
            seen[:] = True
        seen &= self.rows != own
        if least is not None:
            seen &= score + rest >= least
        found = np.flatnonzero(seen)
        score = score[found]
        lowering = dims[optional:]
        lowering = lowering[np.argsort(-np.abs(query[lowering]), kind="stable")]
        for n, d in enumerate(np.concatenate((lowering, dims[:optional][::-1]))):
            part = query[d] * self.columns[d, found]
            if n < len(lowering):
                part = np.minimum(part, 0)
            else:
                rest -= int(bounds[d])
            score = score + part
            if least is not None and n % PROBES == PROBES - 1:
                held = score + rest >= least
                found, score = found[held], score[held]
        if least is not None:
            found, score = found[score >= least], score[score >= least]
        best = np.argsort(-score, kind="stable")[:k]
        return found[best], score[best]


def _search(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    names = ["query_row", "query_id", "id", "score"]
    if not rows.num_rows or not asked.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    matrix, queries = matrix_of(rows["v"]), matrix_of(asked["v"])
    width = max(matrix.shape[1], queries.shape[1])
    matrix, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (matrix, queries))
    shard = Postings(matrix, ids_of(rows["id"]), np.asarray(rows["row"], np.int64))
    here = int(rows["shard"][0].as_py())
    least, first = asked["least"].to_pylist(), asked["first"].to_pylist()
    parts = []
    for n, (row, key) in enumerate(zip(asked["row"].to_pylist(), asked["id"].to_pylist(), strict=True)):
        if first[n] == here:  # its rows of this shard are known
            continue
        at, score = shard.top(queries[n], k, least[n], row)
        parts.append((np.full(len(at), row), np.full(len(at), key), shard.ids[at], score))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
    return pa.table([pa.array(columns[0]), pa.array(columns[1]), id_column(columns[2]), pa.array(columns[3])], names)


def top_k(rows: DataFrame, asked: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query; both sides as `whole_vectors` gives them."""
    shards, blocks = parts_of(rows.count(), shard_rows), parts_of(asked.count(), block_rows)
    rows = dealt(rows.select("row", "id", "v"), "shard", shards)
    asked = dealt(dealt(asked.select("row", "id", "v"), "first", shards, 1), "block", blocks, 2)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, k)

    start = asked.withColumn("shard", F.col("first")).withColumn("first", F.lit(None).cast("int")).withColumn("least", F.lit(None).cast("long"))
    seeds = checkpoint(cogrouped(rows, start, ["shard"], work, FOUND))
    kth = seeds.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
    found = seeds.unionByName(meet(rows, asked.join(kth, "row", "left"), shards, blocks, work, FOUND))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def top_k_of_every(vectors: DataFrame, every: int = 50, k: int = K, **sizes: int) -> DataFrame:
    """The k best rows of each row whose vec_id is divisible by `every`, among all rows but itself."""
    rows = whole_vectors(vectors)
    return top_k(rows, rows.where(F.col("id") % every == 0), k, **sizes)
