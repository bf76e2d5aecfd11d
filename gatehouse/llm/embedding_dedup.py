"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside them, one representative per group.

Equal vectors are one node (its key is the 64-bit hash of its components). Vectors of different lengths never link: each length has cells of
its own. Centroids are fitted on the driver on a sample of the nodes, of `SAMPLE_PER_CELL` vectors a cell and of `FIT_BYTES` at most for all
lengths together, by products of `FIT_STEP` values. The `FITTED_LENGTHS` most common lengths have centroids; each rarer one is a single cell,
compared whole in blocks. Every node of a fitted length is then assigned to the nearest
centroid (its home) and to each other cell whose centroid is at most `margin` farther in cosine, where it is a guest. A pair of cosine `threshold` whose difference has no preferred direction lands in each other's cell with
high probability; `tests/llm` measures recall against brute force. Inside a cell the home vectors are cut into blocks and compared
with blocks of all members, in double precision; a block pair is a group of bounded size, so a cell that holds a third of all vectors is
many tasks. A block pair gives counts of links per node and a spanning forest of its links, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; repeated rows and equal vectors count as other vectors; rows without vec_id link with nothing and are not
kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import components

THRESHOLD = 0.95
MARGIN = 0.15
#: Vectors that k-means looks at, per cell.
SAMPLE_PER_CELL = 32
#: Ceiling of the sample that the driver holds as doubles, whatever the table's size: 65,536 vectors of 64 components.
FIT_BYTES = 32 << 20
FITTED_LENGTHS = 64
#: Values of one product of sample and centroids.
FIT_STEP = 1 << 22
HOME_BLOCK = 1024
MEMBER_BLOCK = 2048


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids; an emptied cell starts again at the vector that is farthest from its own."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = unit(rows)
    centres = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    step = max(1, FIT_STEP // len(centres))
    for _ in range(rounds):
        own, nearest = np.empty(len(rows), np.int64), np.empty(len(rows))
        for i in range(0, len(rows), step):
            likeness = rows[i:i + step] @ centres.T
            own[i:i + step], nearest[i:i + step] = likeness.argmax(axis=1), likeness.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        worst = np.argsort(nearest)
        empty = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-9)
        sums[empty] = rows[worst[:len(empty)]]
        centres = unit(sums)
    return centres


def marked_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, v (the components as doubles) and whether the row can have links, whatever its length."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(key).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    # adding zero makes -0.0 and 0.0 one value
    even = F.transform(v, lambda x: x + F.lit(0.0))
    return vectors.select(F.col(key).cast("long").alias("vec_id"), even.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _cells_of(fitted: dict[int, tuple[int, np.ndarray]], margin: float):
    """`fitted`: for a length the number of its first cell and its centroids; the cell of any other length is its negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths(), np.int64)
            for width in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == width))
                first, centres = fitted.get(width, (-width, np.zeros((1, width))))
                likeness = unit(_matrix(part.column("v"), width)) @ centres.T
                home = (first + likeness.argmax(axis=1)).astype(np.int32)
                inside = likeness >= likeness.max(axis=1, keepdims=True) - margin
                row, cell = np.nonzero(inside)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(inside.sum(axis=1)))), pa.int32()), pa.array(first + cell, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("copies"), part.column("v"), pa.array(home), lists],
                                                 ["node", "copies", "v", "home", "cells"])

    return run


def _fitted(nodes: DataFrame, cells: int | None) -> dict[int, tuple[int, np.ndarray]]:
    """Centroids of the most common lengths, from a bounded sample that is chosen by hash and without a sort."""
    size = F.size("v")
    common = nodes.groupBy(size.alias("width")).count().orderBy(F.desc("count"), "width").limit(FITTED_LENGTHS).collect()
    wanted, chosen = {}, F.lit(False)
    for width, count in common:
        wanted[width] = cells or max(1, round(count**0.5))
        most = min(SAMPLE_PER_CELL * wanted[width], max(1, FIT_BYTES // len(common) // (8 * width)))
        drawn = F.lit(True) if most >= count else F.shiftrightunsigned(F.xxhash64("node"), 1) < int(most / count * 2**63)
        chosen = chosen | ((size == width) & drawn)
    sample = nodes.where(chosen).select("node", "v").toArrow().sort_by("node")["v"].combine_chunks()
    lengths = np.asarray(sample.value_lengths(), np.int64)
    found, first = {}, 0
    for width, count in wanted.items():
        rows = sample.filter(pa.array(lengths == width))
        if len(rows):
            centres = spherical_kmeans(_matrix(rows, width), count)
            found[width] = first, centres
            first += len(centres)
    return found


BLOCK_RESULT = "node long, links long, root long"


def _compare(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block of home vectors with one block of members of the same cell.

    A pair of one home cell is met from both its sides and counts for the side that is at home here. A pair of two home cells counts
    here for both, unless it also meets in the other cell and that one has the smaller number.
    """
    here = int(rows["cell"].iloc[0])
    host, member = rows[rows["host"]], rows[~rows["host"]]
    empty = pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
    if host.empty or member.empty:
        return empty
    left = unit(np.stack(host["v"].to_numpy()).astype(np.float64))
    right = unit(np.stack(member["v"].to_numpy()).astype(np.float64))
    node, other = host["node"].to_numpy(), member["node"].to_numpy()
    i, j = np.nonzero(left @ right.T >= threshold)
    different = node[i] != other[j]
    i, j = i[different], j[different]
    if not len(i):
        return empty
    home = member["home"].to_numpy()[j]
    cells = host["cells"].to_numpy()
    width = np.int64(1) << 32
    guests = np.concatenate([k * width + np.asarray(c, np.int64) for k, c in enumerate(cells)])  # sorted: cells ascend
    wanted = i * width + home
    at = np.searchsorted(guests, wanted)
    also_there = guests[np.minimum(at, len(guests) - 1)] == wanted
    cross = home != here
    counted = ~cross | ~also_there | (here < home)
    i, j, cross = i[counted], j[counted], cross[counted]
    copies, copies_other = host["copies"].to_numpy(), member["copies"].to_numpy()
    counts_left = np.bincount(i, weights=copies_other[j], minlength=len(node)).astype(np.int64)
    counts_right = np.bincount(j[cross], weights=copies[i[cross]], minlength=len(other)).astype(np.int64)
    root, root_other = node.copy(), other.copy()
    while True:  # the smallest node reachable inside the block
        before = root.copy(), root_other.copy()
        np.minimum.at(root_other, j, root[i])
        np.minimum.at(root, i, root_other[j])
        if (before[0] == root).all() and (before[1] == root_other).all():
            break
    out = pd.DataFrame({"node": np.concatenate([node, other]), "links": np.concatenate([counts_left, counts_right]),
                        "root": np.concatenate([root, root_other])})
    return out[(out["links"] > 0) | (out["node"] != out["root"])]


def linked_nodes(nodes: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, cells: int | None = None) -> DataFrame:
    """(node, links, root) per block pair that found links, of nodes (node, copies, v)."""
    placed = checkpoint(nodes.mapInArrow(_cells_of(_fitted(nodes, cells), margin), "node long, copies long, v array<double>, home int, cells array<int>"))
    homes = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("hosts"))
    members = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("members"))
    blocks = homes.join(members, "cell").select(
        "cell", F.ceil(F.col("hosts") / HOME_BLOCK).cast("int").alias("rows"), F.ceil(F.col("members") / MEMBER_BLOCK).cast("int").alias("cols"))
    h = F.xxhash64("node")
    hosts = placed.withColumn("cell", F.col("home")).join(blocks, "cell").select(
        "cell", F.pmod(h, F.col("rows")).alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"),
        F.lit(True).alias("host"), "node", "copies", "v", "home", "cells")
    guests = placed.withColumn("cell", F.explode("cells")).join(blocks, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), F.pmod(h, F.col("cols")).alias("c"),
        F.lit(False).alias("host"), "node", "copies", "v", "home", F.lit(None).cast("array<int>").alias("cells"))
    dealt = hosts.select("cell", F.col("r").cast("int"), F.col("c").cast("int"), *hosts.columns[3:]).union(
        guests.select("cell", F.col("r").cast("int"), F.col("c").cast("int"), *guests.columns[3:]))
    return dealt.groupBy("cell", "r", "c").applyInPandas(lambda rows: _compare(rows, threshold), BLOCK_RESULT)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, cells: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    marked = marked_vectors(vectors)
    alone = marked.where(~F.col("good")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    valid = marked.where("good").select("vec_id", F.xxhash64("v").alias("node"), "v")
    classes = checkpoint(valid.select("vec_id", "node").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    # one vector of each node carries its components; of repeated ids any, as they are equal
    named = classes.withColumnRenamed("least", "vec_id")
    nodes = checkpoint(valid.join(named, ["node", "vec_id"]).select("node", "copies", "v").dropDuplicates(["node"]))
    found = checkpoint(linked_nodes(nodes, threshold, margin, cells))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "node", "left").join(roots, "node", "left").select(
        "node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    known = checkpoint(known)
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(names, "root").select("node", "n_links", "component_id")
    rows = valid.select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(alone)
