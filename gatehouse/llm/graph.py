"""Connected components by alternating stars; every step is a join or an aggregate of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_and


#: Parts of each node's edges in the join that brings them their least node.
PARTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with `least`, the smallest of u and all its v.

    The least is added up before the shuffle; it then meets the edges of u in PARTS places, so the centre of a large group is no hot key.
    Both sides grow with the edges: they are merged, never broadcast.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(
        "u", F.least("u", "least").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")
    return edges.withColumn("part", part).join(least.hint("merge"), ["u", "part"]).select("u", "v", "least")


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """One edge (u, v) of each row for each pair of columns: one pass, where a union would make the rows once for each."""
    edges = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])
    return rows.select(F.explode(edges).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    return _pairs(_with_least(edges), ("v", "least"), ("u", "least")).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node of `edges` (columns a, b), root being the smallest node it reaches.

    Loops and repeated edges change nothing; no edges give no rows. The number of rounds grows with the logarithm of the
    longest path; each leaves at most as many edges as it found. Running out of rounds raises an error.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    facts = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    now, state = checkpoint_and(now, *facts)
    for _ in range(rounds):
        before = state
        now, state = checkpoint_and(_small_star(_large_star(now)), *facts)
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
