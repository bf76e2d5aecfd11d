"""Exact order and text assembly inside groups of any size.

A window or a collect over one key puts the whole group into one task. Both
helpers cut a group into cells first: `cells` are coarse columns that never
contradict the order (a range of the leading order column, such as `seq div 1024`
or the month of a date). Only the small per-cell counts or strings meet per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_ordinal(df: DataFrame, keys: list[str], order: list[Column], cells: list[Column],
                  name: str = "ordinal", total: str | None = None, weight: str | None = None) -> DataFrame:
    """row_number() over (keys; order), worked out per cell plus the count of earlier cells.

    With `weight`, a row stands for so many rows and gets the number of the first of them.

    With several cells each one refines the one before it: earlier rows are counted
    level by level, so a level only ever orders the values of its own cell.
    """
    marks = [f"__cell{i}" for i in range(len(cells))]
    marked = df.select("*", *[cell.alias(mark) for cell, mark in zip(cells, marks)])
    offsets = None
    for level in range(len(marks), 0, -1):
        group, last = [*keys, *marks[:level]], marks[level - 1]
        source = marked if offsets is None else offsets
        rows = F.sum("__rows") if offsets is not None else F.sum(weight) if weight else F.count(F.lit(1))
        counts = source.groupBy(*group).agg(rows.alias("__rows"))
        ahead = Window.partitionBy(*keys, *marks[:level - 1]).orderBy(last)
        before = F.coalesce(F.sum("__rows").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        extra = [F.sum("__rows").over(Window.partitionBy(*keys)).alias(total)] if total and level == 1 else []
        counts = counts.select(*group, "__rows", before.alias("__ahead"), *extra)
        if offsets is None:
            offsets = counts.withColumnRenamed("__ahead", "__before")
        else:
            offsets = offsets.alias("o").join(counts.alias("c"), _same("o", "c", group)).select(
                *[F.col(f"o.{c}") for c in [*keys, *marks, "__rows"]],
                (F.col("o.__before") + F.col("c.__ahead")).alias("__before"),
                *([F.col(f"c.{total}")] if extra else []))
    inside = Window.partitionBy(*keys, *marks).orderBy(*order)
    earlier = F.row_number().over(inside) if weight is None else F.coalesce(
        F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    ranked = marked.withColumn("__inside", earlier).alias("r")
    kept = [F.col(f"r.{c}") for c in df.columns] + ([F.col(f"o.{total}")] if total else [])
    return ranked.join(offsets.alias("o"), _same("r", "o", [*keys, *marks])).select(
        *kept, (F.col("r.__inside") + F.col("o.__before")).alias(name))


#: Rows from which a cell is cut, names that cut it (about so many, chosen by hash), and places where rows meet what is known of their cell.
CROWDED, BOUNDS, SALTS = 512, 256, 16


def name_cells(df: DataFrame, keys: list[str], cells: list[Column], name: str) -> tuple[DataFrame, list[str]]:
    """Adds cells that follow the order of a text column, where the given cells hold more than `CROWDED` rows.

    A counting pass finds the crowded cells, and names of them, chosen by hash, are bounds: a row's cell is the number of
    bounds up to its name. Rows meet their cell in `SALTS` places, so a crowded one is no hot key.
    Returns the frame and the names of its cell columns, the given cells first.
    """
    marks = [f"__level{i}" for i in range(len(cells))]
    df = df.select("*", *[cell.alias(mark) for cell, mark in zip(cells, marks)])
    group = [*keys, *marks]
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
    crowded = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CROWDED).select(*group, "__n", spread)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("bound"), F.col(f"l.{name}")), 1) < F.lit(float(BOUNDS)) / F.col("r.__n") * F.lit(2.0**63)
    drawn = salted.alias("l").join(crowded.alias("r"), _same("l", "r", [*group, "__salt"])).where(chance).select("l.*")
    bounds = drawn.groupBy(*group).agg(F.sort_array(F.collect_set(name)).alias("__bounds")).select(*group, "__bounds", spread)
    met = salted.alias("l").join(bounds.alias("r"), _same("l", "r", [*group, "__salt"]), "left")
    mark = f"__level{len(marks)}"
    place = F.size(F.filter("r.__bounds", lambda b: b <= F.col(f"l.{name}")))
    cut = F.when(F.col("r.__bounds").isNotNull(), place).otherwise(0)
    return met.select(*[F.col(f"l.{c}") for c in df.columns], cut.alias(mark)), [*marks, mark]


#: Rows that one window orders at most, and buckets of groups, by hash, that are counted to find larger groups.
WHOLE, BUCKETS = 1 << 16, 1 << 16


def spot_ordinal(df: DataFrame, keys: list[str], place: Column, name: str, cells: list[Column], ordinal: str = "ordinal", total: str = "total") -> DataFrame:
    """row_number() over (keys; place, name) of wide rows, and the size of each group, however many rows a group or one place has.

    A first pass counts rows by a hash of the keys: one number per bucket and task is shuffled. Buckets of at most `WHOLE` rows hold no
    larger group: their rows are ordered by one window, and what follows by the same keys needs no other shuffle. The rows of larger
    buckets, of which there are at most one for `WHOLE` rows of the input, are numbered in cells.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    large = [row.bucket for row in counts.where(F.col("n") > WHOLE).select("bucket").collect()]
    placed = df.withColumn("__place", place)
    whole = placed.where(~bucket.isin(large)) if large else placed
    inside = Window.partitionBy(*keys).orderBy("__place", name)
    everything = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered_ = whole.select(*df.columns, F.row_number().over(inside).cast("long").alias(ordinal), F.count(F.lit(1)).over(everything).alias(total))
    return numbered_.unionByName(_spot_in_cells(placed.where(bucket.isin(large)), keys, name, cells, ordinal, total)) if large else numbered_


def _spot_in_cells(placed: DataFrame, keys: list[str], name: str, cells: list[Column], ordinal: str, total: str) -> DataFrame:
    """The distinct (place, name) of a group, narrow rows with a count, are numbered in cells: the given ones, and inside a crowded one
    cells of names. The wide rows meet their number by (keys, place, name) and are shuffled for nothing else.
    """
    spot = [*keys, "__place", name]
    spots, marks = name_cells(placed.groupBy(*spot).agg(F.count(F.lit(1)).alias("__copies")), keys, cells, name)
    numbered_ = split_ordinal(spots, keys, [F.col("__place"), F.col(name)], [F.col(m) for m in marks], "__first", total, "__copies")
    copy = F.row_number().over(Window.partitionBy(*spot).orderBy(name))
    rows, numbers = placed.withColumn("__copy", copy).alias("l"), numbered_.alias("r")
    return rows.join(numbers, _same("l", "r", spot)).select(
        *[F.col(f"l.{c}") for c in placed.columns if c != "__place"], (F.col("r.__first") + F.col("l.__copy") - 1).alias(ordinal), F.col(f"r.{total}").alias(total))


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def unnested(df: DataFrame, columns: list[str], array: Column, name: str) -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes the optimizer test the array for emptiness below the explode,
    which computes it twice; the outer form does not, and its empty rows are dropped here.
    """
    return df.select(*columns, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """`df` with a computed struct that many later expressions read.

    A projection above another one takes the computation of a struct's fields into each place that reads them, also
    into the lambdas that run per element. The element of an unnested array of one stays a value of the row.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def joined_text(df: DataFrame, keys: list[str], order: Column, text: Column, cell: Column,
                separator: str, name: str = "text") -> DataFrame:
    """Texts of a group in order, joined per cell first and then cell by cell."""
    rows = df.select(*keys, cell.alias("__cell"), order.alias("__order"), text.alias("__text"))
    pieces = rows.groupBy(*keys, "__cell").agg(
        F.array_sort(F.collect_list(F.struct("__order", "__text"))).alias("__rows"))
    pieces = pieces.select(*keys, "__cell", F.concat_ws(
        separator, F.transform("__rows", lambda row: row["__text"])).alias("__piece"))
    whole = pieces.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__cell", "__piece"))).alias("__pieces"))
    return whole.select(*keys, F.concat_ws(
        separator, F.transform("__pieces", lambda row: row["__piece"])).alias(name))
