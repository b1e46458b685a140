"""Ordered scans over tables of any size: one sort in ranges, and one row for each range to carry on.

A window without partition, or with a hot one, puts its rows into one task.  Here all
rows are sorted in ranges of their order; each range is worked through by itself, and
what it needs from the ranges before or after it comes from a table with one row for
each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.storage import stored


def in_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` sorted, with ``part`` (the range) and ``nth`` (ascending over all of them).  Rows of equal order stay in one range."""
    keyed = rows
    names = []
    for i, c in enumerate(order):
        keyed = keyed.withColumn(f"_o{i}", F.col(c) if isinstance(c, str) else c)
        names.append(f"_o{i}")
    placed = stored(keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names).withColumn("nth", F.monotonically_increasing_id()), "ranges")
    return placed.withColumn("part", F.shiftright("nth", 33))


def prefix_sums(rows: DataFrame, values: list[str], *order: str | Column) -> DataFrame:
    """``rows`` with ``n_before`` and, for each of ``values``, ``<value>_before``: the count and the sums (nulls are 0) of all rows before each."""
    placed = in_ranges(rows, *order)
    mine = W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.count("*").alias("n_all"), *(F.sum(F.coalesce(F.col(v), F.lit(0))).alias(f"{v}_all") for v in values))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    carried = totals.select("part", *(F.coalesce(F.sum(f"{v}_all").over(earlier), F.lit(0)).alias(f"{v}_carry") for v in ("n", *values)))
    out = placed.join(F.broadcast(carried), "part")
    inside = {"n": F.count(F.lit(1)).over(mine)} | {v: F.coalesce(F.sum(F.coalesce(F.col(v), F.lit(0))).over(mine), F.lit(0)) for v in values}
    for v, x in inside.items():
        out = out.withColumn(f"{v}_before", F.col(f"{v}_carry") + x)
    return out.drop("part", "nth", *(f"{v}_carry" for v in ("n", *values)))


def neighbours(points: DataFrame, asked: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``asked`` with ``before`` and ``after``: the last of ``points`` of equal ``keys`` below its ``at``, and the first one not below.

    Both are structs of all columns of ``points``, which has a row at most for
    each of (keys, at); null keys or times meet nothing.
    """
    names = asked.columns
    point, question = F.struct(*(F.col(c) for c in points.columns)), F.struct(*(F.col(c) for c in names))
    told = " and ".join(f"{k} is not null" for k in (*keys, at))
    a = points.where(told).select(*keys, at, F.lit(1).alias("is_point"), point.alias("point"), F.lit(None).cast(asked.select(question.alias("q")).schema["q"].dataType).alias("asked"))
    b = asked.where(told).select(*keys, at, F.lit(0).alias("is_point"), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType).alias("point"), question.alias("asked"))
    placed = in_ranges(a.unionByName(b), *keys, at, "is_point", F.monotonically_increasing_id())  # many may ask at one time
    there = F.col("point").isNotNull()
    ends = placed.groupBy("part").agg(F.max_by("point", F.when(there, F.col("nth"))).alias("last"), F.min_by("point", F.when(there, F.col("nth"))).alias("first"))
    up, down = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.orderBy("part").rowsBetween(1, W.unboundedFollowing)  # a row for each range
    carried = ends.select("part", F.last("last", True).over(up).alias("earlier"), F.first("first", True).over(down).alias("later"))
    # both look back in an order of their own: a frame that ends at the partition's end is worked out anew for each row
    so_far = lambda order: F.last("point", True).over(W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    found = placed.withColumn("b", so_far(F.col("nth"))).withColumn("a", so_far(F.col("nth").desc()))
    found = found.where("asked is not null").join(F.broadcast(carried), "part")
    same = lambda x: F.when(F.lit(True) if not keys else _all(F.col(x)[k] == F.col(k) for k in keys), F.col(x))
    full = found.withColumn("b", F.coalesce("b", "earlier")).withColumn("a", F.coalesce("a", "later")).withColumn("before", same("b")).withColumn("after", same("a"))
    met = full.select(*(F.col(f"asked.{c}").alias(c) for c in names), "before", "after")
    nothing = F.lit(None).cast(met.schema["before"].dataType)
    return met.unionByName(asked.where(f"not ({told})").withColumn("before", nothing).withColumn("after", nothing))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def positions(rows: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """``rows`` with ``pos``: each one's place in its ``group`` (not null) by ``order``, from 0."""
    placed = in_ranges(rows, group, *order)
    counts = placed.groupBy(group, "part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range that holds the group
    shifts = counts.select(group, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(shifts, [group, "part"]).withColumn("pos", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def leading(rows: DataFrame, group: str, most: int, *order: str) -> DataFrame:
    """``rows`` among the first ``most`` of their ``group`` by ``order``, with ``nth`` from 1.

    In two stages: each range of the whole order gives its first rows of a
    group, so a group with most of the rows ends as a few for each range.
    """
    near = in_ranges(rows, group, *order)
    first = near.withColumn("_n", F.row_number().over(W.partitionBy(group, "part").orderBy("nth"))).where(F.col("_n") <= most).drop("_n", "part")
    return first.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy("nth"))).where(F.col("nth") <= most)
