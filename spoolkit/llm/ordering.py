"""The place of each row in its group, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoolkit.storage import stored


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``: the place of each row in its ``group`` (never null) by ``order``, from 0.

    All rows are sorted in ranges of (group, order).  A row's place is that in its
    range, and what the ranges before it hold of its group.  Rows that are equal in
    ``order`` stay in one range, so ``order`` should end with a column that tells
    them apart.
    """
    keys = (group, *order)
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(group).orderBy("part")) - F.col("n")  # a row for each range that holds the group
    return placed.join(counts.select(group, "part", (before - F.col("first")).alias("shift")), [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")
