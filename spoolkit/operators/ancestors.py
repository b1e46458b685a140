"""Values inherited along parent links, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolkit.storage import stored


def inherited(nodes: DataFrame, scope: str, node: str, parent: str, value: str) -> DataFrame:
    """``scope, node, value``: a node's own value, or that of its nearest ancestor that has one.

    A chain of n links takes log2(n) rounds of one equi-join within a scope
    (such as a file).  Links that lead nowhere or around a cycle give null.
    """
    at = stored(nodes.select(F.col(scope).alias("scope"), F.col(node).alias("node"), F.when(F.col(value).isNull(), F.col(parent)).alias("up"), F.col(value).alias("value")).where("node is not null").groupBy("scope", "node").agg(F.max_by(F.struct("up", "value"), F.struct(F.col("value").isNotNull(), F.coalesce("up", F.lit("")))).alias("x")).select("scope", "node", "x.up", "x.value"), "ancestors")
    rounds = max(1, at.count()).bit_length()
    for _ in range(rounds):
        if at.where("up is not null and value is null").isEmpty():
            break
        above = at.select("scope", F.col("node").alias("up"), F.col("up").alias("next"), F.col("value").alias("theirs"))
        at = stored(at.join(above, ["scope", "up"], "left").select("scope", "node", F.when(F.col("value").isNull() & F.col("theirs").isNull(), F.col("next")).alias("up"), F.coalesce("value", "theirs").alias("value")), "ancestors")
    return at.select(F.col("scope").alias(scope), F.col("node").alias(node), "value")
