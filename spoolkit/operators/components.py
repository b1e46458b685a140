"""Connected components by contraction.

Every round points each vertex at its smallest neighbour, doubles the pointers
until they end at roots, and rewrites the edges between the roots.  A root takes
at least one neighbour with it, so each round at least halves the vertices that
still have edges; rounds and doublings are both logarithmic.  All of it is plain
equi-joins and partial aggregates whose tables are written out to cut lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolkit.storage import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(vertex, component)`` for every vertex that occurs in ``edges``.

    ``component`` is the smallest vertex that can be reached.  Loops and
    repeated edges are allowed, edges with a null end are ignored, and an empty
    input gives an empty result.
    """
    kind = edges.schema[src].dataType
    live = stored(
        edges.select(F.col(src).cast(kind).alias("a"), F.col(dst).cast(kind).alias("b"))
        .where("a is not null and b is not null")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    vertices = live.select(F.col("a").alias("vertex")).union(live.select("b")).distinct()
    steps: list[DataFrame] = []
    live = live.where("a < b")
    while not live.isEmpty():
        both = live.select(F.col("a").alias("v"), F.col("b").alias("w")).union(live.select("b", "a"))
        low = both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        hop = stored(low, "parents")
        while True:
            up = hop.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            further = stored(hop.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parents")
            hop = further.select("v", "p")
            if further.where("moved").isEmpty():
                break
        steps.append(hop)
        of_a = hop.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        of_b = hop.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        live = stored(
            live.join(of_a, "a")
            .join(of_b, "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
    found = vertices.withColumn("component", F.col("vertex"))
    for hop in steps:
        found = found.join(hop.withColumnRenamed("v", "component"), "component", "left").select(
            "vertex", F.coalesce("p", "component").alias("component")
        )
    return found
