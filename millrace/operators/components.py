"""Connected components by stars: edges are replaced by edges to smaller and smaller neighbours until every node points at its root.

A round is two aggregations (the smallest neighbour of each node) and two joins back; the number of rounds grows with the logarithm of
the longest path. No node's neighbours are ever gathered, so a hub costs no large task beyond its join, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.storage import materialize


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b; any one orderable type): the smallest node that it is connected with.

    ``rounds``, if given, gets the number of edges after each round.
    """
    kind = edges.schema["a"].dataType
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    if kind.typeName() == "struct":  # greatest and least take no structs
        up = F.col("a") > F.col("b")
        down = edges.where("a <> b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")).distinct()
    down = materialize(down, "stars")
    while True:
        # Large stars: the neighbours above a node point at the smallest of its neighbours and itself.
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        m = F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), m.alias("v")).distinct()
        large = materialize(large, "stars", instead_of=down)
        # Small stars: the neighbours below a node, and the node, point at the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialize(lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars", instead_of=large)
        n = down.count()
        if rounds is not None:
            rounds.append(n)
        # Stars: each node below one root only, and no root below another.
        if n == down.select("u").distinct().count() and down.select(F.col("v").alias("u")).distinct().join(down, "u", "left_semi").isEmpty():
            break
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
