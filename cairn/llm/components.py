"""Connected components of an edge table, by repeated contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``: one row per node that has an edge.

    Each round lets every node point to the neighbour (or itself) that comes first in an order hashed
    anew for the round, then contracts the graph along those pointers. The hashed order shortens chains
    by a constant factor a round, so the number of rounds is logarithmic. Each round is a grouped
    minimum and two joins over what is left; nothing is collected. Self-loops, repeated and null edges
    are ignored; an empty table gives an empty result.
    """
    current = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "cc-edges")
    labels, seed = None, 0
    while True:
        empty = current.isEmpty()
        if empty and labels is not None:
            release(current)
            return labels
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = current.select("a", "b").union(current.select(F.col("b"), F.col("a")))
        parents = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["v"].alias("root"))
        if empty:
            return parents
        parents = materialize(parents, "cc-parents")
        spent = [current]
        if labels is not None:
            moved = parents.select(F.col("node").alias("root"), F.col("root").alias("to"))
            named = materialize(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-labels")
            spent += [labels]
        to_a, to_b = (parents.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        contracted = current.join(to_a, "a").join(to_b, "b").where("ra <> rb")
        current = materialize(contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        if labels is not None:
            spent += [parents]
        labels = parents if labels is None else named
        release(*spent)
        seed += 1
