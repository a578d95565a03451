"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; every round is written to the shared folder, which
cuts the lineage.  A hub with very many neighbours never has them gathered:
its least neighbour is a partially aggregated minimum, and its edges meet that
by a broadcast of the hubs alone, of which there are under a thousand
(``join_hot``), while the edges of other nodes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_hot, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m, n): the least neighbour of each node, and how many it has."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of orderable ids to (node, component), the component being its least node.

    Loops and repeated edges do no harm; nodes without edges do not appear.
    Both steps keep the components: a large-star step links each greater
    neighbour of a node to the least of the node and its neighbours, a
    small-star step does so for the lesser neighbours.  When nothing changes,
    all nodes hang from their least one.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # large star: every node u, all its neighbours v > u
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both.where("v > u"), m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), "large")
        # small star: every node u, its lesser neighbours v; edges already point from greater to lesser
        small = join_hot(large, _least(large), "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        cur = materialize(small, "edges")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        # every node once, pointing at a node that points nowhere: nothing can change
        if now[0] == now[2] and cur.select("v").join(cur.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty() or tuple(now) == mark:
            break
        mark = tuple(now)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
