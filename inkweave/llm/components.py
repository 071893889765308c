"""Connected components of a graph by star operations, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.store import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.where("b > a").join(least, "a")
    return linked.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another; the component is its least node.

    Alternates large and small stars until nothing moves: about log(nodes) rounds, fewer for the shallow graphs that
    near duplicates make. Every round is written to the shared folder, which cuts the lineage. Null ends and loops
    are left out; repeated links do not matter; no links give no rows.
    """
    current = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    current = written(current.where("a != b").distinct(), "links")
    mark = None
    while True:
        current = written(_small_star(_large_star(current)), "stars")
        # a fixed point is a star: every greater node linked once, to the least of its component
        totals = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if totals == mark:
            break
        mark = totals
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
