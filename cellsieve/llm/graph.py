"""Connected components of undirected edges, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.scratch import new_path, remove, remove_at_exit, write_table


#: Up to this many edges the smallest neighbours of all nodes are broadcast, about 10 MB.
BROADCAST_EDGES = 200_000


def _least(edges: DataFrame, few: bool) -> DataFrame:
    """The smallest neighbour of every node that has a smaller one."""
    least = edges.groupBy(F.col("b").alias("_b")).agg(F.min("a").alias("m"))
    return F.broadcast(least) if few else least


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of the node and its neighbours."""
    return edges.join(_least(edges, few), F.col("a") == F.col("_b"), "left").select(F.coalesce("m", "a").alias("a"), "b")


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    least = _least(edges, few)
    tied = edges.join(least, F.col("b") == F.col("_b")).where("m <> a").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("_b").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or tied to one centre only: a further round would change nothing."""
    ends = edges.select(F.lit(1).alias("as_a"), F.lit(0).alias("as_b"), F.col("a").alias("node")).unionByName(
        edges.select(F.lit(0).alias("as_a"), F.lit(1).alias("as_b"), F.col("b").alias("node")))
    roles = ends.groupBy("node").agg(F.max("as_a").alias("as_a"), F.sum("as_b").alias("as_b"))
    return not roles.agg(F.max((F.col("as_b") > 1) | ((F.col("as_a") == 1) & (F.col("as_b") > 0)))).first()[0]


def components(edges: DataFrame, a: str, b: str, own: bool = True) -> DataFrame:
    """``(node, root)`` of every node with an edge to another; the root is the smallest node of its component.

    Without ``own``, roots have no row of their own. ``edges`` are read several times.

    Large-star and small-star steps in turn until the edges are stars: a number of rounds
    that grows with the logarithm of the longest path. Each round is written to the shared folder.
    Edges lead from the smaller to the larger node. While there are few, joins shuffle nothing, else
    a node with many neighbours costs one aggregated row per task and a join that Spark can split.
    """
    spark = edges.sparkSession
    now = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
    path = None
    while True:
        few = now.count() <= BROADCAST_EDGES
        fresh, half = new_path(spark, "components"), new_path(spark, "large-star")
        # the small star reads it three times
        large = write_table(_large_star(now, few), "large-star", half)
        now = write_table(_small_star(large, few), "components", fresh)
        remove(spark, half)
        if path is not None:
            remove(spark, path)
        path = fresh
        if _are_stars(now):
            break
    remove_at_exit(spark, path)
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    if not own:
        return roots
    return write_table(roots.unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), "roots")
