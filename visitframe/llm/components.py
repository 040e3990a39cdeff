"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.session import stage

#: Edges up to which a round's smallest neighbours are broadcast (two short ids each). A round on few edges costs its
#: shuffles, not its work; and a hub's edges then stay where they are.
SMALL_EDGES = 50_000


def _beside(least: DataFrame, small: bool) -> DataFrame:
    """The smallest neighbours as one side of a join: broadcast, or written once so that Spark can split a hub's edges."""
    return F.broadcast(least) if small else stage(least, "least")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(_beside(least, small), "a")
            .select(F.col("m").alias("a"), "b").where("a < b"))


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges are (smaller, larger)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return (edges.join(_beside(least, small), "b")
            .select(F.col("m").alias("a"), F.when(F.col("a") > F.col("m"), F.col("a")).otherwise(F.col("b")).alias("b")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Only stars are left: a node below another one has no second edge."""
    ends = edges.select(F.col("b").alias("x"), F.lit(1).alias("below")).union(edges.select(F.col("a").alias("x"), F.lit(0).alias("below")))
    other = ends.groupBy("x").agg(F.sum("below").alias("below"), F.count("*").alias("n")).where("below > 0 and n > 1")
    return other.agg(F.count("*")).first()[0] == 0


def star_forest(links: DataFrame) -> DataFrame:
    """(a, b) for every node b of `links(a, b)` that is not the smallest of its component; a is the smallest.

    Each round is written to the shared folder; rounds end when only stars are left. Stars of an earlier call may be
    given together with new links, in place of the links they came from.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges = stage(edges, "edges")
    while not _settled(edges):
        small = edges.count() <= SMALL_EDGES
        edges = stage(_small_star(_large_star(edges, small), small), "stars")
    return edges


def connected_components(links: DataFrame) -> DataFrame:
    """(sid, comp) for every node of `links(a, b)`: comp is the smallest node of its component."""
    edges = star_forest(links)
    roots = edges.select(F.col("a").alias("sid")).distinct().withColumn("comp", F.col("sid"))
    return edges.select(F.col("b").alias("sid"), F.col("a").alias("comp")).union(roots)
