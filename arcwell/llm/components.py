"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, checkpoint, join_one, rows


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node points at one smaller node that points at none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where("out > 1 OR out = 1 AND into = 1").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (u, v) but the smallest of each
    component: label is the smallest node reachable. Each round's edges are
    checkpointed; neighbourhoods are only ever reduced to their minimum, so a hub needs
    no list of its neighbours, and a hub's edges are joined where they lie."""
    edges = checkpoint(_ordered(links))
    while not _stars(edges):
        few = 2 * rows(edges) <= BROADCAST_ROWS  # of nodes, so of minima

        def joined(many: DataFrame, few: bool = few) -> DataFrame:
            least = many.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            return many.join(F.broadcast(least.drop("n")), "u") if few else join_one(many, least, "u", "n")

        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        large = _ordered(joined(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
        large = large if few else checkpoint(large)
        # Each end goes to the least of the neighbours, and the node itself with it.
        met = joined(large)
        edges = checkpoint(_ordered(met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
