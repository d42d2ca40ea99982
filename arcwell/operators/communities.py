"""Communities by modularity, moved in parallel.

A level holds nodes (id, strength, community) and links in both directions. In each round
half of the nodes, drawn anew by a hash, move at once to the neighbouring community of the
best gain; the other half holds still, so that neighbours seldom swap. Communities then
become the nodes of the next level by grouping, as long as that adds modularity. Every
step is a join or a grouped aggregation over links: a graph that is one component is as
many tasks as any other. A round is one job that writes its nodes, and one that counts
how many moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import round_checkpoint as checkpoint

#: Rounds of a level at most; a level ends earlier when two rounds together, each half of
#: the nodes, move less than one in CALM of them.
ROUNDS, CALM = 16, 50
#: Modularity that a level must add.
LEAST_GAIN = 1e-6


def _level(nodes: DataFrame, links: DataFrame, total: float) -> DataFrame:
    """(id, strength, community) of nodes (id, strength) and links (a, b, weight), which are there
    in both directions; ``total`` is the strength of all."""
    state = checkpoint(nodes.withColumn("community", F.col("id")).withColumn("moved", F.lit(False)))
    count, before = state.count(), 0
    for turn in range(ROUNDS):
        own = state.select("id", "strength", "community")
        near = links.join(own.select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("weight").alias("weight"))
        # Staying is a choice as well, with whatever links there are.
        choices = near.unionByName(own.select(F.col("id").alias("a"), "community", F.lit(0.0).alias("weight")))
        awake = F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(2)) == 0
        choices = choices.where(awake).groupBy("a", "community").agg(F.sum("weight").alias("weight"))
        sizes = own.groupBy("community").agg(F.sum("strength").alias("size"))
        rated = choices.join(sizes, "community").join(own.toDF("a", "strength", "own"), "a")
        stays = F.col("community") == F.col("own")
        size = F.col("size") - F.when(stays, F.col("strength")).otherwise(0.0)
        gain = F.round(F.col("weight") - size * F.col("strength") / total, 9)
        # Of equal gains staying wins, then the smallest community.
        chosen = rated.groupBy(F.col("a").alias("id")).agg(F.min_by("community", F.struct(-gain, ~stays, "community")).alias("to"))
        to = F.coalesce("to", "community")
        state = checkpoint(own.join(chosen, "id", "left").select("id", "strength", to.alias("community"), (to != F.col("community")).alias("moved")))
        moved = state.where("moved").count()
        if turn and (moved + before) * CALM <= count:
            break
        before = moved
    return state.drop("moved")


def communities(edges: DataFrame, levels: int = 32) -> DataFrame:
    """(id, community) of edges (from_id, to_id, weight): groups of high modularity, named by
    their smallest id. Direction doesn't count, repeated edges add up, self-loops and weights
    that aren't positive are left out. Draws depend on ids alone, so reruns agree."""
    und = edges.where("from_id <> to_id AND weight > 0").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"), F.col("weight").cast("double").alias("weight"))
    und = checkpoint(und.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    links = checkpoint(und.union(und.select("b", "a", "weight")))
    nodes = checkpoint(links.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("strength")))
    member = nodes.select("id", F.col("id").alias("community"))
    total = nodes.agg(F.sum("strength")).first()[0]
    inner, score = 0.0, float("-inf")
    for _ in range(levels if total else 0):
        found = _level(nodes, links, total)
        of = found.select("id", "community")
        joined = links.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").groupBy("ca", "cb").agg(F.sum("weight").alias("weight"))
        joined = checkpoint(joined)
        nodes = checkpoint(found.groupBy(F.col("community").alias("id")).agg(F.sum("strength").alias("strength")))
        inner += joined.where("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        reached = inner / total - nodes.agg(F.sum(F.col("strength") * F.col("strength"))).first()[0] / total / total
        if reached <= score + LEAST_GAIN:
            break
        score = reached
        member = checkpoint(member.join(of.toDF("community", "next"), "community").select("id", F.col("next").alias("community")))
        links = joined.where("ca <> cb").toDF("a", "b", "weight")
    names = member.groupBy("community").agg(F.min("id").alias("name"))
    return member.join(names, "community").select("id", F.col("name").alias("community"))


def modularity(edges: DataFrame, member: DataFrame) -> float:
    """Of an undirected weighted graph (from_id, to_id, weight) and (id, community)."""
    e = edges.where("from_id <> to_id").select("from_id", "to_id", F.col("weight").cast("double").alias("weight"))
    m = member.select("id", "community")
    e = checkpoint(e.join(m.toDF("from_id", "ca"), "from_id").join(m.toDF("to_id", "cb"), "to_id").groupBy("ca", "cb").agg(F.sum("weight").alias("w")))
    total = e.agg(F.sum("w")).first()[0]
    sizes = e.select(F.col("ca").alias("c"), "w").union(e.select("cb", "w")).groupBy("c").agg(F.sum("w").alias("s"))
    within, squares = e.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0], sizes.agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return within / total - squares / (4 * total * total)


def composition(member: DataFrame) -> DataFrame:
    """(community, size, kinds) of (id, community): how many nodes of each kind, the part of an
    id before its colon, as a map."""
    kinds = member.groupBy("community", F.substring_index("id", ":", 1).alias("kind")).agg(F.count("*").alias("n"))
    return kinds.groupBy("community").agg(F.sum("n").alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def coupling(edges: DataFrame, member: DataFrame, n: int | None = None) -> DataFrame:
    """(a, b, weight): edges between each two communities (a < b), in either direction, the
    heaviest ``n`` first."""
    m = member.select("id", "community")
    e = edges.select("from_id", "to_id").join(m.toDF("to_id", "cb"), "to_id").select("from_id", "cb").join(m.toDF("from_id", "ca"), "from_id").where("ca <> cb")
    out = e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("weight"))
    return out.orderBy(F.desc("weight"), "a", "b").limit(n) if n else out
