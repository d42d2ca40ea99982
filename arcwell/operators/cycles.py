"""Circular dependencies: for each strong component a shortest cycle through its smallest
node, found for all components at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoint
from .graph import COMPACT, follow, stepped, strong_components, weigh


def shortest_cycles(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(component, length, step, from_id, to_id): the edges of a shortest cycle through each
    strong component's smallest node, in order from that node. Of several, each node is
    reached from its smallest predecessor.

    Frontiers run forward from the smallest nodes inside their components, one join a level
    for all, and each reached node keeps its predecessor; a component leaves when an edge
    leads back. The cycles are then read backward, a level a join, a row a component.
    """
    comp = checkpoint(components if components is not None else strong_components(edges))
    e = edges.select("from_id", "to_id").where("from_id <> to_id").distinct()
    inside = e.join(comp.toDF("from_id", "component"), "from_id").join(comp.toDF("to_id", "other"), "to_id").where("component = other")
    inside = checkpoint(inside.select("component", "from_id", "to_id"))
    steps = stepped(inside.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), F.lit(1).alias("sure")))
    front = checkpoint(comp.where("id = component").select("id", "component", F.lit(None).cast("string").alias("parent")))
    seen, levels, closed = front.select("id"), [front], []
    held = weigh(front)
    while held[0]:
        met = checkpoint(follow(steps, front.select("id", "component"), held[1]).groupBy(F.col("there").alias("id"), "component").agg(F.min("here").alias("parent")))
        back = checkpoint(met.where("id = component").select("component", F.col("parent").alias("last"), F.lit(len(levels)).alias("length")))
        closed.append(back)
        going = met.join(back.select("component"), "component", "left_anti")
        front = checkpoint(going.join(seen, "id", "left_anti").select("id", "component", "parent"))
        held = weigh(front)
        levels.append(front)
        seen = seen.union(front.select("id"))
        if len(levels) % COMPACT == 0:
            seen = checkpoint(seen)
    steps.unpersist()
    # From each last node to the first: at step k stands the node of level k.
    out, walk = None, None
    for length in range(len(closed), 0, -1):
        begun = closed[length - 1].select("component", "length", F.col("last").alias("at"), F.col("component").alias("to_id"))
        walk = begun if walk is None else walk.unionByName(begun)
        rows = walk.select("component", "length", F.lit(length).alias("step"), F.col("at").alias("from_id"), "to_id")
        out = rows if out is None else out.union(rows)
        if length > 1:
            back = levels[length - 1].select(F.col("id").alias("at"), "component", "parent")
            walk = checkpoint(walk.join(back, ["component", "at"]).select("component", "length", F.col("parent").alias("at"), F.col("at").alias("to_id")))
    if out is None:
        return inside.where(F.lit(False)).select("component", F.lit(0).alias("length"), F.lit(0).alias("step"), "from_id", "to_id")
    return out


def circular_violations(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(type, severity, from_id, to_id, component, length): an edge of a cycle a row, critical;
    with ``most`` the edges of the first components in order of length and id."""
    found = shortest_cycles(edges)
    out = found.select(F.lit("circular_dependency").alias("type"), F.lit("critical").alias("severity"), "from_id", "to_id", "component", "length", "step")
    return (out.orderBy("length", "component", "step").limit(most) if most else out).drop("step")
