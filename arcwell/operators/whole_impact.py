"""Who depends on every node, for all nodes at once.

Two phases, both a level at a time over frontiers:

* Lists. Each node keeps what reaches it, in order of (level, id), until nothing is new or
  there are more than ``exact``. A node passes on at most ``exact`` + 1 of its dependents, the
  smallest: enough to know that a list is too long, and for its first entries, and a hub
  costs what any node costs.
* Sketches, for the nodes whose lists are too long alone. A sketch begins with the direct
  dependents and the whole lists of those that have one, and travels along the edges
  between such nodes until no estimate grows; a node whose estimate hasn't grown says
  nothing. A sketch has a fixed size, whatever it counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import round_checkpoint as checkpoint
from .graph import COMPACT, FRONT_BYTES, follow, stepped, weigh

#: Counts up to here are exact, longer ones estimated (the contract's bound of a list).
EXACT = 200
#: Direct and transitive dependents that a row shows (fixed values).
SHOWN = (30, 100)
#: Sketches have 2**LG_K registers of at most a byte: a standard error of 1.04 / 2**(LG_K / 2).
LG_K = 12


def _lists(pairs: DataFrame, exact: int) -> DataFrame:
    """(id, found, whole) of pairs (here, there): dependents in order of (level, id); whole
    ones have at most ``exact``."""
    first = Window.partitionBy("here").orderBy("there")
    some = pairs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= exact + 1).drop("_n")  # limited before the shuffle
    near = checkpoint(some.groupBy("here").agg(F.array_sort(F.collect_list("there")).alias("near")))
    open_lists = near.select(F.col("here").alias("id"), F.col("near").alias("found"), F.col("near").alias("front"))
    done = None
    rounds = 0
    while True:
        # A list that has too many is settled, and so is one that its last level didn't lengthen.
        settled = (F.size("found") > exact) | (F.size("front") == 0)
        ready = open_lists.where(settled).select("id", "found", (F.size("found") <= exact).alias("whole"))
        done = ready if done is None else done.union(ready)
        open_lists = open_lists.where(~settled)
        if open_lists.isEmpty():
            return checkpoint(done)
        steps = open_lists.select("id", F.explode("front").alias("here")).join(near, "here").select("id", F.explode("near").alias("there"))
        met = steps.groupBy("id").agg(F.collect_set("there").alias("met"))
        fresh = F.array_sort(F.array_except(F.coalesce("met", F.array().cast("array<string>")), "found"))
        open_lists = checkpoint(open_lists.join(met, "id", "left").select("id", F.concat("found", fresh).alias("found"), fresh.alias("front")))
        rounds += 1
        if rounds % COMPACT == 0:
            done = checkpoint(done)


def _estimates(pairs: DataFrame, lists: DataFrame, lg_k: int, rounds: int | None) -> DataFrame:
    """(id, n) of the nodes whose list isn't whole, after ``rounds`` at most."""
    large = checkpoint(lists.where("NOT whole").select("id"))
    # While the ids are few, the pairs meet them where they lie.
    ids = F.broadcast(large) if weigh(large)[1] <= FRONT_BYTES else large
    own = checkpoint(pairs.join(ids.withColumnRenamed("id", "here"), "here", "left_semi"))
    whole = lists.where("whole").select(F.col("id").alias("there"), "found")
    told = own.join(whole, "there", "left").select("here", F.explode(F.concat(F.array("there"), F.coalesce("found", F.array().cast("array<string>")))).alias("x"))
    begun = told.groupBy(F.col("here").alias("id")).agg(F.hll_sketch_agg("x", F.lit(lg_k)).alias("s"))
    known = checkpoint(begun.groupBy("id").agg(F.hll_union_agg("s").alias("s")).withColumn("n", F.hll_sketch_estimate("s")))
    between = own.join(ids.withColumnRenamed("id", "there"), "there", "left_semi").select(F.col("there").alias("here"), F.col("here").alias("there"), F.lit(1).alias("sure"))
    steps = stepped(between)
    front = known.select("id", "s")
    turn = 0
    while (rounds is None or turn < rounds) and not front.isEmpty():
        turn += 1
        held = front.count() * ((1 << lg_k) + 64)
        met = follow(steps, front, held).groupBy(F.col("there").alias("id")).agg(F.hll_union_agg("s").alias("t"))
        grown = known.join(met, "id").select("id", F.hll_union("s", "t").alias("s"), F.col("n").alias("before")).withColumn("n", F.hll_sketch_estimate("s"))
        grown = checkpoint(grown.where("n > before").drop("before"))
        known = known.join(grown.select("id"), "id", "left_anti").union(grown)
        front, known = grown.select("id", "s"), checkpoint(known)
    steps.unpersist()
    return known.select("id", "n")


def impact_index(edges: DataFrame, exact: int = EXACT, shown: tuple[int, int] = SHOWN, lg_k: int = LG_K, rounds: int | None = None, told_apart: bool = False) -> DataFrame:
    """(id, direct, transitive, estimated, direct_ids, transitive_ids) of every node that
    something depends on, of edges (from_id, to_id).

    ``direct`` counts different dependents, always exactly; ``transitive`` all that reach the
    node, itself too where it lies on a cycle: exactly up to ``exact``, else by a sketch
    (``estimated``). The lists show the first of each in order of (level, id). Self-loops and
    nulls are no dependence; an edge that repeats counts once. Edges of which none repeats
    need no shuffle to tell them apart (``told_apart``).

    Sketches take as many rounds as the longest shortest way between nodes of long lists has
    edges; with ``rounds`` they stop there, and what lies farther off isn't counted.
    """
    pairs = edges.where("from_id <> to_id").select(F.col("to_id").alias("here"), F.col("from_id").alias("there"))
    pairs = checkpoint(pairs if told_apart else pairs.distinct())
    lists = _lists(pairs, exact)
    direct = pairs.groupBy("here").agg(F.count("*").alias("direct")).withColumnRenamed("here", "id")
    out = lists.join(direct, "id").join(_estimates(pairs, lists, lg_k, rounds), "id", "left")
    count = F.when(F.col("whole"), F.size("found").cast("long")).otherwise(F.greatest("n", F.lit(exact + 1), "direct"))
    return out.select(
        "id", "direct", count.alias("transitive"), (~F.col("whole")).alias("estimated"),
        F.slice("found", 1, F.least(F.lit(shown[0]), F.col("direct").cast("int"))).alias("direct_ids"), F.slice("found", 1, shown[1]).alias("transitive_ids"))
