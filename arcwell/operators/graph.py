"""The typed property graph: one edge DataFrame, its nodes the distinct ends.

``from`` depends on ``to``; the impact of X is what reaches X. Iterative operators run
one join a level and cut their lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import checkpoint

EDGE = ["from_id", "to_id", "from_kind", "to_kind", "via", "confidence"]
#: Edges that the driver takes for path search (about 100 MB); more stay distributed.
DRIVER_EDGES = 500_000
#: Levels after which the plan of all known nodes is cut.
COMPACT = 32
#: Measured bytes of a frontier up to which it is broadcast; a larger one is joined by key.
FRONT_BYTES = 32 << 20
#: Parts of a key in joins by key: a hub's edges spread over so many tasks.
SALTS = 32


def union_edges(*families: DataFrame) -> DataFrame:
    """All families, without self-loops, one edge per (from, to, via); resolved wins."""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f)
    rank = F.max(F.when(F.col("confidence") == "resolved", 1).otherwise(0))
    out = out.where("from_id <> to_id").groupBy("from_id", "to_id", "from_kind", "to_kind", "via").agg(rank.alias("r"))
    return out.select("from_id", "to_id", "from_kind", "to_kind", "via", F.when(F.col("r") == 1, "resolved").otherwise("inferred").alias("confidence"))


def degrees(edges: DataFrame, pairs: bool = True) -> DataFrame:
    """(id, in_degree, out_degree, degree); over unique pairs, or over every edge."""
    e = edges.select("from_id", "to_id")
    e = e.distinct() if pairs else e
    ends = e.select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def god_nodes(edges: DataFrame, n: int = 15) -> DataFrame:
    return degrees(edges, pairs=False).orderBy(F.desc("degree"), F.desc("in_degree"), "id").limit(n)


def stepped(edges: DataFrame) -> DataFrame:
    """(here, salt, there, sure) of edges (here, there, sure), one row a pair, persisted:
    one shuffle deals them by (here, salt) and serves the grouping and every level."""
    parts = edges.withColumn("salt", F.pmod(F.hash("there"), F.lit(SALTS))).repartition("here", "salt")
    return parts.groupBy("here", "salt", "there").agg(F.max("sure").alias("sure")).persist()


def weigh(front: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of a frontier."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, t in front.dtypes if t == "string"), F.lit(16))
    rows, held = front.agg(F.count("*"), F.sum(size)).first()
    return rows, held or 0


def follow(steps: DataFrame, front: DataFrame, held: int) -> DataFrame:
    """The steps from the nodes of ``front`` (id and more), whose ``held`` bytes say how:
    broadcast, or repeated for each salt and joined by (here, salt)."""
    near = front.withColumnRenamed("id", "here")
    if held <= FRONT_BYTES:
        return steps.join(F.broadcast(near), "here")
    return steps.join(near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["here", "salt"])


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, reverse: bool = True, max_nodes: int | None = None) -> DataFrame:
    """(id, depth, confidence) of what reaches the seeds (``reverse``) or is reached.

    A node's confidence is that of its best shortest path: the weakest edge on it.
    With ``max_nodes``, no level is begun once so many nodes are known.
    """
    steps = _steps(edges, reverse)
    seen = _reach(steps, seeds, max_depth, max_nodes)
    steps.unpersist()
    return seen


def _steps(edges: DataFrame, reverse: bool) -> DataFrame:
    here, there = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    return stepped(edges.select(F.col(here).alias("here"), F.col(there).alias("there"), F.when(F.col("confidence") == "resolved", 1).otherwise(0).alias("sure")))


def _reach(steps: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """``reach`` along persisted steps. Of a large frontier only the nodes from which a step goes
    on are repeated for the salts: most of a last level are ends."""
    heads = None
    front = checkpoint(seeds.select("id", F.lit(0).alias("depth"), F.lit(1).alias("sure")))
    seen, (known, held) = front, weigh(front)
    for depth in range(1, max_depth + 1):
        if max_nodes is not None and known >= max_nodes:
            break
        if held > FRONT_BYTES:
            heads = checkpoint(steps.select(F.col("here").alias("id")).distinct()) if heads is None else heads
            ahead = checkpoint(front.join(heads, "id", "left_semi"))
            held = weigh(ahead)[1]
        else:
            ahead = front
        met = follow(steps, ahead.select("id", F.col("sure").alias("far")), held)
        met = met.groupBy(F.col("there").alias("id")).agg(F.max(F.least("sure", "far")).alias("sure"))
        front = checkpoint(met.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "sure"))
        new, held = weigh(front)
        if not new:
            break
        known += new
        seen = seen.union(front)
        if depth % COMPACT == 0:
            seen = checkpoint(seen)
    return seen.select("id", "depth", F.when(F.col("sure") == 1, "resolved").otherwise("inferred").alias("confidence"))


def impact(edges: DataFrame, node: str, max_depth: int = 10, max_nodes: int | None = None) -> DataFrame:
    """(id, kind, depth, confidence) of all that depends on ``node``, itself left out. Nothing is
    cut unless ``max_nodes`` says so; ``codegraph.impact_report`` tells whether it did."""
    return _affected(reach(edges, _node(edges, node), max_depth, True, max_nodes))


def _node(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(node,)], "id string")


def _affected(seen: DataFrame) -> DataFrame:
    return seen.where("depth > 0").select("id", F.substring_index("id", ":", 1).alias("kind"), "depth", "confidence")


def blast_radius(edges: DataFrame, node: str, n: int = 20, max_depth: int = 10) -> DataFrame:
    """The n affected nodes with the most dependents, counted in the steps of the search."""
    steps = _steps(edges, True)
    hit = _affected(_reach(steps, _node(edges, node), max_depth))
    dependents = checkpoint(steps.groupBy(F.col("here").alias("id")).agg(F.count("*").alias("dependents")))
    steps.unpersist()
    met = hit.join(dependents, "id", "left")
    return met.select("id", "kind", "depth", F.coalesce("dependents", F.lit(0)).cast("long").alias("dependents")).orderBy(F.desc("dependents"), "depth", "id").limit(n)


def resolve_id(nodes: DataFrame, text: str) -> DataFrame:
    """Candidates for a free text, best tier first: the id itself, ``PKG.PROC``, a bare
    name, the end of a path; then the shortest."""
    name = F.substring_index("id", ":", -1)
    tier = F.when(F.col("id") == text, 0).when(F.upper(name) == text.upper(), 1).when(F.upper(F.substring_index(name, ".", -1)) == text.upper(), 2).when(name.endswith(text), 3)
    found = nodes.select("id", tier.alias("tier")).where("tier IS NOT NULL")
    return found.orderBy("tier", F.length("id"), "id")


def routes(edges: DataFrame, start: str, end: str, k: int = 3) -> list[list[tuple[str, str, str]]]:
    """Up to k simple routes from ``start`` along dependencies to ``end``, shortest
    first, then by ids, as lists of (node, via, confidence).

    The search is exact at every size, without a bound on nodes or levels. Beyond
    DRIVER_EDGES, the driver takes only the edges between nodes that are reachable from
    one end and reach the other; if these are too many as well, each route is searched
    by joins, a level at a time.
    """
    spark = edges.sparkSession
    induced, driven = edges, True
    if edges.limit(DRIVER_EDGES + 1).count() > DRIVER_EDGES:
        one = reach(edges, spark.createDataFrame([(start,)], "id string"), 1 << 40, False).select("id")
        two = reach(edges, spark.createDataFrame([(end,)], "id string"), 1 << 40, True).select("id")
        both = checkpoint(one.join(two, "id", "left_semi"))
        induced = edges.join(both.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(both.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        induced = checkpoint(induced.groupBy("from_id", "to_id").agg(F.min(F.struct("via", "confidence")).alias("told")).select("from_id", "to_id", "told.*"))
        driven = induced.count() <= DRIVER_EDGES
    out: dict[str, dict[str, tuple[str, str]]] = {}
    for r in induced.select("from_id", "to_id", "via", "confidence").collect() if driven else []:
        told = out.setdefault(r[0], {})
        told[r[1]] = min(told.get(r[1], (r[2], r[3])), (r[2], r[3]))

    def shortest(begin: str, banned_edges: set[tuple[str, str]], banned: set[str]) -> list[str] | None:
        parent, todo = {begin: ""}, deque([begin])
        while todo:
            a = todo.popleft()
            if a == end:
                path = [a]
                while parent[path[-1]]:
                    path.append(parent[path[-1]])
                return path[::-1]
            for b in sorted(out.get(a, {})):
                if b not in parent and b not in banned and (a, b) not in banned_edges:
                    parent[b] = a
                    todo.append(b)
        return None

    def joined(begin: str, banned_edges: set[tuple[str, str]], banned: set[str]) -> list[str] | None:
        """What ``shortest`` finds, in levels from the end: each node keeps its smallest
        next one, so that the path is the smallest of the shortest ones here too."""
        steps = induced.select("from_id", "to_id")
        if banned:
            steps = steps.where(~F.col("from_id").isin(banned) & ~F.col("to_id").isin(banned))
        for a, b in banned_edges:
            steps = steps.where((F.col("from_id") != a) | (F.col("to_id") != b))
        levels = [checkpoint(spark.createDataFrame([(end, None)], "id string, next string"))]
        seen = levels[0].select("id")
        while not levels[-1].where(F.col("id") == begin).count():
            met = steps.join(levels[-1].select(F.col("id").alias("to_id")), "to_id").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("next"))
            levels.append(checkpoint(met.join(seen, "id", "left_anti")))
            if levels[-1].isEmpty():
                return None
            seen = seen.union(levels[-1].select("id"))
            if len(levels) % COMPACT == 0:
                seen = checkpoint(seen)
        path = [begin]
        for level in levels[:0:-1]:
            path.append(level.where(F.col("id") == path[-1]).first()["next"])
        return path

    search = shortest if driven else joined
    first = search(start, set(), set())
    found, spare = ([first] if first else []), []
    while found and len(found) < k:
        last = found[-1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            cut = {(p[i], p[i + 1]) for p in found if p[: i + 1] == root}
            tail = search(root[-1], cut, set(root[:-1]))
            if tail and root[:-1] + tail not in spare + found:
                spare.append(root[:-1] + tail)
        if not spare:
            break
        spare.sort(key=lambda p: (len(p), p))
        found.append(spare.pop(0))
    if not driven and (used := sorted({x for p in found for x in zip(p, p[1:], strict=False)})):
        pairs = spark.createDataFrame(used, "from_id string, to_id string")
        for r in induced.join(F.broadcast(pairs), ["from_id", "to_id"]).select("from_id", "to_id", "via", "confidence").collect():
            out.setdefault(r[0], {})[r[1]] = (r[2], r[3])
    return [[(b, *out[a][b]) if a else (b, "", "") for a, b in zip(["", *p[:-1]], p, strict=True)] for p in found]


def matrix(edges: DataFrame, container: Column, other: Column) -> DataFrame:
    """Weights between containers of the two ends, without those within one."""
    e = edges.select(container.alias("a"), other.alias("b"), "confidence").where("a <> b")
    return e.groupBy("a", "b").agg(F.count("*").alias("weight"), F.sum(F.when(F.col("confidence") == "resolved", 1).otherwise(0)).alias("resolved"))


def dominant_via(edges: DataFrame, container: Column, other: Column, priority: dict[str, int]) -> DataFrame:
    """The relation of each container pair with the highest priority + 0.01 * count."""
    e = edges.select(container.alias("a"), other.alias("b"), "via").where("a <> b").groupBy("a", "b", "via").agg(F.count("*").alias("n"))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("via")), F.lit(0))
    score = (rank + 0.01 * F.col("n")).alias("score")
    return e.select("a", "b", "via", "n", score).groupBy("a", "b").agg(F.sum("n").alias("weight"), F.max_by("via", F.struct("score", "via")).alias("via"))


def two_cycles(edges: DataFrame) -> DataFrame:
    e = edges.select("from_id", "to_id").distinct()
    back = e.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return e.join(back, ["from_id", "to_id"], "left_semi").where("from_id < to_id")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each weakly connected component. Only nodes
    whose label changed tell their neighbours; labels then jump to their label's label."""
    ends = edges.select("from_id", "to_id")
    both = ends.union(edges.select("to_id", "from_id")).toDF("here", "there")
    steps = stepped(both.withColumn("sure", F.lit(1)))
    label = checkpoint(steps.select(F.col("here").alias("id")).distinct().withColumn("component", F.col("id")))
    front, (moved, held) = label, weigh(label)
    while moved:
        near = follow(steps, front, held).groupBy(F.col("there").alias("id")).agg(F.min("component").alias("m"))
        new = checkpoint(label.join(near, "id", "left").select("id", F.col("component").alias("before"), F.least("component", "m").alias("component")))
        heads = new.select(F.col("component").alias("id")).distinct().join(new.select("id", F.col("component").alias("further")), "id")
        heads = checkpoint(heads.where("further <> id").select(F.col("id").alias("here"), "further"))
        if weigh(heads)[1] <= FRONT_BYTES:
            jumped = new.join(F.broadcast(heads), F.col("component") == F.col("here"), "left")
        else:
            parts = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            jumped = new.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(parts, (F.col("component") == F.col("here")) & (F.col("salt") == F.col("part")), "left")
        told = F.coalesce("further", "component")
        told = checkpoint(jumped.select("id", told.alias("component"), (told < F.col("before")).alias("moved")))
        label, front = told.select("id", "component"), told.where("moved").select("id", "component")
        moved, held = weigh(front)
    steps.unpersist()
    return label


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of strongly connected components of two nodes or more, named by
    their smallest id. Each turn trims nodes without edges in or out, gives each node the
    smallest id that reaches it as its colour, and takes from every colour at once the
    nodes that reach the one it is named by; edges between colours go."""
    e = checkpoint(edges.select("from_id", "to_id").where("from_id <> to_id").distinct())
    found = edges.sparkSession.createDataFrame([], "id string, component string")
    while True:
        before = e.count()
        while before:
            e = checkpoint(e.join(e.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(e.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi"))
            after = e.count()
            if after == before:
                break
            before = after
        if not before:
            return found
        ahead, back = (stepped(e.select(F.col(a).alias("here"), F.col(b).alias("there"), F.lit(1).alias("sure"))) for a, b in (("from_id", "to_id"), ("to_id", "from_id")))
        colour = checkpoint(ahead.select(F.col("here").alias("id")).distinct().withColumn("colour", F.col("id")))
        front, (moved, held) = colour, weigh(colour)
        while moved:
            near = follow(ahead, front, held).groupBy(F.col("there").alias("id")).agg(F.min("colour").alias("m"))
            new = checkpoint(colour.join(near, "id", "left").select("id", F.least("colour", "m").alias("colour"), F.coalesce(F.col("m") < F.col("colour"), F.lit(False)).alias("moved")))
            colour, front = new.select("id", "colour"), new.where("moved").select("id", "colour")
            moved, held = weigh(front)
        front = checkpoint(colour.where("id = colour"))
        seen, (moved, held) = front, weigh(front)
        while moved:
            met = follow(back, front, held).select(F.col("there").alias("id"), "colour").distinct()
            front = checkpoint(met.join(colour, ["id", "colour"], "left_semi").join(seen.select("id"), "id", "left_anti"))
            moved, held = weigh(front)
            seen = seen.union(front)
        seen = checkpoint(seen)
        others = seen.where("id <> colour")
        found = found.union(others.select("id", "colour")).union(others.select("colour", "colour").distinct())
        rest = checkpoint(colour.join(seen.select("id"), "id", "left_anti"))
        e = e.join(rest.toDF("from_id", "ca"), "from_id").join(rest.toDF("to_id", "cb"), "to_id").where("ca = cb")
        e = checkpoint(e.select("from_id", "to_id"))
        ahead.unpersist()
        back.unpersist()


def cross_cluster(edges: DataFrame, clusters: DataFrame, n: int = 20) -> DataFrame:
    """Cluster pairs whose weight is at least half the smaller one's inner weight."""
    c = clusters.select("id", "cluster")
    e = edges.join(c.toDF("from_id", "ca"), "from_id").join(c.toDF("to_id", "cb"), "to_id")
    w = e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count("*").alias("weight"))
    inner = w.where("a = b").select(F.col("a").alias("k"), F.col("weight").alias("inner"))
    out = w.where("a <> b").join(inner.toDF("a", "ia"), "a", "left").join(inner.toDF("b", "ib"), "b", "left")
    floor = F.greatest(F.lit(1), F.least(F.coalesce("ia", F.lit(0)), F.coalesce("ib", F.lit(0))))
    return out.where(F.col("weight") >= 0.5 * floor).select("a", "b", "weight").orderBy(F.desc("weight"), "a", "b").limit(n)


def criticality(edges: DataFrame, churn: DataFrame, clusters: DataFrame, n: int = 20) -> DataFrame:
    """round(100 * (0.4 in/max + 0.3 churn/max + 0.3 bridges/max)), positive, top n; every edge
    counts, parallel ones too."""
    d = degrees(edges, pairs=False).select("id", "in_degree")
    c = clusters.select("id", "cluster")
    met = edges.select("from_id", "to_id").join(c.toDF("from_id", "ca"), "from_id").join(c.toDF("to_id", "cb"), "to_id").where("ca <> cb")
    ends = met.select(F.col("from_id").alias("id"), F.col("cb").alias("other")).union(met.select(F.col("to_id"), F.col("ca")))
    bridges = ends.groupBy("id").agg(F.count_distinct("other").alias("bridges"))
    j = d.join(churn, "id", "left").join(bridges, "id", "left").select("id", "in_degree", F.coalesce("churn", F.lit(0)).alias("churn"), F.coalesce("bridges", F.lit(0)).alias("bridges"))
    top = j.agg(*[F.greatest(F.max(x), F.lit(1)).cast("double").alias("m_" + x) for x in ("in_degree", "churn", "bridges")])
    s = F.floor(100 * (0.4 * F.col("in_degree") / F.col("m_in_degree") + 0.3 * F.col("churn") / F.col("m_churn") + 0.3 * F.col("bridges") / F.col("m_bridges")) + 0.5).cast("long")
    return j.crossJoin(F.broadcast(top)).select("id", "in_degree", "churn", "bridges", s.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(n)


def layer_violations(edges: DataFrame, layer_of: Column, layer_to: Column, forbidden: list[tuple[str, str, str]]) -> DataFrame:
    """One row per forbidden (from layer, to layer) and node pair, with its severity."""
    severity = F.lit(None).cast("string")
    for a, b, s in forbidden:
        severity = F.when((layer_of == a) & (layer_to == b), s).otherwise(severity)
    return edges.withColumn("severity", severity).where("severity IS NOT NULL").groupBy("from_id", "to_id").agg(F.min("severity").alias("severity"), F.min("via").alias("via"))


def inheritance_depth(edges: DataFrame, limit: int = 50) -> DataFrame:
    """(id, depth) from the roots (nodes that extend nothing); cycles end at ``limit``."""
    roots = edges.select(F.col("to_id").alias("id")).distinct().join(edges.select(F.col("from_id").alias("id")).distinct(), "id", "left_anti")
    e = edges.withColumn("confidence", F.lit("resolved"))
    return reach(e, roots, limit, True).select("id", "depth")
