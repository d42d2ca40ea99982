"""The impact index, communities and cycles against plain searches."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from arcwell.operators import communities, cycles, graph, whole_impact

PAIR = "from_id string, to_id string"


def random_graph(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes):03d}", f"n{rng.randrange(nodes):03d}") for _ in range(edges)})


def plain_impact(pairs, start):
    """What reaches ``start``, in order of (level, id)."""
    back = {}
    for a, b in pairs:
        if a != b:
            back.setdefault(b, set()).add(a)
    found, front = [], sorted(back.get(start, ()))
    while front:
        found += front
        front = sorted({x for f in front for x in back.get(f, ())} - set(found))
    return found, len(back.get(start, ()))


@pytest.mark.parametrize("exact", [3, 10, 200])
def test_impact_index_equals_search(spark, exact):
    pairs = random_graph(1, 60, 70) + [("hub", f"n{i:03d}") for i in range(20)] + [(f"x{i}", "top") for i in range(40)] + [("top", "n000"), ("n001", "n001"), (None, "n002")]
    got = {r["id"]: r for r in whole_impact.impact_index(spark.createDataFrame(pairs + pairs[:5], PAIR), exact).collect()}
    known = [(a, b) for a, b in pairs if a]
    assert set(got) == {b for a, b in known if a != b}
    for node, r in got.items():
        found, direct = plain_impact(known, node)
        assert r["direct"] == direct and r["estimated"] == (len(found) > exact)
        shown = found[:100] if not r["estimated"] else found[: min(len(found), exact, 100)]
        assert r["transitive_ids"][: len(shown)] == shown and r["direct_ids"] == found[: min(direct, 30, max(exact + 1, 1))]
        if r["estimated"]:
            assert abs(r["transitive"] - len(found)) <= max(1, 0.05 * len(found))
        else:
            assert r["transitive"] == len(found)


@pytest.mark.parametrize("least", [0, 32 << 20])
def test_impact_index_of_edges_told_apart(spark, monkeypatch, least):
    """The same of different edges without telling them apart, and of ids too many to broadcast."""
    monkeypatch.setattr(whole_impact, "FRONT_BYTES", least)
    pairs = sorted(set(random_graph(3, 30, 60)))
    got, want = ({r["id"]: tuple(r) for r in whole_impact.impact_index(spark.createDataFrame(p, PAIR), 5, told_apart=apart).collect()} for p, apart in ((pairs, True), (pairs * 2, False)))
    assert got == want and any(r[3] for r in got.values())


def test_impact_estimates_are_near(spark):
    """2**12 registers: a standard error of 1.6 %; four of them are never passed here."""
    pairs = [(f"leaf{i}", f"m{i % 40}") for i in range(8000)] + [(f"m{i}", f"t{i % 7}") for i in range(40)] + [(f"t{i}", "root") for i in range(7)] + [("root", "t0")]
    got = {r["id"]: r for r in whole_impact.impact_index(spark.createDataFrame(pairs, PAIR), 50).collect()}
    for node in ("root", "t0", "t3"):
        found, _ = plain_impact(pairs, node)
        assert got[node]["estimated"] and abs(got[node]["transitive"] - len(found)) <= 4 * 0.0163 * len(found)
    assert got["m0"]["direct"] == 200 and got["m0"]["estimated"]


def test_no_edges(spark):
    none = spark.createDataFrame([], PAIR)
    assert whole_impact.impact_index(none).count() == 0
    assert cycles.shortest_cycles(none).count() == 0
    assert communities.communities(none.withColumn("weight", F.lit(1))).count() == 0


def louvain(near):
    """Sequential greedy modularity, a node at a time, for comparison."""
    member, links = {n: n for n in near}, {n: dict(x) for n, x in near.items()}
    while True:
        total = sum(sum(x.values()) for x in links.values())
        strength = {n: sum(x.values()) for n, x in links.items()}
        own, size = {n: n for n in links}, dict(strength)
        moves, again = 0, True
        while again:
            again = False
            for n in sorted(links):
                to = {own[n]: 0.0}
                for m, w in links[n].items():
                    if m != n:
                        to[own[m]] = to.get(own[m], 0.0) + w
                size[own[n]] -= strength[n]
                best = min(to, key=lambda c: (-round(to[c] - size[c] * strength[n] / total, 9), c != own[n], c))
                size[best] += strength[n]
                if best != own[n]:
                    own[n], again, moves = best, True, moves + 1
        if not moves:
            return member
        member = {n: own[c] for n, c in member.items()}
        merged = {}
        for n, x in links.items():
            for m, w in x.items():
                merged.setdefault(own[n], {}).setdefault(own[m], 0.0)
                merged[own[n]][own[m]] += w
        links = merged


@pytest.mark.parametrize("kind", ["planted", "random"])
def test_communities_are_as_good_as_sequential_ones(spark, kind):
    """One component each, of 120 nodes."""
    rng = random.Random(3)
    if kind == "planted":
        pairs = [(f"n{a:03d}", f"n{b:03d}", 1) for a in range(120) for b in range(a) if rng.random() < (0.4 if a % 8 == b % 8 else 0.01)]
    else:
        pairs = [(f"n{a:03d}", f"n{rng.randrange(a):03d}", rng.randrange(1, 4)) for a in range(1, 120) for _ in range(2)]
    d = spark.createDataFrame(pairs, "from_id string, to_id string, weight int")
    got = communities.communities(d)
    assert got.count() == got.select("id").distinct().count() == len({x for a, b, _ in pairs for x in (a, b)})
    assert got.groupBy("community").agg(F.min("id").alias("m")).where("m <> community").count() == 0
    near = {}
    for a, b, w in pairs:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {}).setdefault(y, 0.0)
            near[x][y] += w
    plain = spark.createDataFrame(list(louvain(near).items()), "id string, community string")
    ours, theirs = communities.modularity(d, got), communities.modularity(d, plain)
    assert ours >= 0.95 * theirs, (ours, theirs)


def plain_cycle(pairs, members, root):
    """Length of the shortest cycle through ``root`` inside its component."""
    out = {}
    for a, b in pairs:
        if a in members and b in members and a != b:
            out.setdefault(a, set()).add(b)
    far, todo = {root: 0}, deque([root])
    while todo:
        a = todo.popleft()
        for b in out.get(a, ()):
            if b == root:
                return far[a] + 1
            if b not in far:
                far[b] = far[a] + 1
                todo.append(b)


@pytest.mark.parametrize("seed", [1])
def test_cycles_are_shortest(spark, seed):
    pairs = random_graph(seed, 30, 42) + [("a", "b"), ("b", "a"), *[(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]]
    d = spark.createDataFrame(pairs, PAIR)
    comp = {r["id"]: r["component"] for r in graph.strong_components(d).collect()}
    found = {}
    for r in cycles.shortest_cycles(d).collect():
        found.setdefault(r["component"], []).append((r["step"], r["from_id"], r["to_id"], r["length"]))
    assert set(found) == set(comp.values())
    for root, rows in found.items():
        rows.sort()
        members = {n for n, c in comp.items() if c == root}
        assert [s for s, *_ in rows] == list(range(1, len(rows) + 1)) and {n for *_, n in rows} == {len(rows)}
        assert rows[0][1] == root and rows[-1][2] == root and all(x[2] == y[1] for x, y in zip(rows, rows[1:], strict=False))
        assert all((a, b) in set(pairs) for _, a, b, _ in rows) and len(rows) == plain_cycle(pairs, members, root)
    assert cycles.circular_violations(d, 3).count() == 3


def test_only_nodes_with_further_steps_are_repeated_for_salts(spark, monkeypatch):
    """100 ends of a large last level aren't repeated; the result is that of a broadcast."""
    pairs = [("mid", "top")] + [(f"end{i}", "mid") for i in range(100)]
    e = spark.createDataFrame([(a, b, "resolved") for a, b in pairs], "from_id string, to_id string, confidence string")
    seeds = spark.createDataFrame([("top",)], "id string")
    told = sorted(map(tuple, graph.reach(e, seeds).collect()))
    fronts, follow = [], graph.follow
    monkeypatch.setattr(graph, "FRONT_BYTES", 0)
    monkeypatch.setattr(graph, "follow", lambda steps, front, held: fronts.append(front.count()) or follow(steps, front, held))
    assert sorted(map(tuple, graph.reach(e, seeds).collect())) == told
    assert fronts == [1, 1, 0]
