"""Hand-counted numbers, invariants, and batch against stream."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arcwell.functions import scalars
from arcwell.operators import communities, govern, graph, metrics, search
from arcwell.sources import dbcalls, extract, files, lines, sqlscope, webforms
from arcwell.streaming import live

EDGE = "from_id string, to_id string, from_kind string, to_kind string, via string, confidence string"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "file", "file", "call", "resolved") for a, b in pairs], EDGE)


def test_half_up(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (1.25,)], "x double").select(scalars.half_up(F.col("x")).alias("a"), scalars.half_up(F.col("x"), 1).alias("b")).collect()
    assert [r["a"] for r in got] == [-2.0, 3.0, 1.0] and got[2]["b"] == 1.3


def test_glob():
    import re

    assert re.match(scalars.glob_pattern("a/**"), "a/b/c.ts") and not re.match(scalars.glob_pattern("a/*.ts"), "a/b/c.ts")


def test_diamond_and_chain(spark):
    d = edges(spark, [("D", "B"), ("D", "C"), ("B", "A"), ("C", "A")])
    assert len(graph.routes(d, "D", "A", 3)) == 2
    chain = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(3499)])
    (path,) = graph.routes(chain, "n0", "n3499", 1)
    assert len(path) == 3500
    assert {(r["id"], r["depth"]) for r in graph.impact(d, "A").collect()} == {("B", 1), ("C", 1), ("D", 2)}


def test_routes_beyond_the_driver(spark, monkeypatch):
    """A hub of more than 5,000 nodes and a route of more than 50 hops hide nothing."""
    monkeypatch.setattr(graph, "DRIVER_EDGES", 100)
    pairs = [("n0", f"leaf{i}") for i in range(5100)] + [(f"n{i}", f"n{i + 1}") for i in range(52)]
    (path,) = graph.routes(edges(spark, pairs), "n0", "n52", 3)
    assert [n for n, _, _ in path] == [f"n{i}" for i in range(53)]


def test_routes_by_joins_are_the_driver_s(spark, monkeypatch):
    import random

    rng = random.Random(4)
    e = edges(spark, sorted({(f"a{rng.randrange(9)}", f"a{rng.randrange(9)}") for _ in range(24)})).where("from_id <> to_id")
    want = graph.routes(e, "a0", "a5", 3), graph.routes(e, "a0", "nowhere", 3)
    assert len(want[0]) == 3 and want[1] == []
    monkeypatch.setattr(graph, "DRIVER_EDGES", 3)
    assert (graph.routes(e, "a0", "a5", 3), graph.routes(e, "a0", "nowhere", 3)) == want


def test_strong_components_and_communities(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "q")])
    got = {r["id"]: r["component"] for r in graph.strong_components(e).collect()}
    assert got == {"a": "a", "b": "a", "x": "x", "y": "x", "z": "x"}
    c = {r["id"]: r["community"] for r in communities.communities(e.withColumn("weight", F.lit(1))).collect()}
    assert c["a"] == c["b"] and c["x"] != c["a"] and len(c) == 6


def test_risk_prediction_and_hotspots(spark):
    f = spark.createDataFrame([("hot", 14, 8, 32, 20), ("cold", 1, 0, 2, 2)], "file string, commits long, fixes long, complexity long, coupling long")
    assert [(r["file"], r["score"]) for r in metrics.risk_prediction(f).collect()] == [("hot", 100), ("cold", 6)]


def test_roi(spark):
    m = spark.createDataFrame([("a", 40), ("b", 0)], "module string, debt long")
    (r,) = metrics.roi(m).collect()
    assert (r["hours"], r["days"], r["cost"]) == (20.0, 2.5, 2000)
    assert metrics.rescale(metrics.roi(m).drop("cost"), 180.0).first()["cost"] == 3600


def test_cosine_order(spark):
    v = spark.createDataFrame([("auth", [1.0, 0.0, 0.0]), ("login", [0.9, 0.1, 0.0]), ("payment", [0.0, 1.0, 0.0])], "file string, vec array<double>")
    assert [r["file"] for r in search.vector_top(v, [1, 0, 0]).collect()] == ["auth", "login", "payment"]


def test_dispatch_order(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t, "a", "x", 0), (2, t, "a", "x", 0), (3, t, "b", "x", 2), (4, t, "b", "x", 0), (5, t, "b", "x", 2), (6, t, "d", "x", 0), (7, t, "d", "x", 0), (8, t, "e", "x", 2)]
    got = govern.dispatch(spark.createDataFrame(rows, "id long, ts timestamp, entity string, trigger string, failed_before int"), cap=2)
    # A blocked or capped event makes no duplicate of the next one.
    assert {r["id"]: r["decision"] for r in got.collect()} == {1: "dispatched", 2: "duplicate", 3: "blocked", 4: "dispatched", 5: "duplicate", 6: "capped", 7: "capped", 8: "capped"}


def test_dispatch_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.format_string("u%d", F.col("user_id") % 4).alias("entity"), F.col("event_type").alias("trigger"), (F.col("event_id") % 3).cast("int").alias("failed_before"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = live.dispatch_stream(stream, 3).writeStream.format("memory").queryName("sent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, govern.dispatch(e, 3).collect()))
    assert sorted(map(tuple, spark.table("sent").collect())) == want and len({w[2] for w in want}) == 4


def test_triage(spark):
    states = ["needs-triage", "needs-info", "ready-for-agent", "ready-for-human", "wontfix", "done"]
    r = spark.createDataFrame([(10 * i + j, a, b) for i, a in enumerate(states) for j, b in enumerate(states)], "id long, state string, wanted string")
    assert sorted(x["id"] for x in govern.triage_moves(r).collect() if x["allowed"]) == [1, 2, 3, 4, 10, 20, 25, 30, 35, 40]


def test_grades_and_labels(spark):
    d = spark.createDataFrame([(0.0,), (39.9,), (40.0,), (60.0,), (75.0,), (90.0,)], "x double")
    assert [r[0] for r in d.select(scalars.grade(F.col("x"))).collect()] == ["E", "E", "D", "C", "B", "A"]
    n = spark.createDataFrame([("a/OrderFacade.java",), ("b/user-profile_store.ts",), ("Impl.kt",), ("x/HTTPClient.ts",)], "p string")
    assert [r[0] for r in n.select(scalars.responsibility(F.col("p"))).collect()] == ["order", "user profile", "impl", "http client"]


def test_every_risk_rule(spark):
    from arcwell.plans import code

    d = spark.createDataFrame([(f"f{i}.ts", t) for i, (_, t) in enumerate(code.LINES)] + [("README.md", "// TODO later")], "file string, text string")
    got = {r["file"]: r["rule"] for r in extract.rule_hits(lines.file_lines(d)).collect()}
    assert got == {f"f{i}.ts": rule for i, (rule, _) in enumerate(code.LINES) if rule}  # no risk in a file that isn't code
    assert {rule for rule, _ in code.LINES if rule} == {r[0] for r in extract.RISKS}
    long = spark.createDataFrame([("a", "\n" * 1600), ("b", "\n" * 600), ("c", "\n")], "file string, text string")
    assert {(r["file"], r["level"]) for r in extract.long_files(long).collect()} == {("a", "critical"), ("b", "medium")}


def test_url_alignment(spark):
    calls = spark.createDataFrame([("f", i, "GET", u) for i, u in enumerate(["/api/v2/boats/7", "shop/boats/7", "/boats", "/fleet/boats", "/x/y", "/boats/"])], "file string, line_no int, method string, url string")
    ends = spark.createDataFrame([("/boats/{id}", "a", 1), ("/fleet/boats", "b", 1), ("/boats", "c", 1), ("/boats", "d", 1)], "route string, file string, line_no int")
    got = {r["line_no"]: (r["route"], r["to_file"]) for r in extract.match_calls(calls, ends).collect()}
    # As long: segment by segment. Else the shorter is the other's end, but none that ends in a parameter. The first endpoint wins.
    assert got == {0: ("/boats/{id}", "a"), 2: ("/boats/{id}", "a"), 3: ("/fleet/boats", "b"), 5: ("/boats/{id}", "a")}


def test_patterns(spark):
    d = spark.createDataFrame([("a/userRouter.ts", ""), ("a/x.java", "class X implements PayStrategy {"), ("b/LoginRequest.java", "@Entity class L"), ("c/y.md", "@Service")], "file string, text string")
    assert {tuple(r) for r in extract.patterns(d).collect()} == {("a/userRouter.ts", "Controller", "resolved"), ("a/x.java", "Strategy", "resolved"), ("b/LoginRequest.java", "DTO", "inferred"), ("b/LoginRequest.java", "Entity", "resolved")}


def test_sql_access(spark):
    d = spark.createDataFrame([("k", "INSERT INTO app.LEDGER (TITLE, CODE) SELECT * FROM [hr].[CREW] JOIN depots d ON 1=1"), ("u", "UPDATE till SET amount = ?, ceiling = ? WHERE id = ?"), ("d", "DELETE FROM crate")], "key string, sql string")
    got = {(r["key"], r["table_name"], r["mode"]) for r in extract.sql_mentions(d).collect()}
    assert got == {("k", "LEDGER", "write"), ("k", "CREW", "read"), ("k", "DEPOTS", "read"), ("u", "TILL", "write"), ("d", "CRATE", "write"), ("d", "CRATE", "read")}
    cols = {(r["table_name"], r["column_name"]) for r in sqlscope.column_access(d).where("mode = 'write'").collect()}
    assert cols == {("LEDGER", "TITLE"), ("LEDGER", "CODE"), ("TILL", "AMOUNT"), ("TILL", "CEILING")}


JAVA = """@RequestMapping("/api/boats")
public class BoatController {
  @GetMapping("/{id}")
  @PreAuthorize("hasRole('ADMIN')")
  public Boat one() {
    // TODO later
    if (x == 1 && y) { return eval(code); }
  }
  @PostMapping
  @Transactional(
    readOnly = true, rollbackFor = java.io.IOException.class,
    propagation = Propagation.REQUIRES_NEW)
  public void save() { call("{call PKG_BOAT.STORE(?)}"); }
}"""


def test_java_extractors(spark):
    ln = lines.file_lines(spark.createDataFrame([("A.java", JAVA)], "file string, text string"))
    e = {(r["method"], r["route"]) for r in webforms.endpoints(spark.createDataFrame([("A.java", JAVA)], "file string, text string")).collect()}
    assert e == {("GET", "/api/boats/{id}"), ("POST", "/api/boats")}
    assert {r["rule"] for r in extract.rule_hits(ln).collect()} >= {"todo", "eval"}
    (t,) = extract.transactions(ln).collect()  # the line after it is no method's: the contract looks no further
    assert (t["class"], t["method"], t["propagation"], t["read_only"], t["scope"]) == ("BoatController", None, "REQUIRES_NEW", True, "method")
    (c,) = dbcalls.db_calls(spark.createDataFrame([("A.java", JAVA)], "file string, text string")).collect()
    assert (c["package"], c["routine"], c["confidence"]) == ("PKG_BOAT", "STORE", "resolved")


def test_scan_and_imports(spark, tmp_path):
    for name, text in {"src/a.ts": "import { b } from './lib/b'", "src/lib/b.ts": "export const b = 1", "node_modules/x.ts": "", ".hid/y.ts": "", "z.bin": ""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    f = files.scan_files(spark, str(tmp_path))
    assert {r["file"] for r in f.collect()} == {"src/a.ts", "src/lib/b.ts"}
    got = extract.resolve_imports(extract.imports(lines.file_lines(f)), f).collect()
    assert [(r["from_file"], r["to_file"]) for r in got] == [("src/a.ts", "src/lib/b.ts")]


def test_git_log(spark, tmp_path):
    p = tmp_path / "log.txt"
    p.write_text("\x1eabc\x1fana\x1f1700000000\x1ffix: it\n\n3\t1\tsrc/{old => new}/a.ts\n-\t-\tb.png\n")
    got = {(r["author"], r["file"], r["added"]) for r in files.parse_git_log(spark, str(p)).collect()}
    assert got == {("ana", "src/new/a.ts", 3), ("ana", "b.png", 0)}


def test_incremental_equals_full(spark):
    now = spark.createDataFrame([("a", "class A extends B {"), ("b", "class C extends D {")], "file string, text string")
    old = spark.createDataFrame([("a", "class A extends B {"), ("b", "class C {")], "file string, text string")
    run = lambda d: extract.inheritance(lines.file_lines(d))
    cache = old.select("file", F.sha2("text", 256).alias("digest"))
    assert sorted(live.incremental(now, cache, run(old), run).collect()) == sorted(run(now).collect())


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("health-down").alias("type"), F.lit("warn").alias("severity"), F.col("value").alias("magnitude"))
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = live.alerts(stream).writeStream.format("memory").queryName("alerted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("alerted").count() == live.alerts(batch).count() > 0


@pytest.mark.parametrize("front_bytes", [graph.FRONT_BYTES, -1])
def test_iterations_equal_brute_force_with_broadcast_and_salted_fronts(spark, monkeypatch, front_bytes):
    """Random edges, a hub, a cycle: reach, components and strong components."""
    monkeypatch.setattr(graph, "FRONT_BYTES", front_bytes)
    import random

    r = random.Random(7)
    pairs = {(f"n{r.randrange(24):02}", f"n{r.randrange(24):02}") for _ in range(26)}
    pairs |= {("hub", f"n{i:02}") for i in range(0, 24, 3)} | {("x1", "x2"), ("x2", "x3"), ("x3", "x1")}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    near = {n: {b for a, b in pairs if a == n} for p in pairs for n in p}

    def depths(start, step):
        seen, todo = {start: 0}, [start]
        for n in todo:
            for m in sorted(step[n]):
                if m not in seen:
                    seen[m] = seen[n] + 1
                    todo.append(m)
        return seen

    e = spark.createDataFrame([(a, b, "resolved") for a, b in pairs], "from_id string, to_id string, confidence string").repartition(3)
    down = {n: depths(n, near) for n in near}
    got = graph.reach(e, spark.createDataFrame([("hub",)], "id string"), 30, reverse=False)
    assert {x["id"]: x["depth"] for x in got.collect()} == down["hub"]
    strong = {n: min(m for m in down[n] if n in down[m]) for n in near if any(m != n and n in down[m] for m in down[n])}
    assert {x["id"]: x["component"] for x in graph.strong_components(e).collect()} == strong
    both = {n: near[n] | {m for m in near if n in near[m]} for n in near}
    assert {x["id"]: x["component"] for x in graph.components(e).collect()} == {n: min(depths(n, both)) for n in near}
