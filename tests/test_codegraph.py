"""Resolution, graphs, modules, reports and reviews on small trees, against hand-made answers."""

import json

from pyspark.sql import functions as F

from arcwell.operators import codegraph, review, search
from arcwell.sources import dbsource, modules, repo, resolve


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


def test_script_imports_through_alias_and_barrel(spark):
    config = '{ // paths\n "compilerOptions": { "baseUrl": ".", "paths": { "@lib/*": ["src/lib/*"], "only": ["src/one.ts"], } } }'
    d = files(spark, {
        "src/ui/page.ts": "import { Boat, type Crew } from '@lib';\nimport { Boat as B } from '@lib/boats';\nimport x from 'only';\nimport { far } from '../../../out';",
        "src/lib/index.ts": "export * from './boats';\nexport { Crew } from './people/crew';", "src/lib/boats.ts": "export class Boat {}", "src/lib/people/crew.ts": "export interface Crew {}", "src/one.ts": "export default 1;"})
    paths = [*resolve.aliases(config), ("@lib", "src/lib")]
    got = {tuple(r)[:2] for r in resolve.script_imports(d, paths).collect()}
    assert got == {("src/ui/page.ts", "src/lib/boats.ts"), ("src/ui/page.ts", "src/lib/people/crew.ts")} | ({("src/ui/page.ts", "src/one.ts")} & got)
    assert resolve.tolerant_json("not json") == {} and resolve.aliases(config)[0] == ("@lib/*", "src/lib/*")


def test_java_edges(spark):
    d = files(spark, {
        "u/Port.java": "package u;\npublic interface Port { void dock(); }", "u/Quay.java": "package u;\npublic class Quay implements Port { public void dock() {} }",
        "u/Ship.java": "package u;\npublic class Ship {\n  private final Port port;\n  private Lamp lamp;\n  void go() { port.dock(); lamp.on(); }\n}", "u/Lamp.java": "package u;\ninterface Lamp {}",
        "u/Oil.java": "package u;\nclass Oil implements Lamp {}", "u/Gas.java": "package u;\nclass Gas implements Lamp {}"})
    got = {tuple(r)[:4] for r in resolve.java_edges(d).collect()}
    assert {e for e in got if e[0] == "u/Ship.java"} == {("u/Ship.java", "u/Quay.java", "call", "resolved"), ("u/Ship.java", "u/Oil.java", "call", "inferred"), ("u/Ship.java", "u/Gas.java", "call", "inferred")}
    assert ("u/Quay.java", "u/Port.java", "implements", "resolved") in got
    symbols = {(r["kind"], r["name"]) for r in resolve.java_symbols(d).where("file = 'u/Ship.java'").collect()}
    assert symbols >= {("class", "Ship"), ("field", "port"), ("method", "go")}


SQL = """CREATE OR REPLACE PACKAGE BODY PORT_API AS
  PROCEDURE berth IS
  BEGIN
    INSERT INTO app.BERTH (A) SELECT A FROM SHIP;
    DUES.CHARGE(1);
    EXECUTE IMMEDIATE x;
  END;
END;
/
CREATE OR REPLACE TRIGGER T_SHIP
  AFTER UPDATE ON SHIP
BEGIN
  UPDATE LOG_BOOK SET A = 1;
END;
/
CREATE SYNONYM CHARGES FOR other.DUES;
"""


def test_database_facts_and_routines(spark):
    units = dbsource.units(files(spark, {"p.pkb": SQL}))
    objects = dbsource.object_facts(units)
    got = {(r["type"], r["name"]): (r["package"], r["tables_read"], r["tables_written"], r["on_table"], r["synonym_for"]) for r in objects.collect()}
    assert got[("procedure", "BERTH")] == ("PORT_API", ["SHIP"], ["BERTH"], None, None)
    assert got[("trigger", "T_SHIP")][2:4] == (["LOG_BOOK"], "SHIP") and got[("synonym", "CHARGES")][4] == "OTHER.DUES"
    calls = {(r["caller"], r["package"], r["routine"], r["dynamic"]) for r in dbsource.routine_calls(units).collect()}
    assert ("BERTH", "DUES", "CHARGE", False) in calls and ("BERTH", None, "?", True) in calls
    e = {(r["from_id"], r["to_id"], r["via"], r["confidence"]) for r in codegraph.build_impact_graph(objects=objects, routine_calls=dbsource.routine_calls(units)).collect()}
    assert e >= {("plsql:PORT_API.BERTH", "table:SHIP", "reads", "resolved"), ("plsql:T_SHIP", "table:SHIP", "trigger-on", "resolved"), ("plsql:PORT_API.BERTH", "plsql:DUES.CHARGE", "plsql-call", "inferred"), ("plsql:PORT_API.BERTH", "file:p.pkb", "defined-in", "resolved")}
    assert not any("?" in x[1] for x in e)
    declared = spark.createDataFrame([("procedure", "GO", "A", "f", 1, None), ("procedure", "GO", "B", "f", 2, None), ("procedure", "ONE", None, "f", 3, None), ("synonym", "UNO", None, "f", 4, "x.ONE")], "type string, name string, package string, file string, line_no int, synonym_for string")
    refs = spark.createDataFrame([("go", "b"), ("go", None), ("go", "c"), ("uno", None), ("one", "z"), ("gone", None)], "routine string, package string")
    assert {(r["routine"], r["package"]): (r["id"], r["sure"]) for r in codegraph.resolve_routines(refs, declared).collect()} == {
        ("go", "b"): ("plsql:B.GO", "resolved"), ("go", None): ("plsql:A.GO", "inferred"), ("go", "c"): ("plsql:C.GO", "inferred"), ("uno", None): ("plsql:ONE", "resolved"), ("one", "z"): ("plsql:ONE", "inferred"), ("gone", None): ("plsql:GONE", "inferred")}


def test_name_fallback_and_methods(spark):
    calls = spark.createDataFrame([("web/harbour-service.ts", 1, "GET", "/nowhere", "resolved"), ("web/list.ts", 1, "GET", "/nowhere", "resolved")], "file string, line_no int, method string, url string, confidence string")
    ends = spark.createDataFrame([("GET", "/boats", "api/HarbourController.java", 3), ("GET", "/l", "api/ListController.java", 3)], "method string, route string, file string, line_no int")
    assert [tuple(r) for r in codegraph.http_edges(calls, ends).collect()] == [("web/harbour-service.ts", "api/HarbourController.java", "inferred", None)]
    m = spark.createDataFrame([("a", "T", "go", "b", "run", "resolved"), ("c", None, None, "d", None, "inferred")], "from_file string, from_type string, from_method string, to_file string, to_method string, confidence string")
    e = {(r["from_id"], r["to_id"], r["via"]) for r in codegraph.build_impact_graph(methods=m).collect()}
    assert e >= {("method:a#T.go", "method:b#run", "call"), ("method:a#T.go", "file:a", "defined-in"), ("method:c#?", "method:d#?", "call")}
    assert codegraph.annotate_methods(["file:a", "file:b", "tbl:X"], m) == ["file:a.go", "file:b", "tbl:X"]
    assert codegraph.methods_of(m, spark.createDataFrame([("b",)], "file string")).count() == 1


def test_trace_and_entries(spark):
    nodes = spark.createDataFrame([("db:PKG", "PKG", "database", None), ("db:PKG_LONG", "PKG_LONG", "database", None), ("fe:w/a.tsx", "a", "frontend", "w/a.tsx")], "id string, label string, layer string, file string")
    assert [codegraph.resolve_entry(nodes, t) for t in ("pkg", "x.pkg.go", "pkg_l", "long", "a.tsx", "zzz")] == ["db:PKG", "db:PKG", "db:PKG", None, "file:w/a.tsx", None]
    e = spark.createDataFrame([("file:w/a.tsx", "file:s/B.java", "http-call", "resolved"), ("file:s/B.java", "db:PKG", "db-call", "resolved"), ("db:PKG", "tbl:T", "table-access", "resolved")], "from_id string, to_id string, via string, confidence string")
    up, path = codegraph.cross_tier_trace(e, "tbl:T")
    assert path == ["file:w/a.tsx", "file:s/B.java", "db:PKG", "tbl:T"] and up.count() == 3
    both = codegraph.both_ways(e, nodes, "PKG", 5).collect()
    assert {(r["id"], r["direction"]) for r in both} >= {("tbl:T", "down"), ("file:w/a.tsx", "up")}
    told, counts, cut = codegraph.impact_report(e, "tbl:T", spark.createDataFrame([("s/B.java", "s")], "file string, module string"))
    assert {r["module"] for r in told.collect()} == {"s", None} and counts.agg(F.sum("n")).first()[0] == 3 and not cut


def test_modules(spark):
    def named(folders, most=25):
        d = spark.createDataFrame(list(folders.items()), "folder string, n long")
        return {r["folder"]: r["module"] for r in modules.name_folders(d, most).collect()}

    got = named({"shop-backend/src/main/java/com/x/boats": 6, "shop-backend/src/main/java/com/x/crew": 7, "shop-backend": 1, "shop-frontend/src": 9, "src/a": 5, "src/b": 2, "": 6, "docs": 1})
    assert got == {
        "shop-backend/src/main/java/com/x/boats": "backend/boats", "shop-backend/src/main/java/com/x/crew": "backend/crew", "shop-backend": "backend",  # the first module that could take it is itself: it stays
        "shop-frontend/src": "frontend", "src/a": "a", "src/b": "__root__", "": "__root__", "docs": "docs"}
    assert named({"": 2})[""] is None and len(set(named({f"d{i}": 9 for i in range(40)}).values())) == 26
    # A folder alone goes on, two that name modules but are small end the search, infrastructure is passed.
    assert named({"x-api/only/p": 5, "x-api/only/q": 5})["x-api/only/p"] == "api/p"
    assert named({"x-api/p": 2, "x-api/q/r": 6, "x-api/q/s": 6})["x-api/q/r"] == "api/q"
    assert named({"x-api/main/p": 5, "x-api/test/q": 5})["x-api/test/q"] == "api/q"
    # Equal names of two top folders are told apart; src/main and src/test of one are one.
    both = named({"web/shop/a": 50, "web/b": 40, "old-web/shop": 9, "old-web/b": 8})
    assert both["web/shop/a"] == "web/shop" and both["old-web/shop"] == "old-web/web/shop"
    assert named({"src/a": 9, "app/a": 7}) == {"src/a": "a", "app/a": "app/a"}
    # Small ones stay where nothing large enough takes them.
    assert named({"src/a": 3, "src/b": 2}) == {"src/a": "a", "src/b": "b"}
    files_ = spark.createDataFrame([(f"lib/x/f{i}.ts",) for i in range(6)] + [("README.md",)], "file string")
    assert {(r["file"], r["module"]) for r in modules.detect_modules(files_).collect()} >= {("lib/x/f0.ts", "x"), ("README.md", None)}


def test_repository_facts(spark, tmp_path):
    for n in ("frontend", "backend"):
        (tmp_path / "w" / n).mkdir(parents=True)
    assert repo.find_scan_root(str(tmp_path / "w/frontend")) == str(tmp_path / "w") and repo.find_scan_root(str(tmp_path / "w")) == str(tmp_path / "w")
    (tmp_path / "d1").write_text("a.ts\nb.ts\n")
    (tmp_path / "d2").write_text("b.ts\n\n")
    assert {r[0] for r in repo.changed_names(spark, str(tmp_path / "d1"), str(tmp_path / "d2")).collect()} == {"a.ts", "b.ts"}
    d = files(spark, {"package.json": json.dumps({"dependencies": {"react": "1"}, "devDependencies": {"express": "1"}}), "yarn.lock": "", "A/BoatService.java": "", "pom.xml": "", "x.py": ""})
    assert {tuple(r) for r in repo.stack(d).collect()} == {("framework", "React"), ("framework", "Express"), ("framework", "Maven"), ("framework", "Spring"), ("manager", "yarn"), ("manager", "maven")}
    assert repo.read_json(spark, str(tmp_path / "none.json"), "a int") is None
    (tmp_path / "ok.json").write_text('{"a": 1}')
    assert repo.read_json(spark, str(tmp_path / "ok.json"), "a int").first()["a"] == 1
    t = spark.createDataFrame([("x|y", 3)], "a string, n int")
    assert "x\\|y" in repo.markdown("T", {"s": t}) and json.loads(repo.analysis_json({"t": t, "u": t}).first()[0])["u"] == [{"a": "x|y", "n": 3}]
    p = spark.createDataFrame([("m", "k", 2)], "a string, b string, weight int")
    assert "-->|2|" in repo.mermaid(p) and "<line" in repo.svg(p) and "<table>" in repo.html_page("T", {"s": t}, repo.svg(p))
    for n in (1, 2):
        repo.replace_index({"t": spark.range(n)}, str(tmp_path / "index"), spark)
    assert spark.read.parquet(str(tmp_path / "index/t")).count() == 2 and not (tmp_path / "index.old").exists()
    repo.webhook("http://127.0.0.1:9/none", timeout=0.2)(t, 0)


def test_reviews(spark):
    e = spark.createDataFrame([("file:a", "table:T", "table"), ("file:a", "plsql:P", "plsql"), ("file:b", "file:c", "file")], "from_id string, to_id string, to_kind string")
    (q,) = review.review_questions(e, spark.createDataFrame([("a",), ("b",)], "file string")).collect()
    assert q["file"] == "a" and "P" in q["question"]
    m = spark.createDataFrame([(1, "Plan", "2024-01-02", [("d1", "decision", "do it", "why", "boat", None, None), ("d2", "out-of-scope", "not it", None, None, None, None), ("d3", "decision", "x", None, None, None, None)])], "id long, title string, ts string, decisions array<struct<id:string,decision_type:string,summary:string,rationale:string,entity:string,owner:string,due:string>>")
    kept, asked = review.ingest_meetings(m)
    assert [(r["entity"], r["detail"], r["source"]) for r in kept.collect()] == [("boat", "why", "meeting:1")] and [r["id"] for r in asked.collect()] == ["meeting-1-d2"]
    one = spark.range(1)
    assert tuple(review.hit_rates(one, spark.range(4)).first()) == (4, 1, 0.25, 1.0)

    def fail(*_):
        raise RuntimeError("no")

    log = review.dispatch_chain([{"title": "a"}, {"title": "b"}], lambda t: 7 if t == "a" else None, lambda r: 8, fail, fail)
    assert [(x["issue"], x["status"]) for x in log] == [(7, "reused+issue-only"), (8, "created+issue-only")]


def test_search_surface(spark):
    assert search.query_terms("findBoatOwner, go HTTPServer") == ["find", "boat", "owner", "findboatowner", "http", "server", "httpserver"]
    d = search.index_terms(files(spark, {"src/boatYard.ts": "// old harbour\nconst pierList = 'salty dog'; return"}))
    (r,) = d.collect()
    assert r["terms"][:2] == ["src", "boat"] and set(r["terms"]) >= {"yard", "harbour", "pier", "salty", "dog"} and not {"const", "return"} & set(r["terms"])
    docs = spark.createDataFrame([(f"f{i}", ["boat", f"w{i}"] if i < 2 else ["pier"]) for i in range(9)], "file string, terms array<string>")
    v = spark.createDataFrame([("f8", [1.0, 0.0])], "file string, vec array<double>")
    got = {r["file"]: r["origin"] for r in search.fused_search(docs, v, "boats boat", [1.0, 0.0]).collect()}
    assert got == {"f0": "fts", "f1": "fts", "f8": "vec"}
    assert {r["origin"] for r in search.fused_search(docs, v, "boat", None).collect()} == {"fts"}


def test_communities_are_named(spark):
    m = spark.createDataFrame([("file:a/b/x.ts", 1), ("file:a/b/y.ts", 1), ("table:ORD_X", 2), ("plsql:ORD.GO", 2), ("file:z.ts", 2)], "id string, community long")
    assert {r["community"]: r["name"] for r in codegraph.community_names(m).collect()} == {1: "a/b", 2: "db/ORD"}


def test_trace_query_has_all_levels_of_a_large_package(spark, tmp_path):
    from arcwell import queries

    spark.range(900).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = queries.queries()["cross_tier_trace"](spark, str(tmp_path)).groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in got} == {1: 1, 2: 900, 3: 900}
