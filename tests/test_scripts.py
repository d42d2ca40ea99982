"""Symbols and method calls of scripts against hand-made answers, and a level of symbols."""

from arcwell.operators import codegraph
from arcwell.sources import scripts

TREE = {
    "web/page.ts": """import { Api } from './api';
import { helper as help, other } from './tools';
export class Page extends Base<Foo> {
  private svc: BoatService;
  readonly log = inject(Logger);
  constructor(private readonly api: Api, thing: Thing) { super(); this.late = new Late(); }
  get value(): number { return this.svc.one(); }
  async load<T>(crew: Crew): Promise<T> {
    if (x) { crew.sail('a(b'); } // crew.no()
    const boat = new Boat();
    boat.go(() => { this.api.save(); });
    this.value();
    other(1); local(2); `${boat.never()}`;
    this.late.run(); thing.touch(); boat.unknown();
  }
  abstract nope(): void;
}
function local(n) { return outer(n); }
export const outer = (a: Api) => { a.save(); };
const not = (1 + 2);
""",
    "web/api.ts": "export class Api { save() {} }\n", "web/tools.ts": "export function helper() {}\nexport function other() { helper(); }\n",
    "web/boat.ts": "class Boat { go(f) { f(); } }\nclass BoatService { one() {} }\n", "web/crew1.ts": "class Crew { sail() {} }", "web/crew2.js": "class Crew { sail() {} }",
    "web/late.ts": "export class Late { run() { if (a) { return; } } }\nclass Api { save() {} }", "notes.md": "class Boat { go() {} }", "web/broken.ts": "class Broken { run( { ", "web/empty.ts": None,
}


def test_scan():
    found = {(kind, owner, name, line) for kind, owner, name, line, _, _ in scripts.scan_symbols(TREE["web/page.ts"])}
    assert found == {("class", None, "Page", 3), ("method", "Page", "constructor", 6), ("method", "Page", "value", 7), ("method", "Page", "load", 8), ("function", None, "local", 18), ("function", None, "outer", 19)}
    assert [s[:3] for s in scripts.scan_symbols(TREE["web/broken.ts"])] == [("class", None, "Broken")]


def test_method_edges(spark):
    d = spark.createDataFrame(list(TREE.items()), "file string, text string").repartition(3)
    got = {tuple(r) for r in scripts.script_method_edges(d).collect()}
    page = "web/page.ts"
    assert got == {
        (page, "Page", "value", "web/boat.ts", "one", "resolved"), (page, "Page", "load", "web/crew1.ts", "sail", "inferred"), (page, "Page", "load", "web/crew2.js", "sail", "inferred"),
        (page, "Page", "load", "web/boat.ts", "go", "resolved"), (page, "Page", "load", "web/api.ts", "save", "resolved"), (page, "Page", "load", page, "value", "resolved"),
        (page, "Page", "load", "web/tools.ts", "other", "resolved"), (page, "Page", "load", page, "local", "resolved"), (page, "Page", "load", "web/late.ts", "run", "resolved"),
        (page, None, "local", page, "outer", "resolved"), (page, None, "outer", "web/api.ts", "save", "resolved"), ("web/tools.ts", None, "other", "web/tools.ts", "helper", "resolved")}
    e = {(r["from_id"], r["to_id"], r["via"]) for r in codegraph.build_impact_graph(methods=scripts.script_method_edges(d)).collect()}
    assert ("method:web/page.ts#Page.load", "method:web/api.ts#save", "call") in e and ("method:web/page.ts#local", "method:web/page.ts#outer", "call") in e


def test_symbol_level(spark):
    d = spark.createDataFrame(list(TREE.items()), "file string, text string")
    files = d.selectExpr("file", "'front' AS layer", "CASE WHEN file LIKE 'web/c%' THEN 'crew' ELSE 'web' END AS module")
    level = codegraph.symbol_level(scripts.script_method_edges(d), files, ["web/page.ts"], ["front"], ["web"])
    got = {(r["a"], r["b"]): (r["weight"], r["resolved"]) for r in level.collect()}
    assert got == {
        ("symbol:web/page.ts#value", "file:web/boat.ts"): (1, 1), ("symbol:web/page.ts#load", "module:crew"): (2, 0), ("symbol:web/page.ts#load", "file:web/boat.ts"): (1, 1),
        ("symbol:web/page.ts#load", "file:web/api.ts"): (1, 1), ("symbol:web/page.ts#load", "symbol:web/page.ts#value"): (1, 1), ("symbol:web/page.ts#load", "file:web/tools.ts"): (1, 1),
        ("symbol:web/page.ts#load", "symbol:web/page.ts#local"): (1, 1), ("symbol:web/page.ts#load", "file:web/late.ts"): (1, 1), ("symbol:web/page.ts#local", "symbol:web/page.ts#outer"): (1, 1), ("symbol:web/page.ts#outer", "file:web/api.ts"): (1, 1)}
