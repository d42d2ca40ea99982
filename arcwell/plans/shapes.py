"""Sources of many shapes, and what each says by hand: files for the extractors, of which a
table's row gets one by its key. Near misses, comments, nesting and broken text are shapes
as well. ``<k>`` in a text and in its answers is the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import dealt, table

#: (text, [(method, url, confidence, line)]).
CALLS = [
    ("const a = () => fetch('/api/c<k>/list');\n", [("GET", "/api/c<k>/list", "resolved", 1)]),
    ("await fetch(\n  '/api/c<k>',\n  {\n    headers: h(1),\n    method: 'POST',\n  }\n);\n", [("POST", "/api/c<k>", "resolved", 1)]),
    ("// fetch('/api/no<k>')\nconst s = 'fetched';\nprefetch.x = 1;\n", []),
    ("const r = await fetch(`/api/c<k>/${id}`, { method: 'DELETE' });\n", [("DELETE", "/api/c<k>/${id}", "resolved", 1)]),
    ("fetch(base + '/c<k>/tail');\nfetch(other);\n", [("GET", "/c<k>/tail", "inferred", 1)]),
    ("const options = { method: 'PUT' };\nfetch('/api/c<k>', options);\n", [("PUT", "/api/c<k>", "resolved", 2)]),
    ("axios.get('/api/c<k>');\naxios.post<Row>(\n  '/api/c<k>/new', body);\n", [("GET", "/api/c<k>", "resolved", 1), ("POST", "/api/c<k>/new", "resolved", 2)]),
    ("axios({\n  method: 'patch',\n  data: { url: 1 },\n  url: '/api/c<k>/one',\n});\n", [("PATCH", "/api/c<k>/one", "resolved", 1)]),
    ("axios({ url: '/api/c<k>/two', method: \"delete\" });\nconst row = { url: '/x' };\n", [("DELETE", "/api/c<k>/two", "resolved", 1)]),
    ("axios.create({ baseURL: '/api' });\nhttp.close('/api/c<k>');\n", []),
    ("this.http.get<User[]>('/api/c<k>/users').subscribe();\n", [("GET", "/api/c<k>/users", "resolved", 1)]),
    ("this.http.put(this.apiUrl + '/c<k>', body);\nthis.http.post(environment.apiUrl + '/c<k>/a', x);\n", [("PUT", "/c<k>", "inferred", 1), ("POST", "/c<k>/a", "inferred", 2)]),
    ("return this.http.get(`${this.base('x y')}/c<k>/deep?p=1`);\n", [("GET", "/c<k>/deep", "inferred", 1)]),
    ("const x = new XMLHttpRequest();\nx.open('POST', '/api/c<k>/xhr');\nwindow.open('/help');\n", [("POST", "/api/c<k>/xhr", "resolved", 2)]),
    ("load(() => {\n  fetch('/api/c<k>/in');\n  fetch('/api/c<k>/out', { method: 'POST' });\n});\n", [("GET", "/api/c<k>/in", "resolved", 2), ("POST", "/api/c<k>/out", "resolved", 3)]),
    ("fetch('/api/c<k>/broken', { method: 'POST'\n", [("POST", "/api/c<k>/broken", "resolved", 1)]),
    ("", []),
]

#: (path, text, [(method, route, line)]).
ENDPOINTS = [
    ("a/C<k>.java", '@RestController\n@RequestMapping("/api/e<k>")\npublic class C {\n  @GetMapping("/list")\n  void a() {}\n  @PostMapping\n  void b() {}\n}\n', [("GET", "/api/e<k>/list", 4), ("POST", "/api/e<k>", 6)]),
    ("a/C<k>.java", '@RequestMapping(\n    produces = "text/plain",\n    value = "/e<k>/"\n)\nclass C {\n  @PutMapping(\n    path = "{id}"\n  )\n  void a() {}\n  @RequestMapping(value = "/any")\n  void b() {}\n  @RequestMapping(value = "/p", method = RequestMethod.POST)\n  void c() {}\n}\n', [("PUT", "/e<k>/{id}", 6), ("ANY", "/e<k>/any", 10), ("POST", "/e<k>/p", 12)]),
    ("a/R<k>.java", '@Path("/e<k>")\npublic class R {\n  @GET\n  @Path("/x")\n  public R x() {}\n  @POST\n  public R y() {}\n  @Path("/z")\n  @DELETE\n  public R z() {}\n}\n', [("GET", "/e<k>/x", 3), ("POST", "/e<k>", 6), ("DELETE", "/e<k>/z", 9)]),
    ("a/M<k>.kt", '@Controller("/e<k>")\nclass M {\n  @Get("/m")\n  fun m() {}\n  @Post(uri = "/n")\n  fun n() {}\n}\nclass Other {\n  @Get("/o<k>")\n  fun o() {}\n}\n', [("GET", "/e<k>/m", 3), ("POST", "/e<k>/n", 5), ("GET", "/o<k>", 9)]),
    ("a/S<k>.java", '@WebServlet(urlPatterns = {"/e<k>/*"})\npublic class S extends HttpServlet {\n  protected void doGet(Req q) {}\n  public void doPost(Req q) {}\n  void doPut() {}\n}\n', [("GET", "/e<k>", 3), ("POST", "/e<k>", 4)]),
    ("a/N<k>.java", 'class N {\n  // @GetMapping("/no")\n  @GetMapping\n  void a() {}\n  protected void doGet(Req q) {}\n  String s = "class Path";\n}\n', []),
    ("routes/e<k>.ts", "router.get('/e<k>/a', h);\napp.post(\n  '/e<k>/b', h);\naxios.get('/e<k>/c');\nmap.get('key');\n// app.put('/e<k>/d', h)\n", [("GET", "/e<k>/a", 1)]),
    ("lib/e<k>.ts", "router.get('/e<k>/a', h);\n", []),
    ("api/n<k>.ts", "@Controller('e<k>')\nexport class N {\n  @Get(':id')\n  one() {}\n  @Post()\n  add() {}\n}\n", [("GET", "/e<k>/:id", 3), ("POST", "/e<k>", 5)]),
    ("api/p<k>.py", '@app.get("/e<k>")\ndef a(): pass\n\n@bp.route("/e<k>/r", methods=["POST"])\ndef b(): pass\n\n@bp.route("/e<k>/s")\ndef c(): pass\n', [("GET", "/e<k>", 1), ("POST", "/e<k>/r", 4), ("GET", "/e<k>/s", 7)]),
    ("docs/api<k>.md", 'router.get("/e<k>/a", h);\n', []),
]

#: (SQL, {table: (modes, {column: modes})}), modes of r and w.
STATEMENTS = [
    ("SELECT e.name, d.title FROM hr.employees e JOIN hr.dept<k> d ON e.dep = d.id", {"EMPLOYEES": ("r", {"NAME": "r", "DEP": "r"}), "DEPT<k>": ("r", {"TITLE": "r", "ID": "r"})}),
    ("INSERT INTO [dbo].[Client<k>] (name, code) VALUES (?, ?)", {"CLIENT<k>": ("w", {"NAME": "w", "CODE": "w"})}),
    ('UPDATE "public"."item<k>" SET x = x + 1, y = :y WHERE id = 2', {"ITEM<k>": ("w", {"X": "rw", "Y": "w", "ID": "r"})}),
    ("DELETE FROM `app`.`bill<k>` WHERE paid IS NULL -- FROM never", {"BILL<k>": ("w", {"PAID": "r"})}),
    ("WITH recent AS (SELECT id, v FROM t<k> WHERE day > 3), few(x) AS (SELECT id FROM recent) SELECT few.x, s.y FROM few JOIN s<k> s ON s.k = few.x", {"T<k>": ("r", {"ID": "r", "V": "r", "DAY": "r"}), "S<k>": ("r", {"Y": "r", "K": "r"})}),
    ("WITH RECURSIVE up AS (SELECT id, parent FROM node<k> UNION ALL SELECT n.id, n.parent FROM node<k> n JOIN up ON n.id = up.parent) SELECT * FROM up", {"NODE<k>": ("r", {"ID": "r", "PARENT": "r"})}),
    ("SELECT o.id, (SELECT max(l.v) FROM line<k> l WHERE l.oid = o.id) AS most FROM ord<k> o WHERE EXISTS (SELECT 1 FROM cust WHERE cid = o.cust) ORDER BY most", {"LINE<k>": ("r", {"V": "r", "OID": "r"}), "ORD<k>": ("r", {"ID": "r", "CUST": "r"}), "CUST": ("r", {"CID": "r"})}),
    ("MERGE INTO tgt<k> t USING (SELECT id, v FROM src WHERE z = 'into x') s ON (t.id = s.id) WHEN MATCHED THEN UPDATE SET t.v = s.v WHEN NOT MATCHED THEN INSERT (id, w) VALUES (s.id, s.v)", {"TGT<k>": ("w", {"ID": "rw", "V": "w", "W": "w"}), "SRC": ("r", {"ID": "r", "V": "r", "Z": "r"})}),
    ("INSERT INTO log<k> (a) SELECT u.x FROM (SELECT x FROM inner<k> WHERE f = 1) u", {"LOG<k>": ("w", {"A": "w"}), "INNER<k>": ("r", {"X": "r", "F": "r"})}),
    ("select o from Order o join o.items i where o.name = :n", {"ORDER": ("r", {"NAME": "r"})}),
    ("SELECT extract(year FROM p.born), trim(both ' ' from nick) FROM people<k> p FOR UPDATE OF nick", {"PEOPLE<k>": ("r", {"BORN": "r", "NICK": "r"})}),
    ("SELECT a FROM x<k>, y<k> WHERE x<k>.b = 1; UPDATE z<k> SET c = (SELECT m FROM w<k>)", {"X<k>": ("r", {"B": "r"}), "Y<k>": ("r", {}), "Z<k>": ("w", {"C": "w"}), "W<k>": ("r", {"M": "r"})}),
    ("INSERT INTO kv<k> (id, n) VALUES (1, 2) ON CONFLICT (id) DO UPDATE SET n = EXCLUDED.n", {"KV<k>": ("w", {"ID": "rw", "N": "w"})}),
    ("SELECT CASE WHEN a = 1 THEN b::date ELSE CAST(c AS varchar(9)) END z FROM one<k> GROUP BY a, z HAVING count(*) > 1", {"ONE<k>": ("r", {"A": "r", "B": "r", "C": "r"})}),
    ("SELECT g.v FROM generate_series(1, 9) g, dual /* FROM none */", {}),
    ("broken ( SELECT a FROM half<k> WHERE b = 'open", {"HALF<k>": ("r", {"A": "r", "B": "r"})}),
    ("", {}),
]

#: (text, [(type, name, package, params, return_type, line, end line, read, written)]).
UNITS = [
    ("CREATE OR REPLACE PROCEDURE P<k>(a IN NUMBER,\n  b VARCHAR2) IS\nBEGIN\n  INSERT INTO T1 VALUES (1);\nEND;\n/\nINSERT INTO LOOSE VALUES (2);\n", [("procedure", "P<k>", None, "a IN NUMBER, b VARCHAR2", None, 1, 5, "", "T1")]),
    ("CREATE PACKAGE BODY app.K<k> AS\n  PROCEDURE one IS\n  BEGIN\n    BEGIN\n      UPDATE A1 SET x = 1;\n    END;\n    IF y THEN\n      FOR r IN (SELECT * FROM A2) LOOP NULL; END LOOP;\n    END IF;\n    DELETE FROM A3;\n  END one;\n  FUNCTION two(z IN DATE) RETURN NUMBER IS\n  BEGIN RETURN CASE WHEN z = 1 THEN 2 END; END;\nBEGIN\n  INSERT INTO INIT VALUES (1);\nEND K<k>;\n/\n",
     [("package body", "K<k>", None, None, None, 1, 16, "", "INIT"), ("procedure", "ONE", "K<k>", None, None, 2, 11, "A2,A3", "A1,A3"), ("function", "TWO", "K<k>", "z IN DATE", "NUMBER", 12, 13, "", "")]),
    ("CREATE PACKAGE K<k> IS\n  PROCEDURE one(x NUMBER);\n  FUNCTION two\n    RETURN VARCHAR2;\nEND;\n/\n", [("package", "K<k>", None, None, None, 1, 5, "", ""), ("procedure", "ONE", "K<k>", "x NUMBER", None, 2, 2, "", ""), ("function", "TWO", "K<k>", None, "VARCHAR2", 3, 4, "", "")]),
    ("CREATE PROCEDURE q<k> AS\n  PROCEDURE part IS BEGIN SELECT 1 INTO v FROM IN_T; END;\nBEGIN\n  -- END; UPDATE NOT_T\n  x := 'END; DELETE FROM NOR_T';\n  /* BEGIN\n  */\n  MERGE INTO OUT_T USING D ON (1 = 1);\nEND;\n", [("procedure", "Q<k>", None, None, None, 1, 9, "", "OUT_T"), ("procedure", "PART", None, None, None, 2, 2, "IN_T", "")]),
    ("CREATE OR REPLACE TRIGGER g<k>\n  AFTER UPDATE OR DELETE ON H\nDECLARE n NUMBER;\nBEGIN\n  UPDATE LOG_T SET a = 1;\nEND;\n/\nCREATE VIEW v<k> AS SELECT a FROM B1 JOIN B2 ON 1 = 1;\nUPDATE LATER SET a = 1;\n", [("trigger", "G<k>", None, None, None, 1, 6, "", "LOG_T"), ("view", "V<k>", None, None, None, 8, 8, "B1,B2", "")]),
    ("DECLARE\n  a NUMBER;\nBEGIN\n  DELETE FROM NOBODY;\nEND;\n/\nCREATE SEQUENCE s<k>;\nCREATE UNIQUE INDEX i<k> ON app.TT (a);\nCREATE PUBLIC SYNONYM y<k> FOR other.thing;\n", [("sequence", "S<k>", None, None, None, 7, 7, "", ""), ("index", "I<k>", None, None, None, 8, 8, "TT", ""), ("synonym", "Y<k>", None, None, None, 9, 9, "", "")]),
    ("CREATE PROCEDURE open<k> IS\nBEGIN\n  UPDATE U1 SET a = 1;\nCREATE PROCEDURE next<k> IS\nBEGIN\n  UPDATE U2 SET a = 1;\nEND;\n", [("procedure", "OPEN<k>", None, None, None, 1, 4, "", "U1"), ("procedure", "NEXT<k>", None, None, None, 4, 7, "", "U2")]),
    ("-- CREATE PROCEDURE no<k> IS BEGIN NULL; END;\nSELECT 'CREATE VIEW w AS SELECT 1 FROM x';\n", []),
]


def pick(spark: SparkSession, sf: str, name: str, key: str, choices: list[str]) -> DataFrame:
    """(k, text): each row of a table with one of the texts, its key filled in."""
    d = dealt(table(spark, sf, name).select(F.col(key).alias("k")), "k")
    return d.select("k", _picked(choices).alias("text"))


def pick_files(spark: SparkSession, sf: str, name: str, key: str, choices: list[tuple[str, str]]) -> DataFrame:
    """(file, text): each row of a table with one of the (path, text), its key filled in."""
    d = dealt(table(spark, sf, name).select(F.col(key).alias("k")), "k")
    return d.select(_picked([p for p, _ in choices]).alias("file"), _picked([t for _, t in choices]).alias("text"))


def _picked(choices: list[str]) -> Column:
    text = F.get(F.array(*map(F.lit, choices)), (F.col("k") % len(choices)).cast("int"))
    return F.replace(text, F.lit("<k>"), F.col("k").cast("string"))


def answers(name: str, key: str, shapes: int, columns: str, rows: list[tuple]) -> str:
    """SQL of the rows that hold for a table: (shape, ...) with ``<k>`` filled in."""
    def literal(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else f"replace('{str(x).replace(chr(39), chr(39) * 2)}', '<k>', CAST({key} AS VARCHAR))"

    cases = " UNION ALL ".join(f"SELECT {key} AS k, {', '.join(f'{literal(x)} AS {c.strip()}' for c, x in zip(columns.split(','), row[1:], strict=True))} FROM {name} WHERE {key} % {shapes} = {row[0]}" for row in rows)
    return cases


#: ({path: text}, [(from file, type, method, to file, method, confidence)]) of scripts.
SCRIPTS = [
    ({"w<k>/page.ts": "import { Api<k> } from './api';\nexport class Page<k> {\n  constructor(private api: Api<k>) {}\n  load() { this.api.save(1); }\n}\n", "w<k>/api.ts": "export class Api<k> {\n  save(x) { return x; }\n}\n"},
     [("w<k>/page.ts", "Page<k>", "load", "w<k>/api.ts", "save", "resolved")]),
    ({"w<k>/one.ts": "class One<k> {\n  a() { this.b(); help<k>(2); }\n  b() { if (x) { return; } }\n}\nfunction help<k>(n) { const o = new One<k>(); o.a(); }\n"},
     [("w<k>/one.ts", "One<k>", "a", "w<k>/one.ts", "b", "resolved"), ("w<k>/one.ts", "One<k>", "a", "w<k>/one.ts", "help<k>", "resolved"), ("w<k>/one.ts", None, "help<k>", "w<k>/one.ts", "a", "resolved")]),
    ({"w<k>/use.js": "export const use<k> = (c) => {\n  const t = new Two<k>();\n  t.go(); t.stay();\n};\n", "w<k>/a.ts": "class Two<k> { go() {} }\n", "w<k>/b.ts": "class Two<k> { go() {} stay() {} }\n"},
     [("w<k>/use.js", None, "use<k>", "w<k>/a.ts", "go", "inferred"), ("w<k>/use.js", None, "use<k>", "w<k>/b.ts", "go", "inferred"), ("w<k>/use.js", None, "use<k>", "w<k>/b.ts", "stay", "inferred")]),
    ({"w<k>/no.ts": "class No<k> {\n  private x: Far<k>;\n  a() { /* this.x.f() */ const s = 'this.x.f()'; y.f(); this.x.unknown(); }\n}\nclass Far<k> { f() {} }\n", "w<k>/no.md": "class Md<k> { a() { this.a(); } }\n"}, []),
    ({"w<k>/in.ts": "export class In<k> {\n  svc = inject(Svc<k>);\n  private late: Svc<k> = new Svc<k>();\n  run() { list.map(() => { this.svc.ping(); }); }\n  more(p: Svc<k>) { p.pong(); this.late.ping(); }\n}\n", "w<k>/svc.ts": "export class Svc<k> {\n  ping(): void {}\n  async pong<T>(a: T): Promise<T> { return a; }\n}\n"},
     [("w<k>/in.ts", "In<k>", "run", "w<k>/svc.ts", "ping", "resolved"), ("w<k>/in.ts", "In<k>", "more", "w<k>/svc.ts", "pong", "resolved"), ("w<k>/in.ts", "In<k>", "more", "w<k>/svc.ts", "ping", "resolved")]),
]


#: (path, text, [(routine, package, confidence, line)]) of calls of stored routines.
ROUTINE_CALLS = [
    ("s/A<k>.java", '@Procedure(procedureName = "pkg.load<k>")\nvoid a();\n@Procedure("save<k>")\nvoid b();\n', [("LOAD<k>", "PKG", "resolved", 1), ("SAVE<k>", None, "resolved", 3)]),
    ("s/B<k>.kt", '@NamedStoredProcedureQuery(\n  name = "x",\n  procedureName = "app.pkg.run<k>")\nclass B\n', [("RUN<k>", "PKG", "resolved", 1)]),
    ("s/C<k>.java", 'new SimpleJdbcCall(t)\n  .withCatalogName("cat<k>")\n  .withProcedureName("go");\nnew SimpleJdbcCall(t).withProcedureName("solo<k>");\n', [("GO", "CAT<k>", "resolved", 2), ("SOLO<k>", None, "resolved", 4)]),
    ("s/D<k>.java", 'c.prepareCall("{call app.pkg.put<k>(?)}");\nc.prepareCall("{? = call f<k>(?)}");\nString s = "PKG.OTHER<k>";\n', [("PUT<k>", "PKG", "resolved", 1), ("F<k>", None, "resolved", 2), ("OTHER<k>", "PKG", "inferred", 3)]),
    ("s/e<k>.js", "const oracledb = require('oracledb');\nawait c.execute(`BEGIN pkg.one<k>(:a); END;`);\nawait c.execute('select 1 from t');\n", [("ONE<k>", "PKG", "resolved", 2)]),
    ("s/f<k>.py", "import cx_Oracle\ncur.callproc('pkg.two<k>', [1])\n", [("TWO<k>", "PKG", "resolved", 2)]),
    ("s/g<k>.cs", 'var a = new OracleCommand("pkg.three<k>", c);\nvar b = new SqlCommand("select x from y", c);\n', [("THREE<k>", "PKG", "resolved", 1)]),
    ("s/H<k>.java", 'em.createStoredProcedureQuery("four<k>");\n// em.createStoredProcedureQuery("never")\n', [("FOUR<k>", None, "resolved", 1)]),
    ("s/I<k>.java", 'String s = "PKG.NO_KEYWORD<k>";\n', []), ("s/J<k>.test.ts", "cur.callproc('pkg.no<k>')\n", []), ("s/k<k>.md", "cur.callproc('pkg.no<k>')\n", []),
]
