"""Source files written from the driver's tables, a few lines a row: the tables hold no code,
and the extractors read text. What each file declares follows from its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table


def _fill(text: str, **parts: str) -> Column:
    """``text`` with <name> replaced by columns."""
    out = F.lit(text)
    for name, column in parts.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.col(column).cast("string"))
    return out


def _file(d: DataFrame, path: str, text: str, **parts: str) -> DataFrame:
    return d.select(_fill(path, **parts).alias("file"), _fill(text, **parts).alias("text"))


SCREEN = "export const Screen<k> = () => fetch('/api/items<k>/list');\n"
CONTROLLER = '''@RestController
@RequestMapping("/api/items<k>")
public class Items<k>Controller {
  @GetMapping("/list")
  public void list() { run("{call PKG_<n>.LOAD_<k>(?)}"); }
}
'''
ROUTINE = "  PROCEDURE LOAD_<k> IS\n  BEGIN\n    UPDATE STOCK_<n> SET QTY = 1;\n  END;\n"


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    """A screen and a controller a supplier, a package a nation with a routine a supplier."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    parts = {"k": "s_suppkey", "n": "s_nationkey"}
    routines = s.select("s_nationkey", _fill(ROUTINE, **parts).alias("r")).groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("r")), "").alias("r"))
    body = F.concat(_fill("CREATE OR REPLACE PACKAGE BODY PKG_<n> AS\n", n="s_nationkey"), "r", F.lit("END;\n"))
    packages = routines.select(_fill("db/pkg_<n>.pkb", n="s_nationkey").alias("file"), body.alias("text"))
    return _file(s, "web/pages/Screen<k>.tsx", SCREEN, **parts).unionByName(_file(s, "server/controllers/Items<k>Controller.java", CONTROLLER, **parts)).unionByName(packages)


def schemas(spark: SparkSession, sf: str) -> DataFrame:
    """A table of three columns a nation, its key told in three ways."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    text = "CREATE TABLE app.nation_<n> (\n id INT PRIMARY KEY,\n total NUMERIC(10, 2) NOT NULL,\n owner INT, -- told below\n CONSTRAINT f FOREIGN KEY (owner) REFERENCES region_<r> (id)\n);\n"
    return _file(n, "db/nation_<n>.sql", text, n="n_nationkey", r="n_regionkey")


def java(spark: SparkSession, sf: str) -> DataFrame:
    """An interface a region, and a class a nation that names it: imported by name, in the same
    package, imported with its package, or not at all."""
    r = _file(table(spark, sf, "region"), "geo/Area<r>.java", "package geo.r<r>;\npublic interface Area<r> {}\n", r="r_regionkey")
    n = table(spark, sf, "nation")
    heads = ("package nat.n<n>;\nimport geo.r<r>.Area<r>;\n", "package geo.r<r>;\n", "package nat.n<n>;\nimport geo.r<r>.*;\n", "package nat.n<n>;\n")
    for i, head in enumerate(heads):
        r = r.unionByName(_file(n.where(F.col("n_nationkey") % 4 == i), "nat/Nation<n>.java", head + "public class Nation<n> implements Area<r> {\n  private final Area<r> area = null;\n  void go() { area.visit(); }\n}\n", n="n_nationkey", r="n_regionkey"))
    return r


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """A function a part, with as many nested conditions as the rest of its size by four."""
    p = table(spark, sf, "part").withColumn("depth", F.col("p_size") % 4)
    p = p.withColumn("body", F.concat(F.repeat(F.lit("if (a > 1) { "), F.col("depth")), F.lit("x();"), F.repeat(F.lit(" }"), F.col("depth"))))
    return _file(p, "src/part<k>.ts", "function part<k>(a) { <body> }\n", k="p_partkey", body="body")


def screens(spark: SparkSession, sf: str) -> DataFrame:
    """A screen a supplier that names its controller by its own name and another file by a
    string; every second of these files has a namesake."""
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10).alias("o"))
    others = spark.range(10).select(F.col("id").alias("o"))
    out = _file(s, "s/kit<k>.osw", '{"a": "Other<o>"}', k="s_suppkey", o="o").unionByName(_file(s, "x/Kit<k>Controller.tsx", "", k="s_suppkey"))
    return out.unionByName(_file(others, "x/Other<o>.ts", "", o="o")).unionByName(_file(others.where("o % 2 = 0"), "y/Other<o>.ts", "", o="o"))


#: Lines that a rule fits, and near misses.
LINES = (
    ("todo", "// TODO later"), ("", "const mytodos = 1"), ("sql-injection", "run(\"select x from t where y = \" + z)"), ("", "run(\"select x from t\")"), ("command-injection", "new ProcessBuilder(a + b)"), ("", "new ProcessBuilder(a)"),
    ("eval", "return eval(code)"), ("", "// eval(code)"), ("empty-catch", "try { x() } catch (e) { }"), ("", "try { x() } catch (e) { log(e) }"), ("weak-crypto", "digest(\"MD5\")"), ("", "// once MD5"),
    ("insecure-random", "const token = Math.random()"), ("", "const token = random()"), ("cors", "cors({ origin: '*' })"), ("", "cors({ origin: 'a.example' })"), ("tls-off", "const a = { rejectUnauthorized: false }"), ("", "const a = { rejectUnauthorized: true }"),
    ("sensitive-log", "console.log(cpf)"), ("", "console.log(name)"), ("hard-coded", "password = \"abcd\""), ("", "password = \"ab\""),
)


def risky(spark: SparkSession, sf: str) -> DataFrame:
    """A file a part, with one of LINES."""
    line = F.get(F.array(*[F.lit(t) for _, t in LINES]), (F.col("p_partkey") % len(LINES)).cast("int"))
    return table(spark, sf, "part").select(_fill("src/p<k>.ts", k="p_partkey").alias("file"), line.alias("text"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """(file, ext, layer) paths of customers: names, folders and endings by their keys."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    folder = F.get(F.array(*map(F.lit, ("src/pages", "api/controllers", "api/repositories", "shop-frontend/src", "lib"))), (n % 5).cast("int"))
    name = F.get(F.array(*map(F.lit, ("Service", "Page", "-repository", "main", "Dto"))), (k % 5).cast("int"))
    ext = F.get(F.array(*map(F.lit, ("ts", "tsx", "java", "pkg", "component.ts", "less"))), (k % 6).cast("int"))
    d = table(spark, sf, "customer").select(F.concat(folder, F.lit("/"), F.when(name == "main", "main").otherwise(F.concat(F.lit("Item"), k.cast("string"), name)), F.lit("."), ext).alias("file"), "c_custkey", "c_nationkey")
    return d.withColumn("ext", F.regexp_extract("file", "\\.([^./]+)$", 1))


PATHS_SQL = """
ps AS (SELECT c_custkey, c_nationkey, ['src/pages', 'api/controllers', 'api/repositories', 'shop-frontend/src', 'lib'][c_nationkey % 5 + 1] AS folder, ['Service', 'Page', '-repository', 'main', 'Dto'][c_custkey % 5 + 1] AS said, ['ts', 'tsx', 'java', 'pkg', 'component.ts', 'less'][c_custkey % 6 + 1] AS e FROM customer),
pa AS (SELECT *, folder || '/' || CASE said WHEN 'main' THEN 'main' ELSE 'Item' || c_custkey || said END || '.' || e AS file, CASE e WHEN 'component.ts' THEN 'ts' ELSE e END AS ext FROM ps)"""
