"""Queries of the extractors over sources of many shapes; what they must find is written by
hand in ``plans.shapes``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import codegraph
from .plans import facts, shapes
from .plans.session import dealt, table
from .queries import TRADE, query
from .sources import dbcalls, dbsource, extract, scripts, sqlscope, webforms

CALLS = [(i, *row) for i, (_, found) in enumerate(shapes.CALLS) for row in found]
ENDPOINTS = [(i, path, *row) for i, (path, _, found) in enumerate(shapes.ENDPOINTS) for row in found]
MODES = {"r": "read", "w": "write"}
TABLES = [(i, t, MODES[m]) for i, (_, found) in enumerate(shapes.STATEMENTS) for t, (modes, _) in found.items() for m in modes]
COLUMNS = [(i, t, c, MODES[m]) for i, (_, found) in enumerate(shapes.STATEMENTS) for t, (_, own) in found.items() for c, modes in own.items() for m in modes]
UNITS = [(i, *row) for i, (_, found) in enumerate(shapes.UNITS) for row in found]


def _files(spark, sf, path: str, texts: list[str]):
    d = shapes.pick(spark, sf, "customer", "c_custkey", texts)
    return d.select(F.format_string(path, "k").alias("file"), "text")


@query(f"SELECT 'web/c' || k || '.ts' AS file, method, url, confidence, CAST(line_no AS INTEGER) AS line_no FROM ({shapes.answers('customer', 'c_custkey', len(shapes.CALLS), 'method, url, confidence, line_no', CALLS)})")
def http_call_forms(spark, sf):
    """Calls of every form, over several lines, commented out, broken."""
    return webforms.http_calls(_files(spark, sf, "web/c%d.ts", [t for t, _ in shapes.CALLS]))


@query(f"SELECT file, method, route, CAST(line_no AS INTEGER) AS line_no FROM ({shapes.answers('customer', 'c_custkey', len(shapes.ENDPOINTS), 'file, method, route, line_no', ENDPOINTS)})")
def endpoint_forms(spark, sf):
    """Endpoints of Spring, JAX-RS, Micronaut, servlets, routers and decorators."""
    return webforms.endpoints(shapes.pick_files(spark, sf, "customer", "c_custkey", [(p, t) for p, t, _ in shapes.ENDPOINTS]))


def _statements(spark, sf):
    return shapes.pick(spark, sf, "orders", "o_orderkey", [s for s, _ in shapes.STATEMENTS]).select(F.col("k").alias("key"), F.col("text").alias("sql"))


@query(f"SELECT k AS key, table_name, mode FROM ({shapes.answers('orders', 'o_orderkey', len(shapes.STATEMENTS), 'table_name, mode', TABLES)})")
def sql_scopes(spark, sf):
    """Tables of statements with subqueries, common table expressions and aliases."""
    return sqlscope.sql_access(_statements(spark, sf))


@query(f"SELECT k AS key, table_name, column_name, mode FROM ({shapes.answers('orders', 'o_orderkey', len(shapes.STATEMENTS), 'table_name, column_name, mode', COLUMNS)})")
def sql_scope_columns(spark, sf):
    """Columns that the same statements read and write."""
    return sqlscope.column_access(_statements(spark, sf))


@query(f"SELECT 'db/u' || k || '.sql' AS file, type, name, package, params, return_type, CAST(line_no AS INTEGER) AS line_no, CAST(end_line AS INTEGER) AS end_line, tables_read, tables_written FROM ({shapes.answers('customer', 'c_custkey', len(shapes.UNITS), 'type, name, package, params, return_type, line_no, end_line, tables_read, tables_written', UNITS)})")
def database_units(spark, sf):
    """Objects with nested blocks, local routines, initialisers and statements after their end."""
    d = dbsource.object_facts(dbsource.units(_files(spark, sf, "db/u%d.sql", [t for t, _ in shapes.UNITS])))
    return d.select("file", "type", "name", "package", "params", "return_type", "line_no", "end_line", F.array_join("tables_read", ",").alias("tables_read"), F.array_join("tables_written", ",").alias("tables_written"))


METHODS = [(i, *row) for i, (_, found) in enumerate(shapes.SCRIPTS) for row in found]


@query(f"SELECT from_file, from_type, from_method, to_file, to_method, confidence FROM ({shapes.answers('supplier', 's_suppkey', len(shapes.SCRIPTS), 'from_file, from_type, from_method, to_file, to_method, confidence', METHODS)})")
def script_methods(spark, sf):
    """Calls on fields, parameters, names and the own class, imported or declared elsewhere."""
    s = dealt(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    each = F.array(*[F.array(*[F.struct(F.lit(p).alias("file"), F.lit(t).alias("text")) for p, t in tree.items()]) for tree, _ in shapes.SCRIPTS])
    d = s.select("k", F.explode(F.get(each, (F.col("k") % len(shapes.SCRIPTS)).cast("int"))).alias("f"))
    fill = lambda c: F.replace(c, F.lit("<k>"), F.col("k").cast("string"))
    return scripts.script_method_edges(d.select(fill(F.col("f.file")).alias("file"), fill(F.col("f.text")).alias("text")))


@query(f"""SELECT 'endpoint' AS kind, method || ' ' || route AS label, file FROM ({shapes.answers('customer', 'c_custkey', len(shapes.ENDPOINTS), 'file, method, route, line_no', ENDPOINTS)})
UNION ALL SELECT 'root', 'web/r' || c_custkey || '.tsx', 'web/r' || c_custkey || '.tsx' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def code_entry_points(spark, sf):
    """Endpoints, and screens that no file imports."""
    c = table(spark, sf, "customer").select(F.format_string("web/r%d.tsx", "c_custkey").alias("file"), F.lit("tsx").alias("ext"), F.lit("frontend").alias("layer"))
    imports = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.format_string("web/o%d.ts", "o_orderkey").alias("from_file"), F.format_string("web/r%d.tsx", "o_custkey").alias("to_file"))
    ends = endpoint_forms(spark, sf)
    return codegraph.entry_points(ends, ends.select(F.lit("").alias("kind"), "method", "file").where("false"), c, imports)


@query(f"""WITH {TRADE} SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT to_id AS x FROM trade WHERE from_id = n.id)) AS callees,
(SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT from_id AS x FROM trade WHERE to_id = n.id)) AS callers, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS symbols FROM (SELECT min(to_id) AS id FROM trade) AS n""")
def file_profile(spark, sf):
    """What a file uses, what uses it, and its types."""
    e = facts.nation_trade(spark, sf).select(F.col("from_id").alias("from_file"), F.col("to_id").alias("to_file"), "confidence")
    file = e.agg(F.min("to_file")).first()[0] or ""  # nothing is traded: the types are there all the same
    d = codegraph.file_profile(file, e, table(spark, sf, "region").select(F.lit(file).alias("file"), F.col("r_name").alias("name")))
    parts = ("callees", "callers", "symbols")
    lists = d.agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == c, F.col("name")))).alias(c) for c in parts])  # nations and regions are few
    return lists.select(*[F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in parts])


@query("SELECT 'web/harbour' || s_suppkey || '-service.ts' AS file, 'api/Harbour' || s_suppkey || 'Controller.java' AS to_file FROM supplier WHERE s_nationkey < 12")
def name_fallback(spark, sf):
    """Files and the first endpoint file of the same domain word; general and short words have none."""
    s = table(spark, sf, "supplier")
    named = lambda d, p: d.select(F.format_string(p, "s_suppkey").alias("file"))
    ends = named(s.where("s_nationkey < 12"), "api/Harbour%dController.java").unionByName(named(s, "api/ListController.java%.0s")).unionByName(named(s.where("s_nationkey < 12"), "z/harbour%d-api.ts")).unionByName(named(s, "api/AbcController.java%.0s"))
    return extract.match_by_name(named(s, "web/harbour%d-service.ts").unionByName(named(s, "web/list.ts%.0s")).unionByName(named(s, "web/abc.ts%.0s")), ends)


@query(f"SELECT column_name, mode, k || '.java' AS file FROM ({shapes.answers('orders', 'o_orderkey', len(shapes.STATEMENTS), 'table_name, column_name, mode', COLUMNS)}) WHERE table_name = 'SRC'")
def column_lineage(spark, sf):
    """Files that read or write a table's columns."""
    d = sqlscope.column_access(_statements(spark, sf)).withColumn("file", F.format_string("a/%d.java", "key"))
    return codegraph.column_lineage(d, "src")


ROUTINES = [(i, path, *row) for i, (path, _, found) in enumerate(shapes.ROUTINE_CALLS) for row in found]


@query(f"SELECT routine, package, file, CAST(line_no AS INTEGER) AS line_no, confidence FROM ({shapes.answers('customer', 'c_custkey', len(shapes.ROUTINE_CALLS), 'file, routine, package, confidence, line_no', ROUTINES)})")
def routine_call_forms(spark, sf):
    """Stored routines called in nine styles, over several lines, and names in strings."""
    return dbcalls.db_calls(shapes.pick_files(spark, sf, "customer", "c_custkey", [(p, t) for p, t, _ in shapes.ROUTINE_CALLS]))
