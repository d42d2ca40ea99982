"""Queries of the code graph, its metrics, reviews and helpers, each with its SQL. Files come
from ``plans.code``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalars
from .operators import codegraph, govern, metrics, review
from .plans import code, facts
from .plans.session import checkpoint, table
from .queries import PARTS, QUERIES, SHARES, SQL, TRADE, _daily, query
from .sources import dbcalls, dbsource, extract, lines, metrics_scan, repo, resolve, structure, webforms

__all__ = ["QUERIES", "SQL"]

RULES = ", ".join(f"({i}, '{rule}')" for i, (rule, _) in enumerate(code.LINES) if rule)
LEVELS = ", ".join(f"('{i}', '{level}', '{title}')" for i, level, title, _, _ in extract.RISKS)
PAIRS = f"{TRADE}, t AS (SELECT from_id AS from_file, to_id AS to_file FROM trade), md AS (SELECT 'n' || n_nationkey AS file, 'r' || n_regionkey AS module, 'L' || (n_regionkey % 2) AS layer FROM nation)"
DEG = f"{PAIRS}, dg AS (SELECT id, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT to_file AS id, 1 AS i, 0 AS o FROM t UNION ALL SELECT from_file, 0, 1 FROM t) GROUP BY 1)"


def _pairs(spark, sf) -> DataFrame:
    return facts.nation_trade(spark, sf).select(F.col("from_id").alias("from_file"), F.col("to_id").alias("to_file"), "confidence")


def _modules(spark, sf) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, sf, "nation").select(name("n", F.col("n_nationkey")).alias("file"), name("r", F.col("n_regionkey")).alias("module"), name("L", F.col("n_regionkey") % 2).alias("layer"))


# -- Code to graph -------------------------------------------------------------------


def _facts(spark, sf, kept=False):
    """``kept``: facts that a query reads several times, cut from the texts once."""
    d = code.tiers(spark, sf)
    front, back, data = (d.where(F.col("file").startswith(p)) for p in ("web/", "server/", "db/"))
    units = dbsource.units(data)
    units = checkpoint(units) if kept else units
    found = webforms.http_calls(front), webforms.endpoints(back), dbcalls.db_calls(back), dbsource.object_facts(units), dbsource.routine_calls(units)
    return tuple(checkpoint(x) for x in found) if kept else found


@query("SELECT 'http-call' AS via, 'file' AS from_kind, 'file' AS to_kind, 'resolved' AS confidence, count(*) AS n FROM supplier UNION ALL SELECT 'db-call', 'file', 'plsql', 'resolved', count(*) FROM supplier UNION ALL SELECT 'writes', 'plsql', 'table', 'resolved', count(*) FROM supplier UNION ALL SELECT 'defined-in', 'plsql', 'file', 'resolved', count(*) + count(DISTINCT s_nationkey) FROM supplier")
def code_impact_edges(spark, sf):
    """Files to typed edges, through every extractor on the way."""
    calls, ends, db_calls, objects, inner = _facts(spark, sf, True)
    e = codegraph.build_impact_graph(http=codegraph.http_edges(calls, ends), db_calls=db_calls, objects=objects, routine_calls=inner)
    return e.groupBy("via", "from_kind", "to_kind", "confidence").agg(F.count("*").alias("n"))


def _call_graph(spark, sf):
    calls, ends, db_calls, objects, inner = _facts(spark, sf, True)
    none = db_calls.select("file", F.lit("").alias("table_name"), F.lit("read").alias("mode"), "confidence").where(F.lit(False))
    return codegraph.call_graph(calls, ends, objects, inner, db_calls, none)


@query("""SELECT 'fe:web/pages/Screen' || s_suppkey || '.tsx' AS from_id, 'be:server/controllers/Items' || s_suppkey || 'Controller.java' AS to_id, 'HTTP_CALL' AS type, 'resolved' AS confidence, 'GET /api/items' || s_suppkey || '/list' AS label FROM supplier
UNION ALL SELECT 'be:server/controllers/Items' || s_suppkey || 'Controller.java', 'db:PKG_' || s_nationkey, 'DB_CALL', 'resolved', 'PKG_' || s_nationkey || '.LOAD_' || s_suppkey FROM supplier
UNION ALL SELECT DISTINCT 'db:PKG_' || s_nationkey, 'tbl:STOCK_' || s_nationkey, 'TABLE_ACCESS', 'resolved', 'write' FROM supplier""")
def call_graph_edges(spark, sf):
    return _call_graph(spark, sf)[1]


@query("SELECT 'frontend' AS layer, count(*) AS n FROM supplier UNION ALL SELECT 'backend', count(*) FROM supplier UNION ALL SELECT 'database', 2 * count(DISTINCT s_nationkey) FROM supplier")
def call_graph_nodes(spark, sf):
    return metrics.counts_by(_call_graph(spark, sf)[0], "layer")


@query("""WITH m AS (SELECT min(s_nationkey) AS n FROM supplier), s AS (SELECT s_suppkey AS k, n FROM supplier, m WHERE s_nationkey = n)
SELECT DISTINCT 'db:PKG_' || n AS id, 'database' AS layer, 1 AS depth FROM m UNION ALL SELECT 'file:server/controllers/Items' || k || 'Controller.java', 'backend', 2 FROM s UNION ALL SELECT 'file:web/pages/Screen' || k || '.tsx', 'frontend', 3 FROM s""")
def cross_tier_trace(spark, sf):
    """All that hangs on one table, back to the screens."""
    nodes, edges = _call_graph(spark, sf)
    none = edges.select(F.lit("").alias("from_file"), F.lit("").alias("to_file"), F.lit("").alias("kind"), F.lit("").alias("confidence")).where(F.lit(False))
    first = table(spark, sf, "supplier").agg(F.min("s_nationkey")).first()[0]
    entry = codegraph.resolve_entry(nodes, f"stock_{first}")
    return codegraph.cross_tier_trace(codegraph.trace_edges(none, edges), entry, None)[0]


@query("SELECT 'LOAD_' || s_suppkey AS name, 'PKG_' || s_nationkey AS package, 'db/pkg_' || s_nationkey || '.pkb' AS file FROM supplier WHERE s_nationkey % 2 = 0")
def dead_routines(spark, sf):
    """Routines of the packages that no call names, when only odd ones are called."""
    _, _, db_calls, objects, inner = _facts(spark, sf)
    odd = db_calls.where(F.substring_index("package", "_", -1).cast("int") % 2 == 1)
    return codegraph.dead_routines(objects, inner, odd)


@query("SELECT 'procedure' AS type, 'LOAD_' || s_suppkey AS name, 'PKG_' || s_nationkey AS package, 'STOCK_' || s_nationkey AS written FROM supplier UNION ALL SELECT DISTINCT 'package body', 'PKG_' || s_nationkey, NULL, '' FROM supplier")
def database_objects(spark, sf):
    return _facts(spark, sf)[3].select("type", "name", "package", F.array_join("tables_written", ",").alias("written"))


@query("SELECT 'GET' AS method, '/api/items' || s_suppkey || '/list' AS route, 'server/controllers/Items' || s_suppkey || 'Controller.java' AS file, 4 AS line_no FROM supplier")
def endpoints(spark, sf):
    return _facts(spark, sf)[1].select("method", "route", "file", "line_no")


@query("SELECT 'LOAD_' || s_suppkey AS name, 'PKG_' || s_nationkey AS package, 'write' AS mode FROM supplier WHERE 'STOCK_' || s_nationkey LIKE '%STOCK_1%'")
def table_access(spark, sf):
    return codegraph.table_access(_facts(spark, sf)[3], "stock_1")


@query("SELECT 'nation_' || n_nationkey AS table_name, unnest(['id', 'total', 'owner']) AS column_name, unnest(['INT', 'NUMERIC(10, 2)', 'INT']) AS type, unnest([false, false, true]) AS nullable, unnest([true, false, false]) AS primary_key, unnest([NULL, NULL, 'region_' || n_regionkey]) AS ref_table FROM nation")
def schema_tables(spark, sf):
    return structure.db_tables(code.schemas(spark, sf)).select("table_name", "column_name", "type", "nullable", "primary_key", "ref_table")


@query("SELECT 'src/part' || p_partkey || '.ts' AS file, 'part' || p_partkey AS name, 1 AS line_no, 1 + p_size % 4 AS cyclomatic, (p_size % 4) * (p_size % 4 + 1) // 2 AS cognitive, p_size % 4 AS max_nesting FROM part")
def function_metrics(spark, sf):
    return metrics_scan.function_metrics(code.functions(spark, sf))


@query("SELECT 's/kit' || s_suppkey || '.osw' AS from_id, 'x/Kit' || s_suppkey || 'Controller.tsx' AS to_id, 'resolved' AS confidence FROM supplier UNION ALL SELECT 's/kit' || s_suppkey || '.osw', 'x/Other' || s_suppkey % 10 || '.ts', CASE WHEN s_suppkey % 2 = 0 THEN 'inferred' ELSE 'resolved' END FROM supplier UNION ALL SELECT 's/kit' || s_suppkey || '.osw', 'y/Other' || s_suppkey % 10 || '.ts', 'inferred' FROM supplier WHERE s_suppkey % 2 = 0")
def screen_links(spark, sf):
    return structure.screen_links(code.screens(spark, sf))


@query("SELECT 'nat/Nation' || n_nationkey || '.java' AS file, 'Area' || n_regionkey AS simple, 'geo.r' || n_regionkey || '.Area' || n_regionkey AS full_name, n_nationkey % 4 + 1 AS tier FROM nation")
def type_resolution(spark, sf):
    d = code.java(spark, sf)
    uses = d.where(F.col("file").startswith("nat/")).select("file", F.regexp_extract("text", "implements (\\w+)", 1).alias("simple"))
    return structure.resolve_types(uses, structure.java_types(d), d)


@query("SELECT 'nat/Nation' || n_nationkey || '.java' AS from_file, 'geo/Area' || n_regionkey || '.java' AS to_file, 'import' AS kind, 'inferred' AS confidence FROM nation WHERE n_nationkey % 4 IN (0, 2)")
def jvm_imports(spark, sf):
    return resolve.jvm_imports(code.java(spark, sf))


@query("""SELECT 'nat/Nation' || n_nationkey || '.java' AS from_file, 'geo/Area' || n_regionkey || '.java' AS to_file, 'implements' AS kind, 'resolved' AS confidence FROM nation
UNION ALL SELECT 'nat/Nation' || a.n_nationkey || '.java', 'nat/Nation' || b.n_nationkey || '.java', 'call', CASE WHEN (SELECT count(*) FROM nation c WHERE c.n_regionkey = a.n_regionkey) = 1 THEN 'resolved' ELSE 'inferred' END FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def receiver_calls(spark, sf):
    """A call on an interface's field goes to all that implement it."""
    return resolve.java_edges(code.java(spark, sf)).select("from_file", "to_file", "kind", "confidence")


@query(f"WITH r(k, rule) AS (VALUES {RULES}), l(rule, level, title) AS (VALUES {LEVELS}) SELECT rule, level, title, 'src/p' || p_partkey || '.ts' AS file, 1 AS line_no FROM part JOIN r ON p_partkey % {len(code.LINES)} = k JOIN l USING (rule)")
def risk_rules(spark, sf):
    """All eleven rules, on lines that they fit and near misses."""
    return extract.rule_hits(lines.file_lines(code.risky(spark, sf)))


@query(f"""WITH {code.PATHS_SQL} SELECT file, CASE WHEN ext = 'pkg' THEN 'database' WHEN ext IN ('tsx', 'less') THEN 'frontend' WHEN ext = 'ts' AND c_nationkey % 5 IN (0, 3) THEN 'frontend' ELSE 'backend' END AS layer, count(*) AS n FROM pa GROUP BY 1, 2""")
def file_layers(spark, sf):
    d = code.paths(spark, sf)
    return d.groupBy("file", scalars.file_layer(F.col("file"), F.col("ext")).alias("layer")).agg(F.count("*").alias("n"))


@query(f"WITH {code.PATHS_SQL} SELECT c_custkey, CASE said WHEN 'main' THEN 'main' ELSE 'item' || c_custkey END || CASE WHEN e = 'component.ts' AND said = 'main' THEN '.' WHEN e = 'component.ts' THEN lower(CASE said WHEN 'Service' THEN 'service.' WHEN 'Page' THEN 'page.' WHEN '-repository' THEN ' repository.' ELSE 'dto.' END) WHEN said = '-repository' THEN '' ELSE '' END AS label FROM pa")
def responsibility_labels(spark, sf):
    return code.paths(spark, sf).select("c_custkey", scalars.responsibility(F.col("file")).alias("label"))


@query(f"WITH {code.PATHS_SQL} SELECT DISTINCT file, CASE WHEN ext = 'tsx' THEN 'react' ELSE 'angular' END AS type FROM pa WHERE (ext = 'tsx' OR e = 'component.ts') AND c_custkey % 2 = 1 AND file NOT IN (SELECT file FROM pa WHERE c_custkey % 2 = 0) AND file NOT LIKE '%/main.tsx'")
def dead_components(spark, sf):
    d = code.paths(spark, sf)
    even = d.where("c_custkey % 2 = 0").select(F.lit("x").alias("from_file"), F.col("file").alias("to_file"))
    return codegraph.dead_components(d.select("file").distinct(), even)


@query(f"WITH {code.PATHS_SQL} SELECT a.file AS from_file, b.file AS to_file, t.type, t.severity FROM pa a JOIN pa b ON a.c_custkey + 1 = b.c_custkey JOIN (VALUES ('src/pages', 'api/controllers', 'frontend_imports_server', 'high'), ('src/pages', 'api/repositories', 'frontend_imports_server', 'high'), ('api/controllers', 'api/repositories', 'direct_db_from_controller', 'medium')) AS t(x, y, type, severity) ON a.folder = x AND b.folder = y GROUP BY ALL")
def path_violations(spark, sf):
    d = code.paths(spark, sf).select("file", "c_custkey")
    e = d.select(F.col("file").alias("from_file"), (F.col("c_custkey") + 1).alias("c_custkey")).join(d.select(F.col("file").alias("to_file"), "c_custkey"), "c_custkey")
    return codegraph.path_violations(e)


@query(f"WITH {code.PATHS_SQL} SELECT l.language, count(*) AS n FROM pa JOIN (VALUES ('ts', 'TypeScript'), ('tsx', 'TypeScript'), ('java', 'Java'), ('pkg', 'PL/SQL')) AS l(ext, language) USING (ext) GROUP BY 1")
def languages(spark, sf):
    return repo.languages(code.paths(spark, sf))


# -- Levels and reports ------------------------------------------------------------------


@query(f"WITH {PAIRS}, c AS (SELECT file, CASE WHEN module = 'r0' THEN 'file:' || file WHEN layer = 'L0' THEN 'module:' || module ELSE 'layer:' || layer END AS c FROM md) SELECT a.c AS a, b.c AS b, count(*) AS weight, count(*) AS resolved FROM t JOIN c a ON a.file = from_file JOIN c b ON b.file = to_file WHERE a.c <> b.c GROUP BY 1, 2")
def graph_level_expanded(spark, sf):
    return codegraph.graph_level(_pairs(spark, sf), _modules(spark, sf), ["L0"], ["r0"])


@query(f"WITH {PAIRS}, c AS (SELECT file, CASE WHEN module = 'r0' THEN 'file:' || file WHEN layer = 'L0' THEN 'module:' || module ELSE 'layer:' || layer END AS c FROM md) SELECT a.c AS a, b.c AS b, count(*) AS weight, 'import' AS via FROM t JOIN c a ON a.file = from_file JOIN c b ON b.file = to_file WHERE a.c <> b.c GROUP BY 1, 2")
def unified_level_expanded(spark, sf):
    e = _pairs(spark, sf).select(F.concat(F.lit("file:"), "from_file").alias("from_id"), F.concat(F.lit("file:"), "to_file").alias("to_id"), F.lit("import").alias("via"))
    return codegraph.unified_level(e, _modules(spark, sf), ["L0"], ["r0"])


@query(f"WITH {DEG}, o AS (SELECT file, in_degree + out_degree AS degree, row_number() OVER (ORDER BY in_degree + out_degree DESC, file) AS r FROM md JOIN dg ON id = file WHERE module = 'r1') SELECT 'file:' || file AS id, CAST(degree AS BIGINT) AS degree, 1::BIGINT AS files FROM o WHERE r <= 3 UNION ALL SELECT 'more:r1', CAST(sum(degree) AS BIGINT), count(*) FROM o WHERE r > 3 HAVING count(*) > 0")
def module_children(spark, sf):
    return codegraph.children_of(_modules(spark, sf), _pairs(spark, sf), "r1", 3)


@query(f"WITH {PAIRS}, m AS (SELECT module, count(*) AS n FROM md GROUP BY 1 ORDER BY n DESC, module LIMIT 3), o AS (SELECT file, module FROM md JOIN m USING (module)) SELECT a.module AS a, b.module AS b, count(*) AS weight FROM t JOIN o a ON a.file = from_file JOIN o b ON b.file = to_file WHERE a.module <> b.module GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 5")
def module_fluxes(spark, sf):
    return codegraph.module_fluxes(_pairs(spark, sf), _modules(spark, sf).select("file", "module"), 3, 5)


@query(f"WITH {PAIRS}, p AS (SELECT DISTINCT a.module AS a, b.module AS b, from_file < to_file AS code FROM t JOIN md a ON a.file = from_file JOIN md b ON b.file = to_file WHERE a.module <> b.module) SELECT a, b, 'import' AS via FROM p WHERE code UNION ALL SELECT a, b, 'http' FROM p x WHERE NOT code AND NOT EXISTS (SELECT 1 FROM p y WHERE y.code AND y.a = x.a AND y.b = x.b)")
def module_diagram(spark, sf):
    e = _pairs(spark, sf)
    return codegraph.module_pairs(e.where("from_file < to_file"), e.where("from_file > to_file"), _modules(spark, sf).select("file", "module"))


@query(f"WITH {DEG} SELECT id, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree + out_degree AS BIGINT) AS degree FROM dg WHERE in_degree > 0 ORDER BY in_degree DESC, id LIMIT 20")
def central_files(spark, sf):
    return codegraph.central_files(facts.nation_trade(spark, sf))


@query(f"WITH {DEG}, r AS (SELECT id, layer, CAST(out_degree AS BIGINT) AS out_degree, CAST(row_number() OVER (PARTITION BY layer ORDER BY out_degree DESC, id) AS INTEGER) AS position FROM dg JOIN md ON file = id) SELECT * FROM r WHERE position <= 4")
def top_by_layer(spark, sf):
    d = codegraph.degrees(facts.nation_trade(spark, sf)).join(_modules(spark, sf).select(F.col("file").alias("id"), "layer"), "id").select("id", "layer", "out_degree")
    return codegraph.top_by_layer(d, 4)


@query(f"""WITH {PAIRS}, e AS (SELECT 'file:' || from_file AS from_id, 'file:' || to_file AS to_id, 'import' AS via, a.module AS ma, b.module AS mb FROM t JOIN md a ON a.file = from_file JOIN md b ON b.file = to_file WHERE a.module <> b.module),
k AS (SELECT ma, mb FROM e GROUP BY 1, 2 HAVING count(*) = 1), j AS (SELECT from_id, to_id, via, 'cross-module' AS reason, 1 AS o FROM e JOIN k USING (ma, mb) UNION ALL SELECT 'file:n' || n_nationkey, 'table:R' || n_regionkey, 'reads', 'cross-tier', 0 FROM nation WHERE n_nationkey < 4)
SELECT from_id, to_id, via, reason FROM j ORDER BY o, from_id, to_id LIMIT 15""")
def surprising_edges(spark, sf):
    """Jumps over a tier, and edges that are alone between their modules."""
    e = _pairs(spark, sf).select(F.concat(F.lit("file:"), "from_file").alias("from_id"), F.concat(F.lit("file:"), "to_file").alias("to_id"), F.lit("file").alias("from_kind"), F.lit("file").alias("to_kind"), F.lit("import").alias("via"))
    n = table(spark, sf, "nation").where("n_nationkey < 4")
    far = n.select(F.concat(F.lit("file:n"), F.col("n_nationkey").cast("string")).alias("from_id"), F.concat(F.lit("table:R"), F.col("n_regionkey").cast("string")).alias("to_id"), F.lit("file").alias("from_kind"), F.lit("table").alias("to_kind"), F.lit("reads").alias("via"))
    return codegraph.surprising(e.unionByName(far), _modules(spark, sf).select("file", "module"))


@query("SELECT 'nation' AS artifact, n_name AS label FROM nation WHERE lower(n_name) LIKE '%a%' UNION ALL SELECT 'region', r_name FROM region WHERE lower(r_name) LIKE '%a%' UNION ALL SELECT DISTINCT 'part', p_name FROM part WHERE lower(p_name) LIKE '%a%'")
def concept_map(spark, sf):
    return codegraph.concept_map("A", {"nation": (table(spark, sf, "nation"), "n_name"), "region": (table(spark, sf, "region"), "r_name"), "part": (table(spark, sf, "part"), "p_name")})


@query("SELECT 'region:' || r_regionkey AS id, 'root' AS role, count(n_nationkey) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'nation:' || n_nationkey, CASE WHEN count(k) = 0 THEN 'leaf' ELSE 'middle' END, count(k) FROM nation LEFT JOIN (SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier) ON n = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 'customer:' || c_custkey, 'leaf', 0 FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'leaf', 0 FROM supplier")
def inheritance_families(spark, sf):
    return codegraph.inheritance_families(facts.upper_edges(spark, sf))


# -- Metrics ---------------------------------------------------------------------------


@query(f"WITH {PARTS} SELECT CAST(sum(debt) AS BIGINT) AS debt, count(*) FILTER (WHERE hotspot) AS hotspots, count(*) FILTER (WHERE complexity > 10 OR cognitive > 15 OR complexity % 7 > 4) AS offenders FROM pd")
def project_totals(spark, sf):
    p = metrics.file_metrics(facts.parts(spark, sf))
    return metrics.project_totals(p, p.select(F.col("complexity").alias("cyclomatic"), "cognitive", (F.col("complexity") % 7).alias("max_nesting")))


@query(f"WITH {PARTS} SELECT file, CASE WHEN coupling_in > 50 OR lines > 1000 THEN 'critical' WHEN coupling_in > 20 OR lines > 500 THEN 'high' WHEN coupling_in > 10 OR lines > 300 THEN 'medium' WHEN coupling_in > 4 THEN 'low' ELSE 'clean' END AS label FROM pf")
def risk_labels(spark, sf):
    return facts.parts(spark, sf).select("file", scalars.risk_label(F.col("coupling_in"), F.col("lines")).alias("label"))


@query(f"WITH {PARTS}, h AS (SELECT file, debt, floor(debt * 0.5::DOUBLE * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS hours FROM pd WHERE debt > 0) SELECT *, CAST(floor(hours * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS cost FROM h ORDER BY debt DESC, file LIMIT 40")
def roi_files(spark, sf):
    return metrics.roi_files(metrics.file_metrics(facts.parts(spark, sf)))


@query("SELECT floor(sum(l_quantity) * 5.0::DOUBLE / 60 * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS hours_saved FROM lineitem")
def saved_hours(spark, sf):
    return metrics.saved_hours(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("impacted")))


@query("SELECT role AS tool, count(*) AS calls, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, CAST(floor(avg(ceil(length(text) / 4.0)) + 0.5::DOUBLE) AS BIGINT) AS average, CAST(max(ceil(length(text) / 4.0)) AS BIGINT) AS most FROM conversations GROUP BY 1")
def token_statistics(spark, sf):
    return metrics.token_statistics(table(spark, sf, "conversations").select(F.col("role").alias("tool"), scalars.token_estimate(F.col("text")).alias("tokens")))


@query("SELECT source AS module, count(*) AS files, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, CAST(ceil(sum(n_chars) / 4.0) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def module_descriptors(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("module"), F.col("lang").alias("language"), F.col("n_chars").alias("size_bytes"))
    return metrics.module_descriptors(d).withColumn("languages", F.array_join("languages", ","))


@query("WITH d AS (SELECT ts::DATE AS ts, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 20), e AS (SELECT min(score) AS lo, max(score) AS hi FROM d) SELECT ts, score, CASE WHEN hi > lo THEN floor((score - lo) / (hi - lo) * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE ELSE 0.5::DOUBLE END AS level FROM d, e")
def score_trend(spark, sf):
    return metrics.trend(_daily(spark, sf))


@query("SELECT p_type AS type, p_brand AS brand, count(*) AS n FROM part GROUP BY ALL")
def counts_by_type(spark, sf):
    return metrics.counts_by(table(spark, sf, "part").select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")), "type", "brand")


@query("SELECT 'd' || doc_id AS file, coalesce(quality, 0) AS commits, coalesce(toxic, 0) AS fixes FROM documents LEFT JOIN labels USING (doc_id)")
def churn_of_files(spark, sf):
    name = F.format_string("d%d", "doc_id").alias("file")
    return metrics.churn_of_files(table(spark, sf, "documents").select(name), table(spark, sf, "labels").select(name, F.col("quality").alias("commits"), F.col("toxic").alias("fixes")))


@query(f"WITH {SHARES}, t AS (SELECT module, count(*) AS authors, max(touches) AS most FROM sh GROUP BY 1) SELECT module, authors AS bus_factor, most AS share, CAST(row_number() OVER (ORDER BY authors, most DESC, module) AS INTEGER) AS position FROM t")
def knowledge_order(spark, sf):
    from pyspark.sql import Window

    d = facts.shares(spark, sf).groupBy("module").agg(F.count("*").alias("bus_factor"), F.max("touches").alias("share"))
    return metrics.knowledge_order(d).withColumn("position", F.row_number().over(Window.orderBy("bus_factor", F.desc("share"), "module")))


@query("SELECT 'u' || user_id AS file, count(*) AS commits, count(*) FILTER (WHERE event_type = 'error') AS fixes FROM events GROUP BY 1")
def fix_churn(spark, sf):
    subject = F.when(F.col("event_type") == "error", "a hotfix, now").otherwise("prefixed debugger")
    d = table(spark, sf, "events").select(F.format_string("u%d", "user_id").alias("file"), F.col("event_id").cast("string").alias("sha"), "ts", subject.alias("subject"))
    return repo.fix_churn(d).select("file", "commits", "fixes")


# -- Reviews, memory, scalars --------------------------------------------------------------


@query("SELECT 'd' || doc_id AS file, CAST(n_chars % 100 AS BIGINT) AS score FROM documents WHERE n_chars % 100 >= 50 AND doc_id IN (SELECT doc_id FROM labels)")
def risk_flags(spark, sf):
    name = F.format_string("d%d", "doc_id").alias("file")
    return review.risk_flags(table(spark, sf, "labels").select(name), table(spark, sf, "documents").select(name, (F.col("n_chars") % 100).alias("score")))


@query("SELECT 'file:d' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def others_affected(spark, sf):
    name = F.format_string("d%d", "doc_id")
    return review.others_affected(table(spark, sf, "documents").select(F.concat(F.lit("file:"), name).alias("id")), table(spark, sf, "labels").select(name.alias("file")))


@query("SELECT count(DISTINCT l_suppkey) AS files, count(*) AS affected, count(DISTINCT l_partkey) AS distinct_affected FROM lineitem")
def review_totals(spark, sf):
    return review.review_totals(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("id")))


@query("SELECT d.id, d.decision, 'src/' || p_name || '.ts' AS file FROM part, (VALUES ('a', 'no Red Widget here'), ('b', 'keep the small ring')) AS d(id, decision) WHERE contains(lower(d.decision), lower(p_name))")
def reopened_decisions(spark, sf):
    return review.reopened(table(spark, sf, "part").select(F.concat(F.lit("src/"), "p_name", F.lit(".ts")).alias("file")), [("a", "no Red Widget here"), ("b", "keep the small ring")])


@query("WITH c AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'click') AS k FROM events) SELECT 'new-high-risks' AS gate, e > 0 AS failed, e AS found FROM c UNION ALL SELECT 'new-violations', k > 0, k FROM c UNION ALL SELECT 'new-rule-violations', false, 0 FROM c UNION ALL SELECT 'health-drop:5', true, 1 FROM c")
def review_gates(spark, sf):
    e = table(spark, sf, "events")
    return review.review_gates(e.where("event_type = 'error'").select(F.lit("high").alias("level")), e.where("event_type = 'click'"), e.select(F.lit("warn").alias("severity")), -5.5, "new-high-risks, new-violations,new-rule-violations,health-drop:5,unknown")


@query("SELECT 'd' || doc_id AS file, 'k' || lang AS title, CASE toxic WHEN 1 THEN 'high' ELSE 'low' END AS level FROM documents JOIN labels USING (doc_id) WHERE NOT (toxic = 0 AND doc_id % 2 = 0)")
def new_risks(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.format_string("d%d", "doc_id").alias("file"), F.concat(F.lit("k"), "lang").alias("title"), F.when(F.col("toxic") == 1, "high").otherwise("low").alias("level"))
    return review.new_risks(d.drop("doc_id"), d.where("doc_id % 2 = 0").withColumn("level", F.lit("low")).drop("doc_id"))


@query("SELECT 'd' || d.doc_id AS file, CAST(n_chars % 100 AS BIGINT) AS score, CASE WHEN toxic = 1 THEN 'fixes' ELSE 'risk' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id) WHERE n_chars % 100 >= 60 AND (toxic = 1 OR d.doc_id % 3 = 0) AND d.doc_id % 5 <> 0")
def prediction_feedback(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.format_string("d%d", "doc_id").alias("file"), (F.col("n_chars") % 100).alias("score"))
    now = table(spark, sf, "labels").select(F.format_string("d%d", "doc_id").alias("file"), F.col("toxic").alias("fixes"))
    return review.feedback(d.select("file", "score", F.lit(0).alias("fixes")), now, d.where("doc_id % 3 = 0").select("file"), d.where("doc_id % 5 = 0").select("file"))


@query(f"WITH {PARTS}, d AS (SELECT file, unnest([CASE WHEN lines < 40 AND coupling_in >= 1 AND coupling_out = 1 THEN 'pass-through' END, CASE WHEN coupling_in + coupling_out > 20 THEN 'high-coupling' END, CASE WHEN lines > 1500 OR complexity > 50 THEN 'god-module' END]) AS reason FROM pf) SELECT file, reason FROM d WHERE reason IS NOT NULL UNION ALL SELECT file, 'circular' FROM pf WHERE module = 'Brand#1'")
def deepening_candidates(spark, sf):
    p = facts.parts(spark, sf)
    return review.deepening(p, p.where("module = 'Brand#1'").select("file"))


@query("SELECT event_id AS id FROM events WHERE contains('u' || user_id, 'u1') OR contains('u1', 'u' || user_id)")
def memory_recall(spark, sf):
    return govern.recall(facts.memory(spark, sf), "U1").select("id")


@query("SELECT event_id AS id FROM events WHERE user_id = 7 AND event_type = 'error'")
def memory_by_reference(spark, sf):
    link = F.array(F.struct(F.col("kind"), F.substring("entity", 2, 20).cast("int").alias("number")))
    return govern.by_reference(facts.memory(spark, sf).withColumn("links", link), "error", 7).select("id")


def _numbered(c: str) -> Column:
    return F.col(c).cast("string")


@query("SELECT c_custkey, left(regexp_replace(regexp_replace(c_name || '--' || c_mktsegment, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), 50) AS node_id, c_mktsegment || '/r' || c_custkey AS slug, greatest(0, 1000 - c_custkey) AS days, substr(sha1('/p/' || c_custkey), 1, 12) AS project, CAST(ceil(length(c_name) / 4.0) AS BIGINT) AS tokens FROM customer")
def scalar_functions(spark, sf):
    c, k = table(spark, sf, "customer"), _numbered("c_custkey")
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("git@host.example:"), "c_mktsegment", F.lit("/r"), k, F.lit(".git"))).otherwise(F.concat(F.lit("https://host.example/"), "c_mktsegment", F.lit("/r"), k))
    today = F.lit("2024-01-01").cast("date")
    day = F.date_sub(today, (1000 - F.col("c_custkey")).cast("int"))
    return c.select("c_custkey", scalars.sanitized(F.concat_ws("--", "c_name", "c_mktsegment")).alias("node_id"), scalars.repository_slug(url).alias("slug"), scalars.days_since(day, today).cast("long").alias("days"), scalars.project_id(F.concat(F.lit("/p/"), k)).alias("project"), scalars.token_estimate(F.col("c_name")).alias("tokens"))
