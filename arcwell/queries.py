"""A query per operator over the driver's tables, and its SQL oracle.

Keys without SQL are iterative or heuristic; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import communities as clusters
from .operators import cycles, govern, graph, metrics, search, whole_impact
from .plans import facts
from .plans.session import table
from .sources import extract, lines
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EDGES = """
edges AS (
 SELECT 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, 'nation' AS from_kind, 'region' AS to_kind, 'belongs-to' AS via, 'resolved' AS confidence FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer', 'nation', 'belongs-to', 'resolved' FROM customer
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'supplier', 'nation', 'belongs-to', 'resolved' FROM supplier
 UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'order', 'customer', 'call', CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'inferred' END FROM orders
 UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'order', 'supplier', 'reads', 'resolved' FROM lineitem
 UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'order', 'part', 'reads', 'resolved' FROM lineitem)"""
STEPS = """
seen AS (SELECT user_id, lag(user_id) OVER (ORDER BY ts, event_id) AS before FROM events),
steps AS (SELECT 'u' || before AS from_id, 'u' || user_id AS to_id, count(*) AS weight FROM seen WHERE before IS NOT NULL AND before <> user_id GROUP BY ALL HAVING count(*) >= {least})"""
TRADE = """
w AS (SELECT s_nationkey, c_nationkey, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
trade AS (SELECT 'n' || s_nationkey AS from_id, 'n' || c_nationkey AS to_id, weight FROM (SELECT *, sum(weight) OVER (PARTITION BY s_nationkey) AS total FROM w) WHERE weight >= 0.05::DOUBLE * total AND s_nationkey <> c_nationkey)"""
REACH = """
reached AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT e.from_id, r.depth + 1 FROM edges e JOIN reached r ON e.to_id = r.id WHERE r.depth < 6),
hit AS (SELECT id, min(depth) AS depth, split_part(id, ':', 1) AS kind FROM reached WHERE depth > 0 GROUP BY id)"""
PARTS = """
pl AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS coupling_in, count(DISTINCT l_suppkey) AS coupling_out, CAST(sum(l_quantity) AS BIGINT) AS lines FROM lineitem GROUP BY 1),
pf AS (SELECT 'p' || p_partkey AS file, p_brand AS module, CAST(p_size AS BIGINT) AS complexity, CAST(p_size AS BIGINT) - 10 AS cognitive, lines, coupling_in, coupling_out FROM part JOIN pl ON p_partkey = l_partkey),
pd AS (SELECT *, CAST((CASE WHEN complexity > 20 THEN least(2 * (complexity - 20), 40) ELSE 0 END) + (CASE WHEN cognitive > 15 THEN least(cognitive - 15, 20) ELSE 0 END)
  + (CASE WHEN lines > 1500 THEN 10 WHEN lines > 500 THEN 3 ELSE 0 END) + (CASE WHEN coupling_out > 15 THEN least(coupling_out - 15, 15) ELSE 0 END) AS BIGINT) AS debt,
  complexity > 15 AND coupling_in > 3 AS hotspot FROM pf)"""
SHARES = """
sh AS (SELECT p_brand AS module, 's' || l_suppkey AS author, count(*) AS touches FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
USERS = """
us AS (SELECT 'u' || user_id AS file, count(*) AS commits, count(*) FILTER (WHERE event_type = 'error') AS fixes, count(DISTINCT event_type) AS complexity, count(DISTINCT ts::DATE) AS coupling FROM events GROUP BY 1)"""
LINES = """
ln AS (SELECT 'doc/' || doc_id AS file, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"""
TERMS = f"""
spl AS (SELECT 'doc/' || doc_id AS file, unnest(list_distinct(string_split_regex(lower(regexp_replace(regexp_replace(coalesce(text, ''), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z]+'))) AS term FROM documents),
po AS (SELECT * FROM spl WHERE length(term) >= 3 AND term NOT IN ({", ".join(repr(w) for w in [*search.STOP, *search.SQL_WORDS])}))"""
BM25 = """
sz AS (SELECT file, count(*) AS dl FROM po GROUP BY 1), w AS (SELECT count(*) AS docs, avg(dl) AS av FROM sz), q AS (SELECT unnest(['thre', 'ing', 'ero']) AS prefix), h AS (SELECT file, prefix, count(*) AS tf FROM po JOIN q ON starts_with(term, prefix) GROUP BY 1, 2), d AS (SELECT prefix, count(*) AS df FROM h GROUP BY 1),
i AS (SELECT prefix, CASE WHEN (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) > 1 THEN ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf FROM d, w),
x AS (SELECT h.file, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / av))) AS x FROM h JOIN i USING (prefix) JOIN sz USING (file), w GROUP BY 1),
bm AS (SELECT file, floor(x * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS score FROM x ORDER BY score DESC, file LIMIT 20)"""
MEMORY = """
mem AS (SELECT event_id AS id, ts, 'u' || user_id AS entity, event_type AS kind, coalesce(props, '') AS summary, CASE event_type WHEN 'purchase' THEN 'worked' WHEN 'error' THEN 'failed' ELSE 'none' END AS result FROM events)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def entry(spark: SparkSession) -> DataFrame:
    return impact_by_depth(spark, "/root/testdata/sf0.001")


# -- Graph ---------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT * FROM edges")
def edges_typed(spark, sf):
    return facts.typed_edges(spark, sf)


@query("SELECT 'o' || l_orderkey AS from_id, 's' || l_suppkey AS to_id, 'line' AS via, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'resolved' ELSE 'inferred' END AS confidence FROM lineitem GROUP BY 1, 2")
def edge_dedup_upgrade(spark, sf):
    e = table(spark, sf, "lineitem").select(F.format_string("o%d", "l_orderkey").alias("from_id"), F.format_string("s%d", "l_suppkey").alias("to_id"), F.lit("o").alias("from_kind"), F.lit("s").alias("to_kind"), F.lit("line").alias("via"), F.when(F.col("l_returnflag") == "R", "resolved").otherwise("inferred").alias("confidence"))
    return graph.union_edges(e).select("from_id", "to_id", "via", "confidence")


@query(f"WITH {EDGES}, p AS (SELECT DISTINCT from_id, to_id FROM edges), x AS (SELECT to_id AS id, 1 AS i, 0 AS o FROM p UNION ALL SELECT from_id, 0, 1 FROM p) SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM x GROUP BY id")
def node_degrees(spark, sf):
    return graph.degrees(facts.typed_edges(spark, sf))


@query(f"WITH {EDGES}, x AS (SELECT to_id AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT from_id, 0, 1 FROM edges) SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM x GROUP BY id ORDER BY degree DESC, in_degree DESC, id LIMIT 15")
def god_nodes(spark, sf):
    return graph.god_nodes(facts.typed_edges(spark, sf))


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT depth, count(*) AS n FROM hit GROUP BY depth")
def impact_by_depth(spark, sf):
    return graph.impact(facts.typed_edges(spark, sf), "region:0", 6, 1 << 40).groupBy("depth").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT kind, count(*) AS n, max(depth) AS deepest FROM hit GROUP BY kind")
def impact_by_kind(spark, sf):
    return graph.impact(facts.typed_edges(spark, sf), "region:0", 6, 1 << 40).groupBy("kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query(f"WITH RECURSIVE {EDGES}, {REACH}, d AS (SELECT to_id AS id, count(DISTINCT from_id) AS dependents FROM edges GROUP BY 1) SELECT h.id, h.kind, h.depth, coalesce(d.dependents, 0) AS dependents FROM hit h LEFT JOIN d USING (id) ORDER BY dependents DESC, depth, id LIMIT 20")
def blast_radius(spark, sf):
    return graph.blast_radius(facts.typed_edges(spark, sf), "region:0")


@query(f"""WITH {EDGES}, one AS (SELECT from_id AS id, max(CASE confidence WHEN 'resolved' THEN 1 ELSE 0 END) AS sure FROM edges WHERE to_id = 'nation:3' GROUP BY 1),
two AS (SELECT e.from_id AS id, max(least(sure, CASE e.confidence WHEN 'resolved' THEN 1 ELSE 0 END)) AS sure FROM edges e JOIN one ON e.to_id = one.id WHERE e.from_id NOT IN (SELECT id FROM one) GROUP BY 1)
SELECT id, depth, CASE sure WHEN 1 THEN 'resolved' ELSE 'inferred' END AS confidence FROM (SELECT id, 1 AS depth, sure FROM one UNION ALL SELECT id, 2, sure FROM two)""")
def impact_two_hop_confidence(spark, sf):
    return graph.impact(facts.typed_edges(spark, sf), "nation:3", 2, 1 << 40).select("id", "depth", "confidence")


@query(f"WITH RECURSIVE {STEPS.format(least=3)}, r AS (SELECT min(to_id) AS id, 0 AS depth FROM steps UNION SELECT s.from_id, r.depth + 1 FROM steps s JOIN r ON s.to_id = r.id WHERE r.depth < 12), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id), c AS (SELECT depth, sum(count(*)) OVER (ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM m GROUP BY depth) SELECT id, depth FROM m JOIN c USING (depth) WHERE depth > 0 AND known < 20")
def file_impact_capped(spark, sf):
    """No level is begun once 20 nodes are known (the contract's 200, for a graph this small)."""
    e = facts.user_steps(spark, sf, 3)
    return graph.reach(e, e.agg(F.min("to_id").alias("id")), 12, max_nodes=20).where("depth > 0").select("id", "depth")


@query(f"WITH RECURSIVE {STEPS.format(least=3)}, r AS (SELECT min(from_id) AS id, 0 AS depth FROM steps UNION SELECT s.to_id, r.depth + 1 FROM steps s JOIN r ON s.from_id = r.id WHERE r.depth < 8) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def shortest_path_length(spark, sf):
    e = facts.user_steps(spark, sf, 3)
    return graph.reach(e, e.agg(F.min("from_id").alias("id")), 8, reverse=False).select("id", "depth")


@query("WITH p AS (SELECT 'nation:' || n_nationkey AS n, row_number() OVER (ORDER BY 'nation:' || n_nationkey) AS r FROM nation WHERE n_regionkey = 2) SELECT CAST(r AS INTEGER) AS route, 'all>' || n || '>region:2' AS nodes, 3 AS length FROM p WHERE r <= 3")
def k_routes_diamond(spark, sf):
    """The first three of all routes from one node through every nation to a region."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("of"))
    e = n.select(F.lit("all").alias("from_id"), F.col("id").alias("to_id")).unionByName(n.select(F.col("id").alias("from_id"), F.col("of").alias("to_id"))).withColumns({"via": F.lit("call"), "confidence": F.lit("resolved")})
    found = graph.routes(e, "all", "region:2", 3)
    return spark.createDataFrame([(i + 1, ">".join(n for n, _, _ in p), len(p)) for i, p in enumerate(found)], "route int, nodes string, length int")


@query(f"WITH {EDGES}, m AS (SELECT DISTINCT id, split_part(id, ':', 1) AS layer FROM (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges)) SELECT a.layer AS a, b.layer AS b, count(*) AS weight, CAST(sum(CASE confidence WHEN 'resolved' THEN 1 ELSE 0 END) AS BIGINT) AS resolved FROM edges JOIN m a ON a.id = from_id JOIN m b ON b.id = to_id WHERE a.layer <> b.layer GROUP BY 1, 2")
def graph_level_layer(spark, sf):
    return graph.matrix(facts.typed_edges(spark, sf), F.col("from_kind"), F.col("to_kind"))


@query("SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS weight, count(*) AS resolved FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2")
def graph_level_module(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = d.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.matrix(d.withColumn("confidence", F.lit("resolved")), F.col("s_nationkey"), F.col("c_nationkey"))


@query(f"WITH {EDGES}, n AS (SELECT from_kind AS a, to_kind AS b, via, count(*) AS n FROM edges GROUP BY ALL), s AS (SELECT *, (CASE via WHEN 'call' THEN 3 WHEN 'reads' THEN 2 ELSE 1 END) + 0.01 * n AS score FROM n) SELECT a, b, CAST(sum(n) AS BIGINT) AS weight, arg_max(via, score) AS via FROM s GROUP BY a, b")
def unified_level_dominant_via(spark, sf):
    return graph.dominant_via(facts.typed_edges(spark, sf), F.col("from_kind"), F.col("to_kind"), {"call": 3, "reads": 2, "belongs-to": 1})


@query(f"WITH {STEPS.format(least=1)} SELECT a.from_id, a.to_id FROM steps a JOIN steps b ON a.from_id = b.to_id AND a.to_id = b.from_id WHERE a.from_id < a.to_id")
def two_cycles(spark, sf):
    return graph.two_cycles(facts.user_steps(spark, sf, 1))


@query(f"WITH RECURSIVE {TRADE}, r AS (SELECT from_id AS a, to_id AS b FROM trade UNION SELECT r.a, t.to_id FROM r JOIN trade t ON r.b = t.from_id), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT a AS id, min(b) AS component FROM m GROUP BY a HAVING count(DISTINCT b) > 1")
def scc_pairs(spark, sf):
    return graph.strong_components(facts.nation_trade(spark, sf))


@query(f"WITH RECURSIVE {STEPS.format(least=4)}, both_ AS (SELECT from_id AS a, to_id AS b FROM steps UNION SELECT to_id, from_id FROM steps), r AS (SELECT a, a AS b FROM both_ UNION SELECT r.a, e.b FROM r JOIN both_ e ON r.b = e.a) SELECT a AS id, min(b) AS component FROM r GROUP BY a")
def components(spark, sf):
    return graph.components(facts.user_steps(spark, sf, 4))


@query()
def communities_louvain(spark, sf):
    return clusters.communities(facts.nation_trade(spark, sf))


@query(f"""WITH {TRADE}, n AS (SELECT 'n' || n_nationkey AS id, n_regionkey AS cluster FROM nation), e AS (SELECT least(a.cluster, b.cluster) AS a, greatest(a.cluster, b.cluster) AS b, count(*) AS weight FROM trade JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id GROUP BY 1, 2)
SELECT e.a, e.b, e.weight FROM e LEFT JOIN e x ON x.a = e.a AND x.b = e.a LEFT JOIN e y ON y.a = e.b AND y.b = e.b WHERE e.a <> e.b AND e.weight >= 0.5 * greatest(1, least(coalesce(x.weight, 0), coalesce(y.weight, 0))) ORDER BY weight DESC, a, b LIMIT 20""")
def cross_cluster_coupling(spark, sf):
    return graph.cross_cluster(facts.nation_trade(spark, sf), table(spark, sf, "nation").select(F.format_string("n%d", "n_nationkey").alias("id"), F.col("n_regionkey").alias("cluster")))


@query("SELECT 'u' || user_id AS a, event_type AS b, ts::DATE AS day FROM events GROUP BY 1, 2, 3 HAVING count(*) = 1")
def surprising_links(spark, sf):
    return table(spark, sf, "events").groupBy(F.format_string("u%d", "user_id").alias("a"), F.col("event_type").alias("b"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"""WITH {TRADE}, n AS (SELECT 'n' || n_nationkey AS id, n_regionkey AS cluster FROM nation), e AS (SELECT from_id, to_id FROM trade UNION ALL SELECT from_id, to_id FROM trade WHERE weight % 2 = 0), d AS (SELECT id, count(from_id) AS i FROM (SELECT to_id AS id, from_id FROM e UNION ALL SELECT from_id, NULL FROM e) GROUP BY 1),
ch AS (SELECT 'n' || c_nationkey AS id, count(*) AS churn FROM customer GROUP BY 1),
x AS (SELECT t.from_id AS id, b.cluster AS o FROM trade t JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id WHERE a.cluster <> b.cluster UNION ALL SELECT t.to_id, a.cluster FROM trade t JOIN n a ON a.id = from_id JOIN n b ON b.id = to_id WHERE a.cluster <> b.cluster),
br AS (SELECT id, count(DISTINCT o) AS bridges FROM x GROUP BY 1), j AS (SELECT d.id, d.i AS in_degree, coalesce(churn, 0) AS churn, coalesce(bridges, 0) AS bridges FROM d LEFT JOIN ch USING (id) LEFT JOIN br USING (id)),
m AS (SELECT greatest(max(in_degree), 1)::DOUBLE AS mi, greatest(max(churn), 1)::DOUBLE AS mc, greatest(max(bridges), 1)::DOUBLE AS mb FROM j)
SELECT id, in_degree, churn, bridges, CAST(floor(100 * (0.4::DOUBLE * in_degree / mi + 0.3::DOUBLE * churn / mc + 0.3::DOUBLE * bridges / mb) + 0.5::DOUBLE) AS BIGINT) AS score FROM j, m WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def criticality(spark, sf):
    ch = table(spark, sf, "customer").groupBy(F.format_string("n%d", "c_nationkey").alias("id")).agg(F.count("*").alias("churn"))
    trade = facts.nation_trade(spark, sf)
    more = trade.where("weight % 2 = 0").withColumn("via", F.lit("more"))  # parallel edges
    return graph.criticality(trade.unionByName(more), ch, table(spark, sf, "nation").select(F.format_string("n%d", "n_nationkey").alias("id"), F.col("n_regionkey").alias("cluster")))


@query(f"WITH {EDGES} SELECT from_id, to_id, CASE from_kind WHEN 'order' THEN 'high' ELSE 'medium' END AS severity, min(via) AS via FROM edges WHERE (from_kind = 'order' AND to_kind = 'part') OR (from_kind = 'supplier' AND to_kind = 'nation') GROUP BY ALL")
def layer_violations(spark, sf):
    return graph.layer_violations(facts.typed_edges(spark, sf), F.col("from_kind"), F.col("to_kind"), [("order", "part", "high"), ("supplier", "nation", "medium")])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def dead_nodes(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(f"WITH {EDGES} SELECT DISTINCT from_id AS id, from_kind AS kind FROM edges WHERE from_id NOT IN (SELECT to_id FROM edges)")
def entry_points(spark, sf):
    e = facts.typed_edges(spark, sf)
    return e.select(F.col("from_id").alias("id"), F.col("from_kind").alias("kind")).distinct().join(e.select(F.col("to_id").alias("id")).distinct(), "id", "left_anti")


@query(f"WITH {EDGES} SELECT 'nation:7' AS id, count(*) FILTER (WHERE to_id = 'nation:7') AS callers, count(*) FILTER (WHERE from_id = 'nation:7') AS callees, string_agg(to_id, ',') FILTER (WHERE from_id = 'nation:7') AS uses FROM edges WHERE 'nation:7' IN (from_id, to_id)")
def node_profile(spark, sf):
    e = facts.upper_edges(spark, sf).where("from_id = 'nation:7' OR to_id = 'nation:7'")
    mine = F.col("from_id") == "nation:7"
    return e.agg(F.count_if(~mine).alias("callers"), F.count_if(mine).alias("callees"), F.array_join(F.slice(F.array_sort(F.collect_set(F.when(mine, F.col("to_id")))), 1, 20), ",").alias("uses")).select(F.lit("nation:7").alias("id"), "callers", "callees", "uses")


@query("SELECT 'region:' || r_regionkey AS id, 0 AS depth FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier")
def inheritance_depth(spark, sf):
    return graph.inheritance_depth(facts.upper_edges(spark, sf))


# -- Commits, files, modules ------------------------------------------------------


@query("""WITH t AS (SELECT 'u' || user_id AS file, event_type AS author, ts::DATE AS day, CAST(floor(coalesce(value, 0)) AS BIGINT) AS added FROM events), b AS (SELECT file, author, count(*) AS n, sum(added) AS added, min(day) AS f, max(day) AS l FROM t GROUP BY 1, 2)
SELECT file, CAST(sum(n) AS BIGINT) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(n) AS BIGINT) AS deleted, min(f) AS first_day, max(l) AS last_day, count(*) AS authors, (array_agg(author ORDER BY n DESC, author))[1] AS main_author, CAST(floor(100.0::DOUBLE * max(n) / sum(n) + 0.5::DOUBLE) AS BIGINT) AS main_share FROM b GROUP BY file""")
def churn_by_file(spark, sf):
    return metrics.churn(facts.touches(spark, sf))


@query("""WITH b AS (SELECT DISTINCT user_id AS basket, event_type || '/' || CAST(CAST(extract(isodow FROM ts) AS INTEGER) AS VARCHAR) AS item FROM events), s AS (SELECT basket FROM b GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40),
k AS (SELECT * FROM b JOIN s USING (basket)), p AS (SELECT x.item AS a, y.item AS b, count(*) AS together FROM k x JOIN k y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT item, count(*) AS k FROM b GROUP BY 1),
o AS (SELECT p.a, p.b, together, floor(together / least(x.k, y.k)::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS degree FROM p JOIN c x ON x.item = p.a JOIN c y ON y.item = p.b) SELECT * FROM o WHERE degree >= 0.3 ORDER BY degree DESC, together DESC, a, b LIMIT 200""")
def change_coupling(spark, sf):
    item = F.concat("event_type", F.lit("/"), (F.weekday("ts") + 1).cast("string"))
    return metrics.change_coupling(table(spark, sf, "events").select(F.col("user_id").alias("basket"), item.alias("item")))


BUS = f"WITH {SHARES}, r AS (SELECT *, coalesce(sum(touches) OVER (PARTITION BY module ORDER BY touches DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(touches) OVER (PARTITION BY module) AS total FROM sh) SELECT module, CAST(sum(CASE WHEN 2 * before {{op}} total THEN 1 ELSE 0 END) AS BIGINT) AS bus_factor, count(*) AS authors FROM r GROUP BY module"


@query(BUS.format(op="<="))
def bus_factor_strict(spark, sf):
    return metrics.bus_factor(facts.shares(spark, sf), True)


@query(BUS.format(op="<"))
def bus_factor_inclusive(spark, sf):
    return metrics.bus_factor(facts.shares(spark, sf), False)


@query(f"""WITH {SHARES}, r AS (SELECT *, coalesce(sum(touches) OVER (PARTITION BY module ORDER BY touches DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(touches) OVER (PARTITION BY module) AS total FROM sh), b AS (SELECT module, CAST(sum(CASE WHEN 2 * before < total THEN 1 ELSE 0 END) AS BIGINT) AS bus_factor, count(*) AS authors FROM r GROUP BY module),
t AS (SELECT module, (array_agg(author ORDER BY touches DESC, author))[1] AS owner, max(touches) AS most, sum(touches) AS total FROM sh GROUP BY 1), m AS (SELECT p_brand AS module, count(*) AS files, avg(p_size) AS complexity FROM part GROUP BY 1),
h AS (SELECT t.module, owner, CAST(floor(100.0::DOUBLE * most / total + 0.5::DOUBLE) AS BIGINT) AS share, authors, bus_factor, CAST(floor((files * 0.3::DOUBLE + complexity * 1.5::DOUBLE) * (CASE WHEN bus_factor <= 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) + 0.5::DOUBLE) AS BIGINT) AS hours FROM t JOIN b USING (module) JOIN m USING (module))
SELECT *, CASE WHEN hours > 40 THEN 'high' WHEN hours > 16 THEN 'medium' ELSE 'low' END AS difficulty FROM h""")
def ownership_modules(spark, sf):
    m = table(spark, sf, "part").groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("files"), F.avg("p_size").alias("complexity"))
    return metrics.ownership(facts.shares(spark, sf), m)


@query(f"""WITH {PARTS}, a AS (SELECT 'p' || l_partkey AS file, count(DISTINCT l_returnflag) AS authors, min(l_returnflag) AS main_author FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 40 GROUP BY 1) SELECT file, main_author, CAST(coupling_in + debt AS BIGINT) AS weight FROM a JOIN pd USING (file) WHERE authors = 1 AND coupling_in + debt >= 8""")
def knowledge_risk(spark, sf):
    a = table(spark, sf, "lineitem").where("l_linestatus = 'F' AND l_quantity > 40").groupBy(F.format_string("p%d", "l_partkey").alias("file")).agg(F.count_distinct("l_returnflag").alias("authors"), F.min("l_returnflag").alias("main_author"))
    return metrics.knowledge_risk(a, metrics.file_metrics(facts.parts(spark, sf)))


@query("SELECT 'c' || o_custkey AS owner, count(*) AS files FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def suggest_reviewers(spark, sf):
    o = table(spark, sf, "orders")
    changed = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("file"))
    return govern.reviewers(changed, o.select(F.col("o_orderkey").alias("file"), F.format_string("c%d", "o_custkey").alias("owner")))


@query(f"WITH {USERS}, m AS (SELECT greatest(max(commits),1)::DOUBLE a, greatest(max(fixes),1)::DOUBLE b, greatest(max(complexity),1)::DOUBLE c, greatest(max(coupling),1)::DOUBLE d FROM us) SELECT us.*, CAST(floor(100 * (0.4::DOUBLE * commits / a + 0.2::DOUBLE * fixes / b + 0.2::DOUBLE * complexity / c + 0.2::DOUBLE * coupling / d) + 0.5::DOUBLE) AS BIGINT) AS score FROM us, m WHERE score > 0 ORDER BY score DESC, file LIMIT 50")
def risk_prediction(spark, sf):
    return metrics.risk_prediction(facts.users(spark, sf))


@query(f"WITH {USERS}, m AS (SELECT greatest(max(commits),1)::DOUBLE a, greatest(max(complexity),1)::DOUBLE c FROM us) SELECT file, commits, complexity, CAST(floor(100 * commits / a * complexity / c + 0.5::DOUBLE) AS BIGINT) AS score FROM us, m WHERE score > 0")
def behavioural_hotspots(spark, sf):
    return metrics.hotspots(facts.users(spark, sf))


@query(f"WITH {PARTS} SELECT file, debt, hotspot FROM pd")
def debt_score(spark, sf):
    return metrics.file_metrics(facts.parts(spark, sf)).select("file", "debt", "hotspot")


@query(f"""WITH {PARTS}, hs AS (SELECT module, string_agg(file, ',' ORDER BY file) AS hotspots FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY file) AS r FROM pd WHERE hotspot) WHERE r <= 5 GROUP BY module),
m AS (SELECT module, count(*) AS files, CAST(floor(avg(complexity) + 0.5::DOUBLE) AS BIGINT) AS avg_complexity, max(complexity) AS max_complexity, (array_agg(file ORDER BY complexity DESC, file))[1] AS worst_file, CAST(floor(avg(cognitive) + 0.5::DOUBLE) AS BIGINT) AS avg_cognitive, CAST(0 AS BIGINT) AS max_nesting, CAST(sum(lines) AS BIGINT) AS lines,
 floor(avg(coupling_in) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS avg_coupling_in, CAST(sum(debt) AS BIGINT) AS debt FROM pd GROUP BY module) SELECT m.*, coalesce(hotspots, '') AS hotspots FROM m LEFT JOIN hs USING (module)""")
def module_metrics(spark, sf):
    d = metrics.module_metrics(metrics.file_metrics(facts.parts(spark, sf)))
    return d.withColumn("hotspots", F.array_join("hotspots", ","))


ROI = f"WITH {PARTS}, m AS (SELECT module, CAST(sum(debt) AS BIGINT) AS debt FROM pd GROUP BY 1 HAVING sum(debt) > 0), h AS (SELECT *, floor(debt * 0.5::DOUBLE * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS hours FROM m) SELECT *, floor(hours / 8 * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS days, CAST(floor(hours * {{rate}}::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS cost FROM h"


@query(ROI.format(rate=100))
def roi(spark, sf):
    return metrics.roi(metrics.module_metrics(metrics.file_metrics(facts.parts(spark, sf))))


@query(ROI.format(rate=180))
def roi_rescale(spark, sf):
    return metrics.rescale(roi(spark, sf).drop("cost"), 180.0)


@query("""WITH s AS (SELECT (SELECT count(*) FROM part WHERE p_size > 45)::DOUBLE AS debt, (SELECT count(*) FROM events WHERE event_type = 'error')::DOUBLE AS risks, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::DOUBLE AS violations, (SELECT count(*) FROM customer WHERE c_acctbal < 0)::DOUBLE AS dead, (SELECT count(*) FROM part WHERE p_size > 40)::DOUBLE AS coupled, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N')::DOUBLE AS unresolved, (SELECT count(*) FROM lineitem)::DOUBLE AS edges, (SELECT count(*) FROM lineitem)::DOUBLE AS lines, (SELECT count(*) FROM orders)::DOUBLE AS files),
p AS (SELECT floor(least(debt / (lines / 1000) / 2, 25) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS p_debt, floor(least(2 * risks / (lines / 1000), 25) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS p_risks, floor(least(200 * violations / files, 15) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS p_violations, floor(least(100 * dead / files, 10) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS p_dead, floor(least(100 * coupled / files, 15) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS p_coupling, floor(least(100 * unresolved / edges / 10, 10) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS p_resolution FROM s),
q AS (SELECT *, greatest(0.0::DOUBLE, floor((100 - (p_debt + p_risks + p_violations + p_dead + p_coupling + p_resolution)) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE) AS score FROM p) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade FROM q""")
def health_score(spark, sf):
    def counts(name: str, **where: str) -> DataFrame:
        return table(spark, sf, name).agg(*[F.count_if(F.expr(w)).cast("double").alias(alias) for alias, w in where.items()])

    s = counts("part", debt="p_size > 45", coupled="p_size > 40")
    for d in (counts("events", risks="event_type = 'error'"), counts("orders", violations="o_orderstatus = 'P'", files="true"), counts("customer", dead="c_acctbal < 0"), counts("lineitem", unresolved="l_returnflag = 'N'", edges="true", lines="true")):
        s = s.crossJoin(d)  # one row each
    return metrics.health(s)


# -- Lines and extractors --------------------------------------------------------------



def _rule_sql(rule: str, all_of: list[str], none_of: list[str]) -> str:
    quoted = lambda p: p.replace("'", "''")
    hit = " AND ".join(f"regexp_matches(text, '{quoted(p)}')" for p in all_of)
    if rule == "weak-crypto":  # no comment mark before the first of two words, or before the last character
        return hit + r" AND NOT contains(CASE WHEN regexp_matches(text, '\b(MD5|SHA1)') THEN regexp_extract(text, '^(.*?)\b(?:MD5|SHA1)', 1) ELSE left(text, length(text) - 1) END, '//')"
    return hit + "".join(f" AND NOT regexp_matches(text, '{quoted(p)}')" for p in none_of)


HITS = " UNION ALL ".join(f"SELECT '{i}' AS rule, '{level}' AS level, '{title}' AS title, file, line_no FROM ln WHERE {_rule_sql(i, a, n)}" for i, level, title, a, n in extract.RISKS)


@query(f"WITH {LINES}, h AS ({HITS}) SELECT rule, level, title, file, CAST(min(line_no) AS INTEGER) AS line_no FROM h GROUP BY 1, 2, 3, 4")
def risk_rules_docs(spark, sf):
    return extract.rule_hits(lines.file_lines(facts.doc_files(spark, sf)), extensions=None)


@query(f"WITH {LINES} SELECT file, CAST(line_no AS INTEGER) AS line_no, CAST(length(string_agg(text, ' ') OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING)) AS INTEGER) AS n FROM ln")
def line_context(spark, sf):
    d = lines.file_lines(facts.doc_files(spark, sf))
    return d.withColumn("n", F.length(lines.context(2, 4))).select("file", "line_no", "n")


@query(f"""WITH {LINES}, m AS (SELECT file, line_no, text, CASE WHEN length(text) >= 40 THEN line_no END AS good FROM ln)
SELECT file, CAST(line_no AS INTEGER) AS line_no, CAST((min(good) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)) AS INTEGER) AS next_line FROM m""")
def next_meaningful_line(spark, sf):
    d = lines.file_lines(facts.doc_files(spark, sf)).withColumn("long_text", F.col("text")).withColumn("text", F.col("line_no"))
    return d.withColumn("next_line", lines.next_meaningful(F.length("long_text") >= 40, 7)).select("file", "line_no", "next_line")


@query(f"""WITH {LINES}, m AS (SELECT file, line_no, CASE WHEN contains(text, 'the') THEN line_no END AS mark FROM ln) SELECT file, CAST(line_no AS INTEGER) AS line_no, CAST(max(mark) OVER (PARTITION BY file ORDER BY line_no) AS INTEGER) AS marker FROM m""")
def last_marker(spark, sf):
    d = lines.file_lines(facts.doc_files(spark, sf))
    return d.withColumn("marker", lines.last_marker(F.when(F.contains("text", F.lit("the")), F.col("line_no")))).select("file", "line_no", "marker")


@query("""SELECT e.event_id, min(p.ts) AS next_ts FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts WHERE e.event_type = 'error' GROUP BY 1""")
def nearest_following(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(1, Window.unboundedFollowing)
    e = table(spark, sf, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("micros").rangeBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)
    return e.withColumn("next_ts", nxt).where("event_type = 'error' AND next_ts IS NOT NULL").select("event_id", "next_ts")


@query("""SELECT file, href, count(*) AS n FROM (SELECT 'page/' || page_id AS file, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def url_extract(spark, sf):
    p = facts.page_files(spark, sf)
    return p.select("file", F.explode(F.regexp_extract_all("text", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("file", "href").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT 'page/' || page_id AS file, regexp_replace(url, '^https?://[^/]+', '') AS url, string_split(trim(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^https?://[^/]+', ''), '/'), '/') AS s FROM pages)
SELECT file, url, '/' || s[1] || '/:id' AS route FROM c WHERE len(s) = 2 AND s[1] IN ('en', 'fr', 'de', 'es')""")
def url_match(spark, sf):
    calls = facts.page_files(spark, sf).select("file", F.lit(1).alias("line_no"), F.lit("GET").alias("method"), F.regexp_replace("url", "^https?://[^/]+", "").alias("url"))
    routes = spark.createDataFrame([(f"/{x}/:id", "routes.ts") for x in ("en", "fr", "de", "es")], "route string, file string")
    return extract.match_calls(calls, routes).select("file", "url", "route")


@query("""WITH c AS (SELECT DISTINCT '/' || string_split(regexp_replace(url, '^https?://[^/]+/', ''), '/')[1] || '/{id}' AS path FROM pages) SELECT path, 'GET,POST' AS methods, 'id' AS params FROM c""")
def openapi_paths(spark, sf):
    lang = F.get(F.split(F.regexp_replace("url", "^https?://[^/]+/", ""), "/"), F.lit(0))
    e = table(spark, sf, "pages").select(F.concat(F.lit("/"), lang, F.lit("/:id")).alias("route"), F.explode(F.array(F.lit("GET"), F.lit("POST"))).alias("method"))
    return extract.openapi_paths(e)


@query("SELECT 'page/' || page_id AS file, count(*) AS n FROM pages JOIN documents ON 'src' || (page_id % 20) = source WHERE page_id NOT IN (SELECT page_id FROM pages WHERE url LIKE '%/en/%') GROUP BY 1")
def name_fallback_match(spark, sf):
    p = table(spark, sf, "pages")
    rest = p.join(p.where("url LIKE '%/en/%'").select("page_id"), "page_id", "left_anti").select("page_id", F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("source"))
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rest.join(n, "source").select(F.format_string("page/%d", "page_id").alias("file"), "n")


# -- Search -------------------------------------------------------------------------------


@query(f"WITH {TERMS} SELECT term, count(*) AS df FROM po GROUP BY term")
def postings(spark, sf):
    return search.terms(facts.doc_files(spark, sf)).groupBy("term").agg(F.count("*").alias("df"))


def _terms(spark, sf):
    return facts.doc_files(spark, sf).select("file", search.term_array(F.col("text")).alias("terms"))


@query(f"WITH {TERMS}, {BM25} SELECT * FROM bm")
def bm25_prefix(spark, sf):
    return search.bm25(_terms(spark, sf), ["thre", "ing", "ero"])


@query(f"WITH {TERMS} SELECT file, CAST(sum((CASE WHEN term = 'than' THEN 2 WHEN starts_with(term, 'than') THEN 1 ELSE 0 END) + (CASE WHEN term = 'her' THEN 2 WHEN starts_with(term, 'her') THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM po GROUP BY file HAVING score > 0 ORDER BY score DESC, file LIMIT 20")
def inverted_score(spark, sf):
    return search.inverted_score(search.terms(facts.doc_files(spark, sf)), ["than", "her"])


VEC = "v AS (SELECT 'doc/' || vec_id AS file, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings), s AS (SELECT v.file, floor(list_cosine_similarity(v.e, q.e) * 1000 + 0.5::DOUBLE) / 1000.0::DOUBLE AS score FROM v, v q WHERE q.file = 'doc/0')"


def _vectors(spark, sf, n):
    t = table(spark, sf, "embeddings")
    v = t.select(F.format_string("doc/%d", "vec_id").alias("file"), F.col("embedding").alias("vec"))
    return search.vector_top(v, t.where("vec_id = 0").first()["embedding"], n)


@query(f"WITH {VEC} SELECT * FROM s ORDER BY score DESC, file LIMIT 20")
def cosine_topk(spark, sf):
    return _vectors(spark, sf, 20)


@query(f"""WITH {VEC}, {TERMS}, {BM25}, b AS (SELECT file, row_number() OVER (ORDER BY score DESC, file) AS r FROM (SELECT * FROM s ORDER BY score DESC, file LIMIT 20)), a AS (SELECT file, row_number() OVER (ORDER BY score DESC, file) AS r FROM bm)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.r IS NULL THEN 'vec' WHEN b.r IS NULL THEN 'fts' ELSE 'both' END AS origin, floor((coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0)) * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE AS score FROM a FULL JOIN b ON a.file = b.file ORDER BY score DESC, file LIMIT 10""")
def rrf_fusion(spark, sf):
    """Text search of the documents and vector search of the same ids."""
    return search.fuse(search.bm25(_terms(spark, sf), ["thre", "ing", "ero"], 20), _vectors(spark, sf, 20))


@query("SELECT n_name AS name, CASE WHEN lower(n_name) = 'united' THEN 100.0::DOUBLE WHEN starts_with(lower(n_name), 'united') THEN 80.0::DOUBLE WHEN contains(lower(n_name), 'united') THEN 60.0::DOUBLE ELSE 40.0::DOUBLE * (CASE WHEN contains(lower(n_name), 'united') THEN 1 ELSE 0 END) END AS score FROM nation")
def module_match_score(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name"), scalars.name_score(F.col("n_name"), "united").alias("score"))


# -- Governance, deltas, streams -------------------------------------------------------------

HALVES = "k AS (SELECT DISTINCT 'u' || user_id || ':' || event_type AS item, ts < TIMESTAMP '2024-01-04' AS early FROM events)"


def _halves(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.format_string("u%d", "user_id"), F.lit(":"), "event_type").alias("item"), (F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")).alias("early")).distinct()
    return e.where("early").select("item"), e.where("NOT early").select("item")


@query(f"WITH {HALVES} SELECT item FROM k WHERE NOT early AND item NOT IN (SELECT item FROM k WHERE early)")
def new_vs_base(spark, sf):
    base, head = _halves(spark, sf)
    return govern.new_rows(head, base, ["item"])


@query(f"WITH {HALVES} SELECT item, 'added' AS change FROM k WHERE NOT early AND item NOT IN (SELECT item FROM k WHERE early) UNION ALL SELECT item, 'removed' FROM k WHERE early AND item NOT IN (SELECT item FROM k WHERE NOT early)")
def set_delta(spark, sf):
    base, head = _halves(spark, sf)
    return govern.set_delta(head, base)


DAILY = "d AS (SELECT ts::DATE AS ts, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY 1), l AS (SELECT ts, score, score - lag(score) OVER (ORDER BY ts) AS delta FROM d)"


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("ts")).agg(F.count("*").cast("double").alias("score"))


@query(f"WITH {DAILY} SELECT * FROM l")
def snapshot_lag(spark, sf):
    return govern.snapshot_deltas(_daily(spark, sf))


@query(f"WITH {DAILY} SELECT ts, CASE WHEN delta < 0 THEN 'health-down' ELSE 'health-up' END AS type, CASE WHEN delta <= -10 THEN 'critical' WHEN delta < 0 THEN 'warn' ELSE 'info' END AS severity, abs(delta) AS magnitude FROM l WHERE delta <> 0")
def self_delta(spark, sf):
    return govern.self_delta(_daily(spark, sf))


@query("WITH c AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS e, count(*) AS n FROM events) SELECT 'errors' AS gate, e > 100 AS failed FROM c UNION ALL SELECT 'share', e > 0.5 * n FROM c")
def gates(spark, sf):
    one = table(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("n"))
    return govern.gates(one, {"errors": F.col("e") > 100, "share": F.col("e") > 0.5 * F.col("n")})


@query(f"WITH {EDGES} SELECT DISTINCT 'no-order-part' AS rule, 'error' AS severity, from_id, to_id FROM edges WHERE from_id LIKE 'order:%' AND to_id LIKE 'part:1%' UNION SELECT DISTINCT 'no-supplier', 'warn', from_id, to_id FROM edges WHERE to_id LIKE 'supplier:%'")
def arch_rules(spark, sf):
    return govern.arch_rules(facts.typed_edges(spark, sf), [("no-order-part", "error", "order:*", "part:1*"), ("no-supplier", "warn", "**", "supplier:*")])


STATES = "needs-triage needs-info ready-for-agent ready-for-human wontfix done".split()


@query(f"""WITH s AS (SELECT unnest(range(0, 6)) AS k, unnest({STATES}) AS name), pairs AS (SELECT a.name AS state, b.name AS wanted FROM s a, s b),
r AS (SELECT l.l_orderkey * 100 + l.l_linenumber AS id, a.name AS state, b.name AS wanted FROM lineitem l JOIN s a ON a.k = l.l_orderkey % 6 JOIN s b ON b.k = l.l_partkey % 6)
SELECT id, state, wanted, coalesce((state = 'needs-triage' AND wanted IN ('needs-info', 'ready-for-agent', 'ready-for-human', 'wontfix')) OR (state IN ('needs-info', 'wontfix') AND wanted = 'needs-triage') OR (state IN ('ready-for-agent', 'ready-for-human') AND wanted IN ('needs-triage', 'done')), false) AS allowed FROM r""")
def triage_transitions(spark, sf):
    """Every pair of states."""
    state = lambda c: F.get(F.array(*map(F.lit, STATES)), (F.col(c) % 6).cast("int"))
    return govern.triage_moves(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), state("l_orderkey").alias("state"), state("l_partkey").alias("wanted")))


@query("SELECT doc_id AS id, 'done' AS state FROM labels UNION ALL SELECT DISTINCT doc_id, 'needs-triage' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def triage_sync(spark, sf):
    return govern.triage_sync(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("done").alias("state")), table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query(f"WITH {MEMORY} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY entity, kind, substr(lower(summary), 1, 80) ORDER BY ts DESC, id DESC) AS r FROM mem) WHERE r = 1")
def memory_dedup(spark, sf):
    return govern.memory_latest(facts.memory(spark, sf)).select("id")


@query(f"WITH {MEMORY} SELECT entity FROM mem GROUP BY 1 HAVING bool_or(result = 'worked') AND bool_or(result = 'failed')")
def memory_contradictions(spark, sf):
    return govern.contradictions(facts.memory(spark, sf))


@query(f"WITH {MEMORY} SELECT strftime(ts, '%G-W%V') AS week, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS r FROM mem) WHERE r > 1000 GROUP BY 1")
def memory_archive_week(spark, sf):
    return govern.archive_weeks(facts.memory(spark, sf), 1000)


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, ts::DATE AS day, 'u' || user_id || ':' || event_type AS key, (user_id + event_id) % 3 AS f, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS turn FROM events),
w AS (SELECT id, day, turn, CASE WHEN f >= 2 THEN 'blocked' ELSE 'dispatched' END AS decision, CASE WHEN f >= 2 THEN []::VARCHAR[] ELSE [key] END AS sent FROM e WHERE turn = 1
 UNION ALL SELECT e.id, e.day, e.turn, d.decision, CASE d.decision WHEN 'dispatched' THEN list_append(w.sent, e.key) ELSE w.sent END FROM w JOIN e ON e.day = w.day AND e.turn = w.turn + 1,
 LATERAL (SELECT CASE WHEN list_contains(w.sent, e.key) THEN 'duplicate' WHEN len(w.sent) >= 5 THEN 'capped' WHEN e.f >= 2 THEN 'blocked' ELSE 'dispatched' END AS decision) d)
SELECT id, day, decision FROM w""")
def dispatch_decision(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.format_string("u%d", "user_id").alias("entity"), F.col("event_type").alias("trigger"), ((F.col("user_id") + F.col("event_id")) % 3).alias("failed_before"))
    return govern.dispatch(e)


@query("WITH o AS (SELECT ts, CASE WHEN ts >= lag(ts) OVER (ORDER BY ts) + INTERVAL 15 MINUTE OR lag(ts) OVER (ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT ts, sum(n) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT min(ts) AS \"begin\", max(ts) + INTERVAL 15 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY g")
def debounce_sessions(spark, sf):
    return live.debounce(table(spark, sf, "events").select("ts"), "15 minutes")


@query("SELECT event_id FROM events WHERE (event_type = 'error' AND value >= 10) OR (event_type IN ('purchase', 'click') AND user_id % 2 = 0) OR event_type = 'view'")
def alert_filter(spark, sf):
    kinds = {"error": "health-down", "purchase": "risk-new", "click": "rule-violation", "view": "ci-failure"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("other"))
    e = table(spark, sf, "events").select("event_id", kind.alias("type"), F.when(F.col("user_id") % 2 == 0, "critical").otherwise("warn").alias("severity"), F.col("value").alias("magnitude"))
    return live.alerts(e).select("event_id")


@query("SELECT date_trunc('hour', ts) AS \"begin\", event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return live.windowed_counts(table(spark, sf, "events").select("ts", F.col("event_type").alias("type")))


@query("SELECT 's' || s_suppkey AS project, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS health, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN s_acctbal >= 0 THEN s_acctbal END, 101.0), 's' || s_suppkey) AS INTEGER) AS position FROM supplier")
def portfolio_rank(spark, sf):
    return govern.portfolio(table(spark, sf, "supplier").select(F.format_string("s%d", "s_suppkey").alias("project"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("health")))


@query("SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, ts::DATE)")
def rollup_levels(spark, sf):
    return table(spark, sf, "events").rollup("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query()
def approx_authors(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("authors"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def intersect_users(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


def queries() -> dict[str, Query]:
    from . import code_queries, text_queries, whole_queries  # noqa: F401  (register themselves)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
