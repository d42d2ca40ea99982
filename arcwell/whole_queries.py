"""Queries over whole graphs: the impact index, circular dependencies, detected modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars
from .operators import communities, cycles, govern, metrics, rules, whole_impact
from .plans import facts
from .plans.session import table
from .queries import EDGES, TRADE, query
from .sources import modules, structure

# Three levels of belonging; orders are depended on by nothing.
LEVELS = f"""{EDGES},
one AS (SELECT to_id AS id, from_id AS x FROM edges GROUP BY ALL),
two AS (SELECT a.id, b.x FROM one a JOIN one b ON a.x = b.id),
three AS (SELECT a.id, b.x FROM two a JOIN one b ON a.x = b.id),
al AS (SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three),
ct AS (SELECT id, count(*) AS n FROM al GROUP BY id),
di AS (SELECT id, count(*) AS direct, array_to_string(list_slice(list_sort(list(x)), 1, 30), ',') AS direct_ids FROM one GROUP BY id)"""


@query(f"WITH {LEVELS} SELECT id, direct, CASE WHEN n <= 200 THEN n END AS transitive, n > 200 AS estimated, direct_ids FROM di JOIN ct USING (id)")
def impact_index(spark, sf):
    """Direct and transitive dependents of every node; what is estimated is a test's."""
    d = whole_impact.impact_index(facts.typed_edges(spark, sf), told_apart=True)
    return d.select("id", "direct", F.when(~F.col("estimated"), F.col("transitive")).alias("transitive"), "estimated", F.array_join("direct_ids", ",").alias("direct_ids"))


@query(f"""WITH RECURSIVE {TRADE}, r AS (SELECT to_id AS id, from_id AS x, 1 AS depth FROM trade UNION SELECT r.id, t.from_id, depth + 1 FROM r JOIN trade t ON r.x = t.to_id WHERE depth < 26),
m AS (SELECT id, x, min(depth) AS depth FROM r GROUP BY ALL)
SELECT id, count(*) FILTER (WHERE depth = 1) AS direct, count(*) AS transitive, string_agg(x, ',' ORDER BY depth, x) AS transitive_ids FROM m GROUP BY id""")
def impact_index_cyclic(spark, sf):
    """A graph of cycles: a node on one reaches itself."""
    d = whole_impact.impact_index(facts.nation_trade(spark, sf))
    return d.select("id", "direct", "transitive", F.array_join("transitive_ids", ",").alias("transitive_ids"))


@query(f"""WITH RECURSIVE {TRADE}, r AS (SELECT from_id AS a, to_id AS b FROM trade UNION SELECT r.a, t.to_id FROM r JOIN trade t ON r.b = t.from_id),
m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a), comp AS (SELECT a AS id, min(b) AS component FROM m GROUP BY a HAVING count(DISTINCT b) > 1),
e AS (SELECT from_id, to_id, p.component FROM trade JOIN comp p ON p.id = from_id JOIN comp q ON q.id = to_id WHERE p.component = q.component),
wk AS (SELECT component, component AS id, 0 AS depth FROM comp GROUP BY 1 UNION SELECT e.component, e.to_id, wk.depth + 1 FROM wk JOIN e ON e.component = wk.component AND e.from_id = wk.id WHERE wk.depth < 26),
d AS (SELECT component, id, min(depth) AS depth FROM wk GROUP BY ALL),
p AS (SELECT e.component, e.to_id AS id, min(e.from_id) AS parent FROM e JOIN d a ON a.id = e.from_id JOIN d b ON b.id = e.to_id AND b.depth = a.depth + 1 GROUP BY ALL),
c AS (SELECT e.component, min(d.depth) + 1 AS length FROM e JOIN d ON d.id = e.from_id WHERE e.to_id = e.component GROUP BY 1),
l AS (SELECT c.component, length, min(e.from_id) AS last FROM c JOIN e ON e.to_id = c.component AND e.component = c.component JOIN d ON d.id = e.from_id AND d.depth = length - 1 GROUP BY ALL),
walk AS (SELECT component, length, last AS from_id, component AS to_id FROM l UNION ALL SELECT walk.component, length, p.parent, walk.from_id FROM walk JOIN p ON p.id = walk.from_id AND p.component = walk.component WHERE walk.from_id <> walk.component)
SELECT 'circular_dependency' AS type, 'critical' AS severity, from_id, to_id, component, CAST(length AS INTEGER) AS length FROM walk""")
def circular_violations(spark, sf):
    return cycles.circular_violations(facts.nation_trade(spark, sf))


RULES = [
    rules.Rule("layers", "error", forbid={"fromLayer": "l0", "toLayer": "L1"}),
    rules.Rule("modules", "warn", forbid={"fromModule": "r1", "toModule": "r*"}),
    rules.Rule("paths", "error", forbid={"fromPath": "n1*", "toPath": "n?"}),
    rules.Rule("mixed", "warn", forbid={"fromLayer": "L1", "toPath": "n2*", "toModule": "r2"}),
    rules.Rule("one end", "info", forbid={"toPath": "n7"}),
]


@query(f"""WITH {TRADE}, f AS (SELECT 'n' || n_nationkey AS file, 'r' || n_regionkey AS module, 'L' || (n_regionkey % 2) AS layer FROM nation),
e AS (SELECT from_id AS from_file, to_id AS to_file, a.module AS am, a.layer AS al, b.module AS bm, b.layer AS bl FROM trade JOIN f a ON a.file = from_id JOIN f b ON b.file = to_id)
SELECT 'layers' AS rule, 'error' AS severity, from_file, to_file FROM e WHERE al = 'L0' AND bl = 'L1'
UNION ALL SELECT 'modules', 'warn', from_file, to_file FROM e WHERE am = 'r1' UNION ALL SELECT 'mixed', 'warn', from_file, to_file FROM e WHERE al = 'L1' AND to_file LIKE 'n2%' AND bm = 'r2'
UNION ALL SELECT 'one end', 'info', from_file, to_file FROM e WHERE to_file = 'n7'""")
def rule_table(spark, sf):
    """Rules by layer, module and path, alone and mixed; a ``?`` in a path is no pattern."""
    n = table(spark, sf, "nation")
    files = n.select(F.format_string("n%d", "n_nationkey").alias("file"), F.format_string("L%d", F.col("n_regionkey") % 2).alias("layer"), F.format_string("r%d", "n_regionkey").alias("module"))
    trade = facts.nation_trade(spark, sf).select(F.col("from_id").alias("from_file"), F.col("to_id").alias("to_file"))
    return rules.rule_violations(trade, files, RULES)


# Parts of a part's number by a hundred say its folder: what each folder is called then.
FOLDERS = [
    ("shop-backend/src/main/java/com/br/boats", "backend/boats"), ("shop-backend/src/main/java/com/br/crew", "backend/crew"), ("shop-backend/src/test/java/com/br/boats", "backend/boats"),
    ("shop-frontend/app", "frontend/app"), ("shop-frontend/lib/deep/er", "frontend/lib"), ("src/tools", "tools"), ("src/tools/more", "tools"), ("docs", "docs"), ("", "__root__"), ("lib/tools", "lib/tools"),
]


@query("SELECT p_partkey AS k, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(FOLDERS)) + " END AS module FROM part")
def detected_modules(spark, sf):
    """Sub-projects split where they branch, tests with what they test, like names told apart."""
    folder = F.get(F.array(*[F.lit(f) for f, _ in FOLDERS]), (F.col("p_partkey") % 10).cast("int"))
    d = table(spark, sf, "part").select(F.concat_ws("/", F.nullif(folder, F.lit("")), F.format_string("f%d.ts", "p_partkey")).alias("file"))
    found = modules.detect_modules(d, None)
    return found.select(F.regexp_extract("file", "f(\\d+)\\.ts$", 1).cast("long").alias("k"), "module")


# What a screen says, and the strings in it that name something; broken ones are read as they are.
SCREENS = [
    ('{"a": "Other1", "Key1": 1, "b": "lower", "c": "No"}', ["Other1"]), ('{"x": [{"y": {"z": ["Deep2", "Other3", {"w": "Deep2"}]}}, "Esc\\u0061ped", null, 1.5]}', ["Deep2", "Other3", "Escaped"]),
    ('["Top4", [["Nested5"]]]', ["Top4", "Nested5"]), ('{"a": "Broken6", "KeyOne": ', ["Broken6", "KeyOne"]), ('"Alone7"', ["Alone7"]), ("", []), ('{"e": {}, "f": [], "g": "Has space", "h": "Other8"}', ["Other8"]),
]
DEEP = ("[" * 14 + '"TooDeep"' + "]" * 14, [])


@query("SELECT k, value FROM (" + " UNION ALL ".join(f"SELECT s_suppkey AS k, '{v}' AS value FROM supplier WHERE s_suppkey % {len(SCREENS) + 1} = {i}" for i, (_, found) in enumerate(SCREENS) if i != 3 for v in [*found, *{0: ["lower", "No"], 6: ["Has space"]}.get(i, [])]) + ")")
def json_strings(spark, sf):
    """Strings at any depth of screens, without keys; broken JSON and what lies too deep have none."""
    texts = F.array(*[F.lit(t) for t, _ in [*SCREENS, DEEP]])
    d = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.get(texts, (F.col("s_suppkey") % (len(SCREENS) + 1)).cast("int")).alias("text"))
    return structure.json_strings(d).select(F.col("file").cast("long").alias("k"), "value")


@query("SELECT DISTINCT 's/kit' || s_suppkey || '.osw' AS from_id, 'x/' || value || '.ts' AS to_id, 'resolved' AS confidence FROM (" + " UNION ALL ".join(f"SELECT s_suppkey, '{v}' AS value FROM supplier WHERE s_suppkey % {len(SCREENS) + 1} = {i}" for i, (_, found) in enumerate(SCREENS) for v in found) + ")")
def screen_links_nested(spark, sf):
    """Screens to the files that strings in nested and in broken JSON name."""
    texts = F.array(*[F.lit(t) for t, _ in [*SCREENS, DEEP]])
    s = table(spark, sf, "supplier").select("s_suppkey", F.get(texts, (F.col("s_suppkey") % (len(SCREENS) + 1)).cast("int")).alias("text"))
    d = s.select(F.format_string("s/kit%d.osw", "s_suppkey").alias("file"), "text")
    names = s.select(F.explode(F.array(*[F.lit(v) for _, found in SCREENS for v in [*found, "TooDeep", "lower"]])).alias("v")).distinct()
    return structure.screen_links(d.unionByName(names.select(F.format_string("x/%s.ts", "v").alias("file"), F.lit("").alias("text"))))


HEALTH = """
hs AS (SELECT (SELECT count(*) FROM part)::DOUBLE AS files, (SELECT sum(p_size * 1000) FROM part)::DOUBLE AS lines, (SELECT sum(p_size * 30) FROM part)::DOUBLE AS debt, (SELECT count(*) FROM part WHERE p_size > 40)::DOUBLE AS coupled,
 (SELECT sum(CASE event_type WHEN 'error' THEN 4.0 WHEN 'purchase' THEN 2.0 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.1 ELSE 0 END::DOUBLE) FROM events) AS risks,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::DOUBLE AS violations, (SELECT count(*) FROM customer WHERE c_acctbal < 0)::DOUBLE AS dead, (SELECT count(*) FROM lineitem)::DOUBLE AS edges, (SELECT count(*) FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'N')::DOUBLE AS loose),
hd AS (SELECT unnest(['debt', 'risks', 'violations', 'deadCode', 'coupling', 'resolution']) AS dimension, unnest([debt / (lines / 1000), risks, violations, dead, coupled, 100 * loose / edges]) AS raw,
 unnest([debt / (lines / 1000) / 2, 2 * risks / (lines / 1000), 200 * violations / files, 100 * dead / files, 100 * coupled / files, 10 * loose / edges]) AS cost, unnest([25, 25, 15, 10, 15, 10]) AS most FROM hs),
hp AS (SELECT dimension, floor(least(cost, most) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE AS penalty, floor(raw * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS raw, most FROM hd),
ht AS (SELECT greatest(0.0::DOUBLE, floor((100 - sum(penalty)) * 10 + 0.5::DOUBLE) / 10.0::DOUBLE) AS score FROM hp)"""


@query(f"WITH {HEALTH} SELECT dimension, penalty, raw, most, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade FROM hp, ht")
def health_breakdown(spark, sf):
    """Each dimension with its raw value, risks by their levels' weights."""
    files = table(spark, sf, "part").select((F.col("p_size") * 1000).alias("lines"), (F.col("p_size") * 30).alias("debt"), F.col("p_size").alias("coupling_in"), F.lit(-20).alias("coupling_out"))
    level = F.element_at(F.create_map(*map(F.lit, ("error", "critical", "purchase", "high", "click", "medium", "view", "low"))), F.col("event_type"))
    risks = table(spark, sf, "events").select(level.alias("level"))
    edges = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "N", "resolved").otherwise("inferred").alias("confidence"))
    return metrics.health_report(files, risks, table(spark, sf, "orders").where("o_orderstatus = 'P'"), table(spark, sf, "customer").where("c_acctbal < 0"), edges)


@query("""WITH s AS (SELECT (SELECT floor(avg(s_acctbal)) % 100 FROM supplier) AS new, (SELECT floor(avg(c_acctbal)) % 100 FROM customer) AS old),
d AS (SELECT new, old, floor((new - old) * 10 + 0.5::DOUBLE) / 10 AS d FROM s)
SELECT CASE WHEN d < 0 THEN 'health-down' ELSE 'health-up' END AS type, CASE WHEN d <= -10 THEN 'critical' WHEN d < 0 THEN 'warn' ELSE 'info' END AS severity, NULL AS entity, printf('%.1f to %.1f', old, new) AS detail FROM d WHERE d <> 0
UNION ALL SELECT 'risk-new', CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'warn' ELSE 'info' END, 'file:d' || doc_id, CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'high' ELSE 'low' END || ' q' || quality FROM labels WHERE quality = 0
UNION ALL SELECT 'rule-violation', CASE WHEN n_nationkey % 2 = 0 THEN 'critical' ELSE 'warn' END, 'file:n' || n_nationkey, 'rule r' || n_regionkey FROM nation WHERE n_nationkey >= 10
UNION ALL SELECT DISTINCT 'module-added', 'info', NULL, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size % 50 > 1)
UNION ALL SELECT DISTINCT 'module-removed', 'info', NULL, 'old ' || r_name FROM region""")
def analysis_delta(spark, sf):
    """Two analyses: health, new risks, newly broken rules, modules that came and went."""
    score = lambda name, c: table(spark, sf, name).agg((F.floor(F.avg(c)) % 100).cast("double").alias("score"))
    level = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "high").otherwise("low")
    risks = table(spark, sf, "labels").select(F.format_string("d%d", "doc_id").alias("file"), F.format_string("q%d", "quality").alias("title"), level.alias("level"))
    n = table(spark, sf, "nation")
    broken = n.select("n_nationkey", F.lit("rule").alias("rule"), F.when(F.col("n_nationkey") % 2 == 0, "error").otherwise("warn").alias("severity"), F.format_string("n%d", "n_nationkey").alias("from_file"), F.format_string("r%d", "n_regionkey").alias("to_file"))
    p = table(spark, sf, "part").select("p_size", F.col("p_brand").alias("module"))
    gone = table(spark, sf, "region").select(F.concat(F.lit("old "), "r_name").alias("module"))
    return govern.analysis_delta(
        {"health": score("customer", "c_acctbal"), "risks": risks.where("title = 'q1'"), "violations": broken.where("n_nationkey < 10"), "modules": p.where("p_size % 50 > 1").select("module").union(gone)},
        {"health": score("supplier", "s_acctbal"), "risks": risks, "violations": broken, "modules": p.select("module")})


MEMBERS = f"""{EDGES}, me AS (SELECT 'customer:' || c_custkey AS id, c_mktsegment AS community FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'S' || s_nationkey % 3 FROM supplier UNION ALL SELECT 'order:' || o_orderkey, o_orderpriority FROM orders UNION ALL SELECT 'nation:' || n_nationkey, 'S0' FROM nation)"""


def _members(spark, sf):
    one = lambda name, kind, key, c: table(spark, sf, name).select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), c.alias("community"))
    nations = one("nation", "nation", "n_nationkey", F.lit("S0"))
    return one("customer", "customer", "c_custkey", F.col("c_mktsegment")).union(one("supplier", "supplier", "s_suppkey", F.format_string("S%d", F.col("s_nationkey") % 3))).union(one("orders", "order", "o_orderkey", F.col("o_orderpriority"))).union(nations)


@query(f"WITH {MEMBERS}, k AS (SELECT community, split_part(id, ':', 1) AS kind, count(*) AS n FROM me GROUP BY ALL) SELECT community, CAST(sum(n) AS BIGINT) AS size, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM k GROUP BY 1")
def community_composition(spark, sf):
    d = communities.composition(_members(spark, sf))
    return d.select("community", "size", F.array_join(F.transform(F.map_entries("kinds"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("kinds"))


@query(f"WITH {MEMBERS} SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS weight FROM edges JOIN me a ON a.id = from_id JOIN me b ON b.id = to_id WHERE a.community <> b.community GROUP BY ALL")
def community_coupling(spark, sf):
    return communities.coupling(facts.typed_edges(spark, sf), _members(spark, sf))


@query("SELECT 'suggestions' AS part, count(*) AS n FROM region UNION ALL SELECT 'predictions', count(*) FROM part UNION ALL SELECT 'out-of-scope', count(*) FROM nation UNION ALL SELECT 'triage', count(*) FROM orders UNION ALL SELECT 'ready-for-agent', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'needs-triage', count(*) FROM orders WHERE o_orderstatus = 'O'")
def skills_overview(spark, sf):
    state = F.element_at(F.create_map(*map(F.lit, ("F", "ready-for-agent", "O", "needs-triage", "P", "done"))), F.col("o_orderstatus"))
    return metrics.skills_overview(table(spark, sf, "region"), table(spark, sf, "part"), table(spark, sf, "nation"), table(spark, sf, "orders").select(state.alias("state")))


@query("WITH h AS (SELECT 'm' || s_suppkey AS module, CAST(abs(floor(s_acctbal)) AS BIGINT) % 60 AS hours FROM supplier) SELECT * FROM h WHERE hours <= 16 ORDER BY hours DESC, module LIMIT 5")
def start_here(spark, sf):
    """Modules of low difficulty, the longest to learn first."""
    hours = (F.abs(F.floor("s_acctbal")).cast("long") % 60).alias("hours")
    d = table(spark, sf, "supplier").select(F.format_string("m%d", "s_suppkey").alias("module"), hours)
    return metrics.start_here(d.withColumn("difficulty", scalars.difficulty(F.col("hours"))))
