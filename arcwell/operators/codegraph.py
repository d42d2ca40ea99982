"""The graph of a code base, built from extracted facts, and what is asked of it.

Facts come from ``sources``; ids are ``file:``, ``method:``, ``plsql:``, ``table:`` and
``column:``. Every edge says that its start depends on its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import file_layer, spoken
from ..plans.session import checkpoint
from ..sources.extract import match_by_name, match_calls
from .graph import EDGE, degrees, matrix, reach, union_edges

# Folders by which a file belongs to a layer (fixed values).
FRONTEND_PATH = "(?i)/(components?|pages?|views?|screens?|ui|hooks?|contexts?)/"
SERVER_PATH = "(?i)/(controllers?|services?|repositories?|dao|persistence|database|db|server)/"
DB_PATH = "(?i)/(repositories?|dao|persistence|database|db)/"
CONTROLLER_PATH = "(?i)/(controllers?|handlers?|routes?)/"
# Relations of an aggregated pair by importance; others have 0 (fixed values).
VIA_PRIORITY = {"trigger": 6, "writes": 5, "reads": 4, "db-call": 3, "calls": 2, "import": 1, "depends": 0}
# Distance of a kind of node from the front end (fixed values).
TIER = {"file": 0, "method": 0, "plsql": 1, "table": 2, "column": 2}
# Files that are never imported and yet alive (fixed values).
ENTRY_FILES = ("main.tsx", "main.ts", "App.tsx", "App.ts", "index.tsx", "index.ts", "index.js")


def _edges(d: DataFrame, a: Column, b: Column, via: Column | str, sure: Column | str) -> DataFrame:
    """EDGE rows of a projection."""
    via, sure = (F.lit(x) if isinstance(x, str) else x for x in (via, sure))
    kind = lambda c: F.substring_index(c, ":", 1)
    out = d.select(a.alias("from_id"), b.alias("to_id"), via.alias("via"), sure.alias("confidence")).where("from_id IS NOT NULL AND to_id IS NOT NULL")
    return out.select("from_id", "to_id", kind(F.col("from_id")).alias("from_kind"), kind(F.col("to_id")).alias("to_kind"), "via", "confidence").select(*EDGE)


def routine_id(name: Column, package: Column) -> Column:
    return F.concat(F.lit("plsql:"), F.when(package.isNotNull(), F.concat(F.upper(package), F.lit("."))).otherwise(""), F.upper(name))


def resolve_routines(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """``refs`` (routine, package, ...) with ``id`` and ``sure``: the declared object that a
    name or its synonym means. One of that name is meant; of several, the qualified one or
    else the first; a name that nothing declares keeps an id of its own."""
    is_synonym = F.lower("type") == "synonym"
    synonyms = objects.where(is_synonym & F.col("synonym_for").isNotNull()).groupBy(F.upper("name").alias("_said")).agg(F.max_by(F.upper(F.substring_index("synonym_for", ".", -1)), F.struct("file", "line_no")).alias("_means"))
    known = objects.where(~is_synonym).select(F.upper("name").alias("_simple"), routine_id(F.col("name"), F.col("package")).alias("_id"), F.struct("file", "line_no").alias("_at"))
    known = known.groupBy("_simple", "_id").agg(F.min("_at").alias("_at"))
    by_name = known.groupBy("_simple").agg(F.count("*").alias("_n"), F.min_by("_id", "_at").alias("_first"))
    d = refs.withColumn("_said", F.upper("routine")).join(synonyms, "_said", "left").withColumn("_simple", F.coalesce("_means", "_said"))
    d = d.withColumn("_own", routine_id(F.col("_simple"), F.col("package")))
    d = d.join(by_name, "_simple", "left").join(known.select(F.col("_id").alias("_own"), F.lit(True).alias("_declared")), "_own", "left")
    n, named = F.coalesce("_n", F.lit(0)), F.col("package").isNotNull()
    found = F.when(named & F.col("_declared"), F.col("_own")).when(named & (n != 1), F.col("_own")).otherwise(F.coalesce("_first", "_own"))
    sure = F.when(named, F.coalesce("_declared", F.lit(False))).otherwise(n == 1)
    return d.withColumn("id", found).withColumn("sure", F.when(sure, "resolved").otherwise("inferred")).select(*refs.columns, "id", "sure")


def http_edges(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(from_file, to_file, confidence, label): calls with the endpoint of their URL; files
    none of whose calls has one, with that of their domain word (inferred)."""
    met = match_calls(calls, endpoints).join(calls.select("file", "line_no", "url", "confidence").distinct(), ["file", "line_no", "url"])
    label = F.concat_ws(" ", F.upper(F.coalesce("method", F.lit("ANY"))), "url")
    by_url = met.groupBy(F.col("file").alias("from_file"), "to_file").agg(F.min_by(F.struct("confidence", label.alias("label")), F.struct("line_no", "url")).alias("m")).select("from_file", "to_file", "m.confidence", "m.label")
    rest = calls.select("file").distinct().join(by_url.select(F.col("from_file").alias("file")), "file", "left_anti")
    by_name = match_by_name(rest, endpoints).select(F.col("file").alias("from_file"), "to_file", F.lit("inferred").alias("confidence"), F.lit(None).cast("string").alias("label"))
    return by_url.unionByName(by_name)


def build_impact_graph(
    files: DataFrame | None = None, methods: DataFrame | None = None, http: DataFrame | None = None, db_calls: DataFrame | None = None, objects: DataFrame | None = None,
    routine_calls: DataFrame | None = None, tables: DataFrame | None = None, columns: DataFrame | None = None,
) -> DataFrame:
    """The eight families of typed edges as one table, without self-loops and repeats:
    files (from_file, to_file, kind, confidence), methods (from_file, from_type,
    from_method, to_file, to_method, confidence), http (from_file, to_file, confidence),
    db_calls (file, routine, package, confidence), objects (type, name, package, file,
    line_no, tables_read, tables_written, on_table, synonym_for), routine_calls (caller,
    routine, package, dynamic), tables (file, table_name, mode, confidence), columns
    (file, table_name, column_name, mode, confidence). Absent families are None."""
    name = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    found: list[DataFrame] = []
    if files is not None:
        found.append(_edges(files, name("file", F.col("from_file")), name("file", F.col("to_file")), F.coalesce("kind", F.lit("import")), F.coalesce("confidence", F.lit("inferred"))))
    if methods is not None:
        said = F.when(F.col("from_type").isNotNull() & F.col("from_method").isNotNull(), F.concat_ws(".", "from_type", "from_method")).otherwise(F.coalesce("from_method", F.lit("?")))
        one, two = F.concat(F.lit("method:"), "from_file", F.lit("#"), said), F.concat(F.lit("method:"), "to_file", F.lit("#"), F.coalesce("to_method", F.lit("?")))
        found += [_edges(methods, one, two, "call", F.col("confidence")), _edges(methods, one, name("file", F.col("from_file")), "defined-in", "resolved"), _edges(methods, two, name("file", F.col("to_file")), "defined-in", "resolved")]
    if http is not None:
        found.append(_edges(http, name("file", F.col("from_file")), name("file", F.col("to_file")), "http-call", F.col("confidence")))
    if objects is not None:
        if db_calls is not None:
            d = resolve_routines(db_calls.select("file", "routine", "package", "confidence"), objects)
            found.append(_edges(d, name("file", F.col("file")), F.col("id"), "db-call", F.when(F.col("confidence") == "inferred", "inferred").otherwise(F.col("sure"))))
        if routine_calls is not None:
            d = resolve_routines(routine_calls.where("NOT dynamic").select("caller", "routine", "package"), objects)
            d = d.select(F.col("caller").alias("routine"), F.lit(None).cast("string").alias("package"), F.col("id").alias("to_id"), F.col("sure").alias("callee_sure"))
            found.append(_edges(resolve_routines(d, objects), F.col("id"), F.col("to_id"), "plsql-call", F.col("callee_sure")))
        own = objects.where(~F.lower("type").isin("synonym", "sequence")).withColumn("id", routine_id(F.col("name"), F.col("package")))
        found += [_edges(own.select("id", F.explode(c).alias("t")), F.col("id"), name("table", F.upper("t")), via, "resolved") for c, via in (("tables_read", "reads"), ("tables_written", "writes"))]
        found.append(_edges(own.where((F.lower("type") == "trigger") & F.col("on_table").isNotNull()), F.col("id"), name("table", F.upper("on_table")), "trigger-on", "resolved"))
        found.append(_edges(own, F.col("id"), name("file", F.col("file")), "defined-in", "resolved"))
    if tables is not None:
        found.append(_edges(tables, name("file", F.col("file")), name("table", F.upper("table_name")), F.col("mode"), F.col("confidence")))
    if columns is not None:
        column = F.concat(F.lit("column:"), F.upper("table_name"), F.lit("."), F.upper("column_name"))
        found += [_edges(columns, name("file", F.col("file")), column, F.col("mode"), F.col("confidence")), _edges(columns, column, name("table", F.upper("table_name")), "belongs-to", "resolved")]
    return union_edges(*found)


def call_graph(calls: DataFrame, endpoints: DataFrame, objects: DataFrame, routine_calls: DataFrame, db_calls: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, layer, file) and edges (from_id, to_id, type, confidence, label): a
    node a front-end file (``fe:``), back-end file (``be:``), database package (``db:``) and
    table (``tbl:``); one edge a pair and type, the first by label."""
    label = F.regexp_replace(F.element_at(F.split("file", "/"), -1), "\\.(java|ts|tsx|js|jsx|py|cs|kt)$", "")

    def node(d: DataFrame, kind: str, key: Column, shown: Column, layer: str, file: Column) -> DataFrame:
        return d.select(F.concat(F.lit(kind + ":"), key).alias("id"), shown.alias("label"), F.lit(layer).alias("layer"), file.alias("file"))

    none = F.lit(None).cast("string")
    package = F.upper(F.coalesce("package", "name"))
    called = F.upper(F.coalesce("package", "routine"))
    touched = [objects.select(F.upper(F.coalesce("package", "name")).alias("key"), F.explode(c).alias("t"), F.lit(mode).alias("mode")) for c, mode in (("tables_written", "write"), ("tables_read", "read"))]
    touched = touched[0].unionByName(touched[1])
    nodes = node(calls, "fe", F.col("file"), label, "frontend", F.col("file"))
    for d in (endpoints, db_calls, tables):
        nodes = nodes.unionByName(node(d, "be", F.col("file"), label, "backend", F.col("file")))
    nodes = nodes.unionByName(node(objects, "db", package, package, "database", F.col("file"))).unionByName(node(db_calls, "db", called, called, "database", none)).unionByName(node(routine_calls, "db", called, called, "database", none))
    for d, c in ((tables, F.upper("table_name")), (touched, F.upper("t"))):
        nodes = nodes.unionByName(node(d, "tbl", c, c, "database", none))
    nodes = nodes.groupBy("id").agg(F.min("label").alias("label"), F.min("layer").alias("layer"), F.min("file").alias("file"))

    def edge(d: DataFrame, a: Column, b: Column, kind: str, sure: Column | str, said: Column) -> DataFrame:
        sure = F.lit(sure) if isinstance(sure, str) else sure
        return d.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"), sure.alias("confidence"), said.alias("label")).where("from_id <> to_id")

    fe, be, db, tbl = (lambda c, k=k: F.concat(F.lit(k + ":"), c) for k in ("fe", "be", "db", "tbl"))
    of = objects.where("package IS NOT NULL").groupBy(F.upper("name").alias("_caller")).agg(F.max("package").alias("_of"))
    routine_calls = routine_calls.withColumn("_caller", F.upper("caller")).join(of, "_caller", "left")
    edges = edge(http_edges(calls, endpoints), fe(F.col("from_file")), be(F.col("to_file")), "HTTP_CALL", F.col("confidence"), F.col("label"))
    edges = edges.unionByName(edge(db_calls, be(F.col("file")), db(called), "DB_CALL", F.col("confidence"), F.concat_ws(".", "package", "routine")))
    edges = edges.unionByName(edge(tables, be(F.col("file")), tbl(F.upper("table_name")), "TABLE_ACCESS", F.col("confidence"), F.col("mode")))
    edges = edges.unionByName(edge(touched, db(F.col("key")), tbl(F.upper("t")), "TABLE_ACCESS", "resolved", F.col("mode")))
    edges = edges.unionByName(edge(routine_calls, db(F.upper(F.coalesce("_of", "caller"))), db(called), "PLSQL_CALL", F.when(F.col("dynamic"), "inferred").otherwise("resolved"), F.concat_ws(".", "package", "routine")))
    edges = edges.groupBy("from_id", "to_id", "type").agg(F.min_by(F.struct("confidence", "label"), F.struct(F.coalesce("label", F.lit("")), "confidence")).alias("m")).select("from_id", "to_id", "type", "m.confidence", "m.label")
    return nodes, edges


# -- Traces ------------------------------------------------------------------------


def trace_edges(files: DataFrame, cg_edges: DataFrame) -> DataFrame:
    """(from_id, to_id, via, confidence): code edges and the call graph's as one graph of
    files and database objects. A front-end and a back-end node of one file are that file."""
    flat = lambda c: F.when(F.col(c).rlike("^(fe|be):"), F.concat(F.lit("file:"), F.substring_index(c, ":", -1))).otherwise(F.col(c))
    code = files.select(F.concat(F.lit("file:"), "from_file").alias("from_id"), F.concat(F.lit("file:"), "to_file").alias("to_id"), F.coalesce("kind", F.lit("import")).alias("via"), "confidence")
    bridged = cg_edges.select(flat("from_id").alias("from_id"), flat("to_id").alias("to_id"), F.lower(F.regexp_replace("type", "_", "-")).alias("via"), "confidence")
    return code.unionByName(bridged).where("from_id <> to_id").distinct()


def resolve_entry(nodes: DataFrame, text: str) -> str | None:
    """The trace node that a text means: a database object of that label, then of one of its
    dotted parts, then the shortest label that begins with the text or is in it, then a
    file of that path or the shortest path that contains it."""
    up = text.upper()
    label = F.upper("label")
    data = F.col("layer") == "database"
    tier = F.when(data & (label == up), 0)
    if "." in up:
        for i, part in enumerate(up.split(".")):
            tier = tier.when(data & (label == part), 1 + i)
    tier = tier.when(data & (label.startswith(up) | F.contains(F.lit(up), label)), 100).when(F.col("file") == text, 200).when(F.contains(F.col("file"), F.lit(text)), 201)
    row = nodes.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.when(F.col("tier") < 200, F.length("label")).otherwise(F.length("file")), "id").first()
    if row is None:
        return None
    return f"file:{row['file']}" if row["tier"] >= 200 else row["id"]


def cross_tier_trace(edges: DataFrame, entry: str, max_nodes: int | None = 800) -> tuple[DataFrame, list[str]]:
    """What depends on ``entry`` across tiers (id, layer, depth), and a sample path from the
    deepest front-end file (else the deepest node) to it. A step of the path goes to the
    smallest node a level nearer."""
    edges = checkpoint(edges)
    seeds = edges.sparkSession.createDataFrame([(entry,)], "id string")
    up = checkpoint(reach(edges, seeds, 1 << 20, True, max_nodes).select("id", "depth"))
    ext = F.regexp_extract("id", "\\.([^./]+)$", 1)
    layer = F.when(F.col("id").startswith("file:"), file_layer(F.substring_index("id", ":", -1), ext)).otherwise("database")
    told = up.withColumn("layer", layer)
    last = told.where("depth > 0").orderBy(F.desc(F.col("layer") == "frontend"), F.desc("depth"), "id").first()
    path = [last["id"]] if last else []
    depth = last["depth"] if last else 0
    while depth > 0:
        near = edges.where(F.col("from_id") == path[-1]).join(up.where(F.col("depth") == depth - 1).select(F.col("id").alias("to_id")), "to_id", "left_semi")
        path.append(near.agg(F.min("to_id")).first()[0])
        depth -= 1
    return told.where("depth > 0").select("id", "layer", "depth"), path


def both_ways(edges: DataFrame, nodes: DataFrame, text: str, max_depth: int = 50) -> DataFrame:
    """(id, direction, depth): all that depends on the nodes whose id contains a text, and all
    that these depend on."""
    seeds = nodes.where(F.contains(F.upper("id"), F.lit(text.upper()))).select("id")
    up, down = (reach(edges, seeds, max_depth, back).where("depth > 0").select("id", F.lit(way).alias("direction"), "depth") for way, back in (("up", True), ("down", False)))
    return up.unionByName(down)


def table_matrix(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(id, table, reads, writes) of the reached nodes (id)."""
    d = edges.where(F.col("to_kind") == "table").join(reached.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
    return d.groupBy(F.col("from_id").alias("id"), F.substring_index("to_id", ":", -1).alias("table")).agg(F.bool_or(F.col("via").isin("read", "reads")).alias("reads"), F.bool_or(F.col("via").isin("write", "writes")).alias("writes"))


def annotate_methods(path: list[str], methods: DataFrame) -> list[str]:
    """A trace's code hops with the method that calls the next file, where one is known."""
    pairs = [(a.removeprefix("file:"), b.removeprefix("file:")) for a, b in zip(path, path[1:], strict=False) if a.startswith("file:") and b.startswith("file:")]
    if not pairs:
        return list(path)
    wanted = methods.sparkSession.createDataFrame(pairs, "from_file string, to_file string")
    found = methods.where("from_method IS NOT NULL").join(F.broadcast(wanted), ["from_file", "to_file"]).groupBy("from_file", "to_file").agg(F.min("from_method").alias("m")).collect()
    by = {(f"file:{r['from_file']}", f"file:{r['to_file']}"): r["m"] for r in found}
    return [f"{a}.{by[a, b]}" if (a, b) in by else a for a, b in zip(path, [*path[1:], ""], strict=True)]


# -- Levels ----------------------------------------------------------------------


def container(files: DataFrame, layers: list[str], modules: list[str]) -> DataFrame:
    """(file, container) of files (file, layer, module) at a level where ``layers`` and
    ``modules`` are expanded: the file itself, its module, or its layer."""
    shown = F.when(F.col("module").isin(modules), F.concat(F.lit("file:"), "file")) if modules else F.when(F.lit(False), "")
    shown = shown.when(F.col("layer").isin(layers), F.concat(F.lit("module:"), "module")) if layers else shown
    return files.select("file", shown.otherwise(F.concat(F.lit("layer:"), "layer")).alias("container"))


def graph_level(edges: DataFrame, files: DataFrame, layers: list[str] = (), modules: list[str] = ()) -> DataFrame:
    """(a, b, weight, resolved) between the containers that are visible at a level, from
    (from_file, to_file, confidence)."""
    held = container(files, list(layers), list(modules))
    d = edges.join(held.toDF("from_file", "ca"), "from_file").join(held.toDF("to_file", "cb"), "to_file")
    return matrix(d, F.col("ca"), F.col("cb"))


def symbol_level(methods: DataFrame, files: DataFrame, opened: list[str], layers: list[str] = (), modules: list[str] = ()) -> DataFrame:
    """(a, b, weight, resolved) of the method edges that touch an ``opened`` file (from_file,
    from_method, to_file, to_method, confidence): the opened files' symbols, and for other
    ends their file's container at the level, see ``container``. A call within one symbol is
    no edge."""
    held = container(files, list(layers), list(modules))
    e = methods.where(F.col("from_file").isin(opened) | F.col("to_file").isin(opened))

    def shown(end: str) -> Column:
        name = F.substring_index(F.coalesce(f"{end}_method", F.lit("")), ".", -1)
        return F.when(F.col(f"{end}_file").isin(opened), F.concat(F.lit("symbol:"), f"{end}_file", F.lit("#"), name)).otherwise(F.col(f"c_{end}"))

    met = e.join(held.toDF("from_file", "c_from"), "from_file", "left").join(held.toDF("to_file", "c_to"), "to_file", "left")
    return matrix(met, shown("from"), shown("to"))


def unified_level(edges: DataFrame, files: DataFrame, layers: list[str] = (), modules: list[str] = ()) -> DataFrame:
    """(a, b, weight, via) of impact edges: files and methods in their containers, database
    nodes by kind unless the layer ``database`` is expanded; via is the dominant relation."""
    held = container(files, list(layers), list(modules))
    rows = edges.select("from_id", "to_id", "via")
    for end, name in (("from_id", "a"), ("to_id", "b")):
        path = F.regexp_replace(F.regexp_replace(F.col(end), "^(file|method):", ""), "#.*$", "")
        kind = F.substring_index(end, ":", 1)
        own = F.col(end) if "database" in layers else F.concat(F.lit("kind:"), kind)
        rows = rows.withColumn("_f", F.when(kind.isin("file", "method"), path)).join(held.toDF("_f", "_c"), "_f", "left")
        rows = rows.withColumn(name, F.when(F.col("_f").isNull(), own).otherwise(F.coalesce("_c", F.lit("layer:backend")))).drop("_f", "_c")
    e = rows.where("a <> b").groupBy("a", "b", "via").agg(F.count("*").alias("n"))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in VIA_PRIORITY.items() for x in kv]), F.col("via")), F.lit(0))
    return e.groupBy("a", "b").agg(F.sum("n").alias("weight"), F.max_by("via", F.struct((rank + 0.01 * F.col("n")).alias("score"), "via")).alias("via"))


def children_of(files: DataFrame, edges: DataFrame, module: str, most: int = 150) -> DataFrame:
    """(id, degree, files): the connected files of a module by degree, ``most`` of them, and
    one row ``more:<module>`` for the others."""
    d = degrees(edges.select(F.col("from_file").alias("from_id"), F.col("to_file").alias("to_id"))).select(F.col("id").alias("file"), "degree")
    own = files.where(F.col("module") == module).join(d, "file").withColumn("r", F.row_number().over(Window.orderBy(F.desc("degree"), "file")))
    top = own.where(F.col("r") <= most).select(F.concat(F.lit("file:"), "file").alias("id"), "degree", F.lit(1).cast("long").alias("files"))
    rest = own.where(F.col("r") > most).agg(F.sum("degree").alias("degree"), F.count("*").alias("files")).where("files > 0")
    return top.unionByName(rest.select(F.lit(f"more:{module}").alias("id"), "degree", "files"))


def module_fluxes(edges: DataFrame, modules: DataFrame, sizes: int = 12, n: int = 15) -> DataFrame:
    """(a, b, weight): the strongest edges between the largest modules, from (from_file,
    to_file) and (file, module)."""
    top = modules.groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(sizes).select("module")
    own = modules.join(F.broadcast(top), "module").select("file", "module")
    d = edges.join(own.toDF("from_file", "a"), "from_file").join(own.toDF("to_file", "b"), "to_file").where("a <> b")
    return d.groupBy("a", "b").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(n)


def module_pairs(files: DataFrame, http: DataFrame, modules: DataFrame) -> DataFrame:
    """(a, b, via): the pairs of modules with a code edge, and those that only calls join."""
    def pairs(d: DataFrame) -> DataFrame:
        return d.join(modules.toDF("from_file", "a"), "from_file").join(modules.toDF("to_file", "b"), "to_file").where("a <> b").select("a", "b").distinct()

    code = pairs(files)
    return code.withColumn("via", F.lit("import")).unionByName(pairs(http).join(code, ["a", "b"], "left_anti").withColumn("via", F.lit("http")))


# -- Reports ----------------------------------------------------------------------


def central_files(edges: DataFrame, n: int = 20) -> DataFrame:
    """The files that most depend on, with their degrees."""
    return degrees(edges).where("in_degree > 0").orderBy(F.desc("in_degree"), "id").limit(n)


def impact_report(edges: DataFrame, node: str, modules: DataFrame, max_depth: int = 10, max_nodes: int = 2000) -> tuple[DataFrame, DataFrame, bool]:
    """What depends on a node with its module; counts by kind and module; whether levels were
    left out for ``max_nodes``. modules: (file, module)."""
    seeds = edges.sparkSession.createDataFrame([(node,)], "id string")
    hit = checkpoint(reach(edges, seeds, max_depth, True, max_nodes).where("depth > 0"))
    path = F.when(F.col("id").rlike("^(file|method):"), F.regexp_replace(F.regexp_replace("id", "^(file|method):", ""), "#.*$", ""))
    told = checkpoint(hit.withColumn("kind", F.substring_index("id", ":", 1)).withColumn("file", path).join(modules.select("file", "module"), "file", "left").select("id", "kind", "depth", "confidence", "module"))
    counts = told.groupBy("kind", "module").agg(F.count("*").alias("n"))
    deepest = told.agg(F.max("depth")).first()[0] or 0
    further = edges.join(told.where(F.col("depth") == deepest).select(F.col("id").alias("to_id")), "to_id", "left_semi").join(told.select(F.col("id").alias("from_id")), "from_id", "left_anti").where(F.col("from_id") != node)
    return told, counts, told.count() >= max_nodes and deepest < max_depth and not further.isEmpty()


def surprising(edges: DataFrame, modules: DataFrame, n: int = 15) -> DataFrame:
    """(from_id, to_id, via, reason): edges that jump over a tier, and edges that are the only
    one between their modules; the former first. modules: (file, module)."""
    tier = F.create_map(*[F.lit(x) for kv in TIER.items() for x in kv])
    path = lambda c: F.when(F.col(c).rlike("^(file|method):"), F.regexp_replace(F.regexp_replace(c, "^(file|method):", ""), "#.*$", ""))
    d = edges.withColumn("fa", path("from_id")).withColumn("fb", path("to_id"))
    d = d.join(modules.toDF("fa", "ma"), "fa", "left").join(modules.toDF("fb", "mb"), "fb", "left")
    apart = F.col("ma").isNotNull() & F.col("mb").isNotNull() & (F.col("ma") != F.col("mb"))
    rare = d.where(apart).groupBy("ma", "mb").agg(F.count("*").alias("k")).where("k = 1")
    jump = F.abs(tier[F.col("from_kind")] - tier[F.col("to_kind")]) >= 2
    d = d.join(rare, ["ma", "mb"], "left").withColumn("reason", F.when(jump, "cross-tier").when(F.col("k").isNotNull(), "cross-module")).where("reason IS NOT NULL")
    one = d.groupBy("from_id", "to_id").agg(F.min(F.struct(F.when(F.col("reason") == "cross-tier", 0).otherwise(1).alias("o"), "via", "reason")).alias("m"))
    return one.orderBy("m.o", "from_id", "to_id").limit(n).select("from_id", "to_id", "m.via", "m.reason")


def path_violations(edges: DataFrame) -> DataFrame:
    """(from_file, to_file, type, severity): front ends that import servers, and controllers
    that reach the database past a service; once a pair and type."""
    a, b = F.col("from_file"), F.col("to_file")
    found = F.array(F.when(a.rlike(FRONTEND_PATH) & b.rlike(SERVER_PATH), F.struct(F.lit("frontend_imports_server").alias("type"), F.lit("high").alias("severity"))), F.when(a.rlike(CONTROLLER_PATH) & b.rlike(DB_PATH), F.struct(F.lit("direct_db_from_controller").alias("type"), F.lit("medium").alias("severity"))))
    return edges.select("from_file", "to_file", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select("from_file", "to_file", "v.type", "v.severity").distinct()


def dead_components(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, type): .tsx files and Angular parts that nothing imports, but entry files."""
    name = F.element_at(F.split("file", "/"), -1)
    kind = F.when(F.col("file").endswith(".tsx"), "react").when(F.col("file").rlike("\\.(component|directive|pipe)\\.ts$"), "angular")
    return files.where(~name.isin(*ENTRY_FILES)).select("file", kind.alias("type")).where("type IS NOT NULL").join(edges.select(F.col("to_file").alias("file")), "file", "left_anti")


def dead_routines(objects: DataFrame, routine_calls: DataFrame, db_calls: DataFrame) -> DataFrame:
    """(name, package, file): procedures and functions that no call names, nor their package."""
    refs = routine_calls.select("routine", "package").unionByName(db_calls.select("routine", "package"))
    called = refs.select(F.explode(F.array(F.upper("routine"), F.upper("package"))).alias("name")).where("name IS NOT NULL").distinct()
    own = objects.where(F.lower("type").isin("procedure", "function")).select("name", "package", "file")
    alive = called.select(F.col("name").alias("_c"))
    out = own.join(alive, F.upper(own["name"]) == alive["_c"], "left_anti")
    return out.join(alive, F.upper(out["package"]) == alive["_c"], "left_anti")


def entry_points(endpoints: DataFrame, jobs: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, file): endpoints, jobs, and front-end files that nothing imports, those
    with the most imports first. files: (file, ext, layer)."""
    a = endpoints.select(F.lit("endpoint").alias("kind"), F.concat_ws(" ", "method", "route").alias("label"), "file", F.lit(0).cast("long").alias("weight"))
    b = jobs.select(F.lit("job").alias("kind"), F.concat_ws(" ", "kind", "method").alias("label"), "file", F.lit(0).cast("long").alias("weight"))
    d = degrees(edges.select(F.col("from_file").alias("from_id"), F.col("to_file").alias("to_id"))).select(F.col("id").alias("file"), "in_degree", "out_degree")
    roots = files.where("layer = 'frontend'").where(F.col("ext").isin("tsx", "ts", "vue", "svelte")).join(d, "file", "left").where("coalesce(in_degree, 0) = 0")
    c = roots.select(F.lit("root").alias("kind"), F.col("file").alias("label"), "file", F.coalesce("out_degree", F.lit(0)).alias("weight"))
    return a.unionByName(b).unionByName(c).orderBy("kind", F.desc("weight"), "label").drop("weight")


def file_profile(file: str, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(part, name): all files that ``file`` surely uses (callees), all that use it (callers)
    and all its types (symbols). Rows, since a hub's callers needn't fit in one."""
    end = lambda held, part, c: F.when(held, F.struct(F.lit(part).alias("part"), F.col(c).alias("name")))
    uses = end((F.col("from_file") == file) & (F.col("confidence") == "resolved"), "callees", "to_file")
    used = end(F.col("to_file") == file, "callers", "from_file")
    linked = edges.select(F.inline(F.array_compact(F.array(uses, used)))).distinct()
    return linked.unionByName(symbols.where(F.col("file") == file).select(F.lit("symbols").alias("part"), "name"))


def methods_of(methods: DataFrame, files: DataFrame) -> DataFrame:
    """Method edges with an end in a set of files (file)."""
    a = methods.join(files.select(F.col("file").alias("from_file")), "from_file", "left_semi").select(*methods.columns)
    b = methods.join(files.select(F.col("file").alias("to_file")), "to_file", "left_semi").select(*methods.columns)
    return a.unionByName(b).distinct()


def table_access(objects: DataFrame, name: str) -> DataFrame:
    """(name, package, mode): routines that read or write a table whose name contains this."""
    has = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.contains(F.upper(t), F.lit(name.upper())))
    modes = F.filter(F.array(F.when(has("tables_read"), F.lit("read")), F.when(has("tables_written"), F.lit("write"))), lambda x: x.isNotNull())
    return objects.select("name", "package", F.explode(modes).alias("mode"))


def column_lineage(columns: DataFrame, table: str) -> DataFrame:
    """(column_name, mode, file) of a table."""
    return columns.where(F.upper("table_name") == table.upper()).select("column_name", "mode", F.element_at(F.split("file", "/"), -1).alias("file")).distinct().orderBy("column_name", "mode", "file")


def object_profile(objects: DataFrame, cg_edges: DataFrame, name: str, package: str | None = None, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """The objects that a name means (equal names, else those that contain it), and their
    callers and callees (direction, id), ``shown`` of each."""
    own = F.upper("name") == name.upper()
    if package:
        own = own & (F.upper("package") == package.upper())
    tier = F.when(own, 0).when(F.contains(F.upper("name"), F.lit(name.upper())), 1)
    d = objects.withColumn("tier", tier).where("tier IS NOT NULL")
    best = d.agg(F.min("tier").alias("least"))
    found = d.join(F.broadcast(best), F.col("tier") == F.col("least")).select(*objects.columns)
    hit = lambda c: F.contains(F.upper(c), F.lit(name.upper()))
    callers = cg_edges.where(hit("to_id")).select(F.lit("caller").alias("direction"), F.col("from_id").alias("id")).distinct().orderBy("id").limit(shown)
    callees = cg_edges.where(hit("from_id")).select(F.lit("callee").alias("direction"), F.col("to_id").alias("id")).distinct().orderBy("id").limit(shown)
    return found, callers.unionByName(callees)


def concept_map(term: str, artifacts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(artifact, label): the rows of each kind of artifact whose column contains a term."""
    out = None
    for kind, (d, column) in artifacts.items():
        one = d.where(F.contains(F.lower(column), F.lit(term.lower()))).select(F.lit(kind).alias("artifact"), F.col(column).alias("label")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def community_names(members: DataFrame) -> DataFrame:
    """(community, name, size) of (id, community): the most common first folder of its files or
    database prefix; ``db/`` before it where database nodes are more than half."""
    data = F.substring_index("id", ":", 1).isin("plsql", "table", "column")
    bare = F.regexp_replace("id", "^[a-z]+:", "")
    prefix = F.when(data, F.regexp_extract(bare, "^([^._]+)", 1)).otherwise(F.regexp_replace(bare, "/?[^/]*$", ""))
    d = members.select("community", F.when(prefix == "", bare).otherwise(prefix).alias("prefix"), data.cast("int").alias("data"))
    by = d.groupBy("community", "prefix").agg(F.count("*").alias("n"), F.sum("data").alias("data"))
    out = by.groupBy("community").agg(F.min_by("prefix", F.struct(-F.col("n"), "prefix")).alias("prefix"), F.sum("n").alias("size"), F.sum("data").alias("data"))
    return out.select("community", F.when(2 * F.col("data") > F.col("size"), F.concat(F.lit("db/"), "prefix")).otherwise(F.col("prefix")).alias("name"), "size")


def inheritance_families(edges: DataFrame) -> DataFrame:
    """(id, role, children) of (from_id extends to_id): roots, leaves and what lies between,
    with how many extend each."""
    d = degrees(edges)
    role = F.when(F.col("out_degree") == 0, "root").when(F.col("in_degree") == 0, "leaf").otherwise("middle")
    return d.select("id", role.alias("role"), F.col("in_degree").alias("children"))


def top_by_layer(nodes: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` nodes of each layer that depend on most (id, layer, out_degree)."""
    w = Window.partitionBy("layer").orderBy(F.desc("out_degree"), "id")
    return nodes.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def described(files: DataFrame) -> DataFrame:
    """(file, label): what a file's name says of it."""
    return files.select("file", spoken(F.regexp_replace(F.element_at(F.split("file", "/"), -1), "\\.[^.]*$", "")).alias("label"))
