"""Names to files: script imports through aliases and barrels, JVM imports, call receivers.

All are joins over facts that patterns give; texts are read once a fact.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoint
from .structure import implementors, java_types, resolve_types

# Endings that an import may leave out, in order (fixed values).
ENDS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts"]
INDEXES = [f"/index{e}" for e in ENDS if e]
#: Barrels that a name is followed through at most.
BARRELS = 5


def tolerant_json(text: str) -> dict:
    """A config with comments and trailing commas; {} where it isn't one."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.DOTALL)
    try:
        told = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
    except ValueError:
        return {}
    return told if isinstance(told, dict) else {}


def aliases(config: str) -> list[tuple[str, str]]:
    """(pattern, target) of a compiler config's paths, targets below its base folder."""
    told = tolerant_json(config).get("compilerOptions", {})
    base = told.get("baseUrl", ".").strip("./")
    return [(p, "/".join(x for x in (base, t.removeprefix("./")) if x)) for p, to in told.get("paths", {}).items() for t in to]


def folded(path: Column) -> Column:
    """A path without ``.`` and ``..``; null where it leaves the root."""
    parts = F.split(path, "/")
    out = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.when((F.size(s) == 0) | (F.element_at(F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(".."))), -1) == ".."), F.concat(s, F.array(p))).otherwise(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))).when((p == ".") | (p == ""), s).otherwise(F.concat(s, F.array(p))))
    return F.when(~F.array_contains(out, ".."), F.array_join(out, "/"))


def script_uses(files: DataFrame) -> DataFrame:
    """(file, target, name) of the names that a script imports; name is null for a whole or
    default import."""
    form = "import\\s+(?:type\\s+)?([\\w*\\s{},$]+?)\\s+from\\s+['\"]([^'\"]+)['\"]"
    d = files.where(F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1)).isin("ts", "tsx", "js", "jsx", "mjs", "cjs")).select("file", F.explode(F.regexp_extract_all("text", F.lit(form), 0)).alias("s"))
    names = F.transform(F.split(F.regexp_extract("s", "\\{([^}]*)\\}", 1), ","), lambda x: F.nullif(F.regexp_extract(x, "^\\s*(?:type\\s+)?(\\w+)", 1), F.lit("")))
    return d.select("file", F.regexp_extract("s", form, 2).alias("target"), F.explode(names).alias("name")).distinct()


def script_targets(found: DataFrame, files: DataFrame, paths: list[tuple[str, str]] = ()) -> DataFrame:
    """``found`` (file, target, ...) with to_file: relative targets, and aliases in their order;
    the first ending, then the first index file that exists."""
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    tries = [F.struct(F.lit(0).alias("turn"), F.when(F.col("target").startswith("."), folded(F.concat_ws("/", F.nullif(folder, F.lit("")), "target"))).alias("stem"))]
    for i, (pattern, to) in enumerate(paths):
        head, star, _ = pattern.partition("*")
        fits = F.col("target").startswith(head) if star else F.col("target") == pattern
        rest = F.substring(F.col("target"), F.lit(len(head) + 1), F.length("target"))
        left, _, right = to.partition("*")
        stem = F.concat(F.lit(left), rest, F.lit(right)) if star else F.lit(to)
        tries.append(F.struct(F.lit(i + 1).alias("turn"), F.when(~F.col("target").startswith(".") & fits, folded(stem)).alias("stem")))
    each = found.withColumn("_t", F.explode(F.filter(F.array(*tries), lambda t: t["stem"].isNotNull())))
    each = each.withColumn("_e", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e")) for k, e in enumerate(ENDS + INDEXES)])))
    each = each.withColumn("_p", F.concat("_t.stem", "_e.e")).join(files.select(F.col("file").alias("_p")), "_p")
    return each.groupBy(*found.columns).agg(F.min_by("_p", F.struct("_t.turn", "_e.k")).alias("to_file"))


def script_imports(files: DataFrame, paths: list[tuple[str, str]] = ()) -> DataFrame:
    """(from_file, to_file, kind, confidence): imports of scripts, through re-exporting files to
    the file that declares the name."""
    declared = files.select(F.col("file").alias("to_file"), F.explode(F.regexp_extract_all("text", F.lit("export\\s+(?:default\\s+)?(?:abstract\\s+)?(?:async\\s+)?(?:class|function|const|let|var|interface|type|enum)\\s+(\\w+)"), 1)).alias("name")).distinct()
    again = files.select("file", F.explode(F.regexp_extract_all("text", F.lit("export\\s+(?:type\\s+)?(?:\\*(?:\\s+as\\s+\\w+)?|\\{[^}]*\\})\\s+from\\s+['\"]([^'\"]+)['\"]"), 1)).alias("target")).distinct()
    passes = script_targets(again, files, paths).select(F.col("file").alias("to_file"), F.col("to_file").alias("next"))
    open_ = script_targets(script_uses(files), files, paths).select("file", "name", "to_file")
    done = None
    for turn in range(BARRELS + 1):
        here = open_.join(declared, ["to_file", "name"], "left_semi") if turn else open_.join(declared, ["to_file", "name"], "left_semi").unionByName(open_.where("name IS NULL"))
        rest = open_.where("name IS NOT NULL").join(declared, ["to_file", "name"], "left_anti")
        further = rest.join(passes, "to_file").select("file", "name", F.col("next").alias("to_file")).distinct()
        # What no barrel passes on ends where it is, if it is the import itself.
        last = rest.join(passes.select("to_file").distinct(), "to_file", "left_anti") if not turn else None
        for d in (here, last):
            if d is not None:
                done = d.select("file", "to_file") if done is None else done.unionByName(d.select("file", "to_file"))
        open_ = further
    return done.where("file <> to_file").distinct().select(F.col("file").alias("from_file"), "to_file", F.lit("import").alias("kind"), F.lit("resolved").alias("confidence"))


def jvm_imports(files: DataFrame) -> DataFrame:
    """(from_file, to_file, kind, confidence): imports by full name, and of whole packages
    those files whose type's name the text has."""
    jvm = files.where(F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1)).isin("java", "kt"))
    package = F.regexp_extract("text", "(?m)^\\s*package\\s+([\\w.]+)", 1)
    own = jvm.select(F.col("file").alias("to_file"), package.alias("package"), F.regexp_extract("file", "([^/]+)\\.[^.]*$", 1).alias("simple"))
    named = jvm.select("file", F.explode(F.regexp_extract_all("text", F.lit("(?m)^\\s*import\\s+(?:static\\s+)?([\\w.]+(?:\\.\\*)?)\\s*;?\\s*$"), 1)).alias("target")).distinct()
    one = named.join(own.withColumn("target", F.concat_ws(".", F.nullif("package", F.lit("")), "simple")), "target").select("file", "to_file")
    body = F.regexp_replace("text", "(?m)^\\s*(import|package)\\b.*$", "")
    words = jvm.select("file", F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit("\\b([A-Z]\\w*)"), 1))).alias("simple"))
    whole = named.where("target LIKE '%.*'").select("file", F.regexp_replace("target", "\\.\\*$", "").alias("package"))
    two = whole.join(own, "package").join(words, ["file", "simple"], "left_semi").select("file", "to_file")
    return one.unionByName(two).where("file <> to_file").distinct().select(F.col("file").alias("from_file"), "to_file", F.lit("import").alias("kind"), F.lit("inferred").alias("confidence"))


def java_symbols(files: DataFrame) -> DataFrame:
    """(file, kind, name, type): classes, interfaces and enums, their fields with the type, and
    their methods, by patterns."""
    jvm = files.where(F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1)) == "java").withColumn("bare", F.regexp_replace("text", "(?s)/\\*.*?\\*/|//[^\\n]*|\"(?:\\\\.|[^\"\\\\\\n])*\"", " "))
    none = F.lit(None).cast("string")
    types = java_types(jvm.select("file", F.col("bare").alias("text"))).select("file", "kind", F.col("simple").alias("name"), none.alias("type"))
    field = "(?m)^\\s*(?:@\\w+\\s+)*(?:(?:private|protected|public|static|final)\\s+)+([A-Z]\\w*)(?:<[^>]*>)?\\s+(\\w+)\\s*[;=]"
    fields = jvm.select("file", F.explode(F.regexp_extract_all("bare", F.lit(field), 0)).alias("s")).select("file", F.lit("field").alias("kind"), F.regexp_extract("s", field, 2).alias("name"), F.regexp_extract("s", field, 1).alias("type"))
    method = "(?m)^\\s*(?:(?:public|protected|private|static|final|abstract|synchronized|default)\\s+)*[\\w<>\\[\\], ?]+\\s+(\\w+)\\s*\\([^;{}]*\\)\\s*(?:throws\\s+[\\w., ]+)?\\s*[{;]"
    methods = jvm.select("file", F.explode(F.regexp_extract_all("bare", F.lit(method), 1)).alias("name")).where(~F.col("name").isin("if", "for", "while", "switch", "catch", "return", "new")).select("file", F.lit("method").alias("kind"), "name", none.alias("type"))
    return types.unionByName(fields).unionByName(methods).distinct()


def java_edges(files: DataFrame) -> DataFrame:
    """(from_file, to_file, kind, confidence, method): what a class implements or extends, and
    its calls on a field: to the field's type, or where that is an interface or abstract, to
    what implements it; sure where only one does."""
    types = checkpoint(java_types(files))
    symbols = java_symbols(files)
    fields = symbols.where("kind = 'field'").select("file", F.col("name").alias("field"), F.col("type").alias("simple"))
    bare = F.regexp_replace("text", "(?s)/\\*.*?\\*/|//[^\\n]*|\"(?:\\\\.|[^\"\\\\\\n])*\"", " ")
    call = "\\b(?:this\\.)?(\\w+)\\.(\\w+)\\s*\\("
    used = files.where(F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1)) == "java").select("file", F.explode(F.regexp_extract_all(bare, F.lit(call), 0)).alias("s"))
    used = used.select("file", F.regexp_extract("s", call, 1).alias("field"), F.regexp_extract("s", call, 2).alias("method")).distinct()
    met = checkpoint(used.join(fields, ["file", "field"]).select("file", "simple", "method"))
    meant = resolve_types(met.select("file", "simple").distinct(), types, files).select("file", "simple", "full_name")
    at = types.select("full_name", F.col("file").alias("to_file"))
    by = implementors(types).select(F.col("parent").alias("full_name"), F.col("child"))
    ways = checkpoint(meant.join(by, "full_name", "left").withColumn("meant", F.coalesce("child", "full_name")))
    n = ways.groupBy("file", "simple").agg(F.count_distinct("meant").alias("n"))
    calls = met.join(ways, ["file", "simple"]).join(n, ["file", "simple"]).join(at.withColumnRenamed("full_name", "meant"), "meant")
    calls = calls.select(F.col("file").alias("from_file"), "to_file", F.lit("call").alias("kind"), F.when(F.col("n") == 1, "resolved").otherwise("inferred").alias("confidence"), "method")
    heads = types.select("file", F.explode("parents").alias("p")).select("file", F.element_at(F.split("p", "\\."), -1).alias("simple")).distinct()
    up = resolve_types(heads, types, files).join(at, "full_name").join(types.select("full_name", F.col("kind").alias("of")), "full_name")
    up = up.select(F.col("file").alias("from_file"), "to_file", F.when(F.col("of") == "interface", "implements").otherwise("extends").alias("kind"), F.lit("resolved").alias("confidence"), F.lit(None).cast("string").alias("method"))
    return calls.unionByName(up).where("from_file <> to_file").distinct()
