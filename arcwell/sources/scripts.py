"""Symbols of TypeScript and JavaScript, and which method calls which.

A small scan tells a file's classes, their fields and methods, and its functions, each with
its own text. Who is called is then a matter of joins: a receiver's name is a field of the
class or a name of the method, its type is imported or declared somewhere, and a type's
file is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoint
from .resolve import script_targets, script_uses

EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs")
HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*(?:`|\Z)", re.DOTALL)
HEADS = re.compile(
    r"\bclass\s+(?P<type>[A-Za-z_$][\w$]*)[^{};]*\{"
    r"|\bfunction\s*\*?\s*(?P<function>[A-Za-z_$][\w$]*)\s*(?:<[^>{}()]*>)?\s*\("
    r"|\b(?:const|let|var)\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*(?::[^=;\n]*)?=\s*(?:async\s*)?\("
    r"|(?P<method>[A-Za-z_$#][\w$]*)\s*(?:<[^>{}()]*>)?\s*\(|[{}]")
NO_METHODS = frozenset("if for while switch catch return new typeof await function super constructor_ with yield import".split())
SYMBOL = "kind string, type string, name string, line_no int, params string, body string"


def bare_text(text: str) -> str:
    """``text`` with strings and comments blanked, every place kept."""
    return HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def closed(bare: str, at: int, pair: str) -> int:
    """The place behind the bracket that closes the one at ``at``; the end, if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(bare, at):
        depth += 1 if m.group() == pair[0] else -1
        if not depth:
            return m.end()
    return len(bare)


def scan_symbols(text: str) -> list[tuple[str, str | None, str, int, str, str]]:
    """(kind, type, name, line, parameters, body) of a file's classes, methods and functions. A
    method lies directly in its class's braces; a function in no other function's text."""
    bare = bare_text(text)
    out: list[tuple[str, str | None, str, int, str, str]] = []
    classes: list[tuple[str, int]] = []  # name and depth of its members
    depth = at = 0
    while m := HEADS.search(bare, at):
        at = m.end()
        kind = m.lastgroup
        name = m.group(kind) if kind else m.group()
        line = bare.count("\n", 0, m.start()) + 1
        if kind is None:
            depth += 1 if name == "{" else -1
            while classes and depth < classes[-1][1]:
                classes.pop()
        elif kind == "type":
            depth += 1
            classes.append((name, depth))
            out.append(("class", None, name, line, "", bare[m.end() : closed(bare, m.end() - 1, "{}") - 1]))
        else:
            member = kind == "method"
            if member and (name in NO_METHODS or not classes or depth != classes[-1][1]):
                continue
            end = closed(bare, m.end() - 1, "()")
            head = re.compile(r"\s*(?::[^{};=]*)?(=>)?\s*(\{)?").match(bare, end)
            if kind == "arrow" and not head.group(1) or member and not head.group(2) or kind == "function" and not head.group(2):
                continue
            stop = closed(bare, head.end() - 1, "{}") if head.group(2) else (bare + ";").index(";", head.end())
            owner = classes[-1][0] if classes else None
            out.append(("method" if member else "function", owner if member else None, name, line, bare[m.end() : end - 1], bare[end:stop]))
            at = stop
    return out


def script_symbols(files: DataFrame) -> DataFrame:
    """(file, kind, type, name, line_no, params, body) of script files (file, text); texts are
    without strings and comments. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, *s) for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in scan_symbols(text or "")]
            kinds = [pa.string()] * 4 + [pa.int32()] + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "kind", "type", "name", "line_no", "params", "body"])

    own = files.where(F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1)).isin(*EXTENSIONS)).select("file", "text")
    return own.mapInArrow(run, f"file string, {SYMBOL}")


def _named(text: str, pattern: str, *groups: int):
    """Structs of a pattern's groups in a column's text."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.struct(F.regexp_extract(x, pattern, groups[0]).alias("receiver"), F.regexp_extract(x, pattern, groups[1]).alias("simple")))


def receivers(symbols: DataFrame) -> DataFrame:
    """(file, type, method, receiver, simple): what a name is an object of: fields with their
    class (``this.x``, a null method), parameters and names of a method or function."""
    typed = "\\b([\\w$#]+)\\s*[?!]?\\s*:\\s*([A-Z][\\w$]*)"
    made = "\\b([\\w$#]+)\\s*(?::[^=;\\n]*)?=\\s*(?:await\\s+)?(?:new\\s+|inject\\s*\\(\\s*)([A-Z][\\w$]*)"
    kept = "\\b(?:private|public|protected|readonly)\\s+(?:readonly\\s+)?([\\w$]+)\\s*[?!]?\\s*:\\s*([A-Z][\\w$]*)"
    # A class's own lines, without what its methods hold.
    field = "(?m)^\\s*(?:(?:private|public|protected|readonly|static|declare|override)\\s+)*([\\w$#]+)\\s*[?!]?\\s*:\\s*([A-Z][\\w$]*)\\s*[^(\\n]*[;=]?\\s*$"
    begun = "(?m)^\\s*(?:(?:private|public|protected|readonly|static|override)\\s+)*([\\w$#]+)\\s*(?::[^=;\\n]*)?=\\s*(?:new\\s+|inject\\s*\\(\\s*)([A-Z][\\w$]*)"
    of_class = symbols.where("kind = 'class'").select("file", F.col("name").alias("type"), F.explode(F.concat(_named("body", field, 1, 2), _named("body", begun, 1, 2))).alias("r"))
    of_maker = symbols.where("kind = 'method' AND name = 'constructor'").select("file", "type", F.explode(F.concat(_named("params", kept, 1, 2), _named("body", "this\\." + made.removeprefix("\\b"), 1, 2))).alias("r"))
    fields = of_class.union(of_maker).select("file", "type", F.lit(None).cast("string").alias("method"), F.concat(F.lit("this."), "r.receiver").alias("receiver"), "r.simple")
    own = symbols.where("kind <> 'class'").select("file", "type", F.col("name").alias("method"), F.explode(F.concat(_named("params", typed, 1, 2), _named("body", "(?:const|let|var)\\s+" + typed, 1, 2), _named("body", "(?:const|let|var)\\s+" + made.removeprefix("\\b"), 1, 2))).alias("r"))
    return fields.union(own.select("file", "type", "method", "r.receiver", "r.simple")).distinct()


def script_method_edges(files: DataFrame, paths: list[tuple[str, str]] = ()) -> DataFrame:
    """(from_file, from_type, from_method, to_file, to_method, confidence): calls of methods of
    scripts. ``x.f()`` goes to the type of x, ``this.f()`` to the own class, ``f()`` to an
    imported function or one of the same file.

    A type or function lies where the file imports it from, else in the file itself, else where
    one file alone declares it: sure; where several do, each of them is inferred. A method
    that the type's file doesn't declare isn't called.
    """
    symbols = checkpoint(script_symbols(files))
    uses = checkpoint(script_targets(script_uses(files).where("name IS NOT NULL"), files, paths).select("file", "name", "to_file").distinct())
    call = "(?<![\\w$.])((?:this\\.)?[\\w$#]+)\\s*[?!]?\\.\\s*([\\w$#]+)\\s*(?:<[^>()]*>)?\\(|(?<![\\w$.])([\\w$]+)\\s*\\("
    bodies = symbols.where("kind <> 'class'").select("file", "type", F.col("name").alias("method"), F.explode(F.regexp_extract_all("body", F.lit(call), 0)).alias("s"))
    part = lambda i: F.nullif(F.regexp_extract("s", call, i), F.lit(""))
    calls = checkpoint(bodies.select("file", "type", "method", part(1).alias("receiver"), F.coalesce(part(2), part(3)).alias("called")).distinct())
    known = receivers(symbols)
    # Names of the method itself hide nothing of the class: fields are told by ``this.``.
    local = known.where("method IS NOT NULL").toDF("file", "_t", "method", "receiver", "simple")
    of_names = calls.join(local, ["file", "method", "receiver"]).where(F.col("type").eqNullSafe(F.col("_t"))).select("file", "type", "method", "called", "simple")
    of_fields = calls.join(known.where("method IS NULL").drop("method"), ["file", "type", "receiver"]).select("file", "type", "method", "called", "simple")
    of_self = calls.where("receiver = 'this' AND type IS NOT NULL").select("file", "type", "method", "called", F.col("type").alias("simple"))
    direct = calls.where("receiver IS NULL").select("file", "type", "method", "called", F.col("called").alias("simple"))
    wanted = of_names.union(of_fields).union(of_self).withColumn("bare", F.lit(False)).union(direct.withColumn("bare", F.lit(True)))
    declared = symbols.where("kind IN ('class', 'function')").select(F.col("name").alias("simple"), F.col("file").alias("at"), (F.col("kind") == "function").alias("bare")).distinct()
    wanted = checkpoint(wanted.join(declared.select("simple", "bare").distinct(), ["simple", "bare"], "left_semi"))
    names = wanted.select("file", "simple", "bare").distinct()
    imported = names.join(uses.withColumnRenamed("name", "simple"), ["file", "simple"]).join(declared.withColumnRenamed("at", "to_file"), ["simple", "bare", "to_file"], "left_semi").select("file", "simple", "bare", "to_file", F.lit(0).alias("tier"))
    own = names.join(declared, ["simple", "bare"]).where("file = at").select("file", "simple", "bare", F.col("at").alias("to_file"), F.lit(1).alias("tier"))
    anywhere = names.where("NOT bare").join(declared, ["simple", "bare"]).select("file", "simple", "bare", F.col("at").alias("to_file"), F.lit(2).alias("tier"))
    tried = imported.union(own).union(anywhere)
    best = tried.groupBy("file", "simple", "bare").agg(F.min("tier").alias("tier"))
    meant = tried.join(best, ["file", "simple", "bare", "tier"]).distinct()
    ways = meant.groupBy("file", "simple", "bare").agg(F.count("*").alias("ways"))
    has = symbols.where("kind = 'method'").select(F.col("file").alias("to_file"), F.col("type").alias("simple"), F.col("name").alias("called")).distinct()
    met = wanted.join(meant.join(ways, ["file", "simple", "bare"]), ["file", "simple", "bare"])
    methods = met.where("NOT bare").join(has, ["to_file", "simple", "called"], "left_semi")
    out = methods.unionByName(met.where("bare"))
    return out.select(F.col("file").alias("from_file"), F.col("type").alias("from_type"), F.col("method").alias("from_method"), "to_file", F.col("called").alias("to_method"), F.when(F.col("ways") == 1, "resolved").otherwise("inferred").alias("confidence")).distinct()
