"""Database source: declared objects, where each ends, and what its own lines do.

A file's words that open or close something (headers, IS, BEGIN, CASE, END, semicolons)
are walked once with a stack of open units. What lies between two of them belongs to the
innermost unit: a nested routine's lines aren't its outer one's, and lines after an END
are no longer the routine's. Statements are then matched in Spark, on each unit's lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import mentions, table_name

HIDDEN = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^']|'')*(?:'|\Z)", re.DOTALL)
NAME = r'[\w$#"]+(?:\.[\w$#"]+)*'
CREATE = rf"CREATE\s+(?:(?:OR\s+REPLACE|EDITIONABLE|NONEDITIONABLE|NO\s+FORCE|FORCE|PUBLIC|GLOBAL\s+TEMPORARY|MATERIALIZED|UNIQUE|BITMAP)\s+)*(PACKAGE\s+BODY|PACKAGE|PROCEDURE|FUNCTION|TRIGGER|VIEW|SEQUENCE|SYNONYM|INDEX)\s+(?:IF\s+NOT\s+EXISTS\s+)?({NAME})"
MARKS = re.compile(rf"\b{CREATE}|\bCREATE\b|\b(PROCEDURE|FUNCTION)\s+({NAME})|\b(BEGIN|CASE|DECLARE|IS|AS)\b|\bEND\b(?:\s+(IF|LOOP|CASE)\b)?|[;()]|^[ \t]*/[ \t]*$", re.IGNORECASE | re.MULTILINE)
#: Kinds that have a block; the others end at a semicolon.
BLOCKS = ("package body", "package", "procedure", "function", "trigger")

UNIT = "type string, name string, package string, line_no int, end_line int, header string, own array<struct<line_no:int,text:string,raw:string>>"


class Unit:
    """An open unit: in its ``head``, in its declarations (``told``), or in its ``body``, with
    so many blocks open."""

    def __init__(self, kind: str, name: str | None, package: str | None, line: int, start: int):
        self.kind, self.name, self.package, self.line, self.start = kind, name, package, line, start
        self.phase, self.depth, self.head_end, self.end_line = "head", 0, None, line
        self.own: list[tuple[int, int]] = []


def bare_text(text: str) -> str:
    """``text`` with comments and strings blanked, every place kept."""
    return HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def simple(name: str) -> str:
    return name.replace('"', "").upper()


def scan_units(text: str) -> list[Unit]:
    """The units of a file in order of their headers, and its anonymous blocks."""
    bare = bare_text(text)
    ends = [m.start() for m in re.finditer("\n", bare)]
    out: list[Unit] = []
    open_units: list[Unit] = []
    at, line, parens = 0, 1, 0

    def begin(kind: str, name: str | None, package: str | None, start: int) -> None:
        out.append(Unit(kind, name, package, line, start))
        open_units.append(out[-1])

    def close(end: int) -> None:
        u = open_units.pop()
        u.end_line, u.head_end = line, u.head_end or end

    for m in MARKS.finditer(bare):
        if open_units:
            open_units[-1].own.append((at, m.start()))
        at = m.start()
        while line <= len(ends) and ends[line - 1] < at:
            line += 1
        word = m.group().split()[0].upper() if m.group().strip() else "/"
        top = open_units[-1] if open_units else None
        if word == "CREATE" or word == "/":
            while open_units:
                close(at)
            parens = 0
            if m.group(1):
                kind, parts = re.sub(r"\s+", " ", m.group(1).lower()), simple(m.group(2)).split(".")
                begin(kind, parts[-1], parts[0] if len(parts) > 1 and kind in ("procedure", "function") else None, at)
        elif word in ("PROCEDURE", "FUNCTION"):
            if top and top.phase == "told":  # declared in a package or in another routine
                package = next((u.name for u in reversed(open_units) if u.kind.startswith("package")), None)
                begin(word.lower(), simple(m.group(4)).split(".")[-1], package, at)
                parens = 0
        elif word in ("(", ")"):
            parens += 1 if word == "(" else -1
        elif word == ";":
            if top and top.phase == "head" and parens <= 0:
                close(at)
        elif word in ("IS", "AS"):
            if top and top.phase == "head" and top.kind in BLOCKS and top.kind != "trigger" and parens <= 0:
                top.phase, top.head_end = "told", at
        elif word == "DECLARE":
            if not top or top.kind == "trigger" and top.phase == "head":
                if not top:
                    begin("block", None, None, at)
                open_units[-1].phase, open_units[-1].head_end = "told", at
        elif word == "BEGIN":
            if not top:
                begin("block", None, None, at)
                top = open_units[-1]
            if top.phase != "body":
                top.phase, top.depth, top.head_end = "body", 0, top.head_end or at
            top.depth += 1
        elif word == "CASE":
            if top and top.phase != "head":
                top.depth += 1
        elif top and (m.group(6) or "").upper() not in ("IF", "LOOP"):  # END, END CASE
            top.depth -= 1
            if top.phase != "head" and (top.depth < 0 or top.phase == "body" and top.depth == 0):
                close(at)
    line = len(ends) + 1
    if open_units:
        open_units[-1].own.append((at, len(bare)))
    while open_units:
        close(len(bare))
    return out


def units(files: DataFrame) -> DataFrame:
    """(file, type, name, package, line_no, end_line, header, own): the declared objects of
    (file, text), and what no object owns as ``block`` without a name. ``own`` has the pieces
    of a unit's lines that no inner unit has, without comments and strings (``text``) and
    with them (``raw``); ``header`` is all before its IS, AS or BEGIN. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bare = bare_text(text or "")
                for u in scan_units(text or ""):
                    own: dict[int, list[str]] = {}
                    for a, b in u.own:
                        first = bare.count("\n", u.start, a) + u.line
                        for k, (said, raw) in enumerate(zip(bare[a:b].split("\n"), text[a:b].split("\n"), strict=True)):
                            piece = own.setdefault(first + k, ["", ""])
                            piece[0], piece[1] = piece[0] + said, piece[1] + raw
                    rows.append((file, u.kind, u.name, u.package, u.line, u.end_line, bare[u.start : u.head_end], [{"line_no": n, "text": t, "raw": r} for n, (t, r) in own.items()]))
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string(), pa.list_(pa.struct([("line_no", pa.int32()), ("text", pa.string()), ("raw", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "type", "name", "package", "line_no", "end_line", "header", "own"])

    return files.select("file", "text").mapInArrow(run, f"file string, {UNIT}")


def _told(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("header", pattern, group), F.lit(""))


def object_facts(found: DataFrame) -> DataFrame:
    """(type, name, package, file, line_no, end_line, params, return_type, tables_read,
    tables_written, on_table, synonym_for) of ``units``. A DELETE reads and writes."""
    named = found.where("name IS NOT NULL")
    text = F.array_join(F.transform("own", lambda x: x["text"]), "\n")
    mine = F.when(F.col("type") == "trigger", F.regexp_replace(text, "(?is)^.*?\\b(declare|begin)\\b", "")).otherwise(text)
    said = named.withColumn("said", mentions(mine))  # a unit's lines say it all: nothing is joined
    params = F.trim(F.regexp_replace(_told("(?s)^[^(]*?\\b(?:procedure|PROCEDURE|function|FUNCTION)\\s+[\\w$#.\"]+\\s*\\((.*)\\)", 1), "\\s+", " "))
    routine = F.col("type").isin("procedure", "function")
    on = table_name(_told("(?is)\\bon\\s+([\\w$#.\"]+)"))
    named_as = lambda mode: F.array_sort(F.transform(F.filter("said", lambda x: x["mode"] == mode), lambda x: x["table_name"]))
    read = F.when(F.col("type") == "index", F.array(on)).otherwise(named_as("read"))
    return said.select(
        "type", "name", "package", "file", "line_no", "end_line", F.when(routine, params).alias("params"),
        F.when(F.col("type") == "function", F.upper(_told("(?is)\\breturn\\s+([\\w$#.%]+)[^()]*$"))).alias("return_type"),
        read.alias("tables_read"), named_as("write").alias("tables_written"), F.when(F.col("type") == "trigger", on).alias("on_table"),
        F.when(F.col("type") == "synonym", F.upper(F.regexp_replace(_told("(?i)\\bfor\\s+([\\w$#.\"]+)"), "\"", ""))).alias("synonym_for"))


def routine_calls(found: DataFrame) -> DataFrame:
    """(caller, routine, package, dynamic, file, line_no, statement): calls of ``PKG.PROC`` in the
    lines of ``units``, and dynamic statements with the begin of their text where it is
    written there."""
    call = "\\b([A-Za-z][\\w$#]*)\\.([A-Za-z][\\w$#]*)\\s*[(;]"
    lines = found.where("name IS NOT NULL").select(F.col("name").alias("caller"), "file", F.explode("own").alias("o")).select("caller", "file", "o.*")
    each = lines.select("caller", "file", "line_no", F.explode(F.regexp_extract_all(F.concat("text", F.lit(";")), F.lit(call), 0)).alias("s"))
    calls = each.select("caller", F.upper(F.regexp_extract("s", call, 2)).alias("routine"), F.upper(F.regexp_extract("s", call, 1)).alias("package"), F.lit(False).alias("dynamic"), "file", "line_no", F.lit(None).cast("string").alias("statement"))
    said = F.nullif(F.regexp_extract("raw", "(?i)\\bexecute\\s+immediate\\s+'([^'\\n]{0,40})", 1), F.lit(""))
    free = lines.where(F.col("text").rlike("(?i)\\bexecute\\s+immediate\\b")).select("caller", F.lit("?").alias("routine"), F.lit(None).cast("string").alias("package"), F.lit(True).alias("dynamic"), "file", "line_no", said.alias("statement"))
    return calls.unionByName(free)
