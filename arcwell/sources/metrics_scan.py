"""Function metrics from a small tokenizer, for files in Java, TypeScript and JavaScript.

No parser library is at hand, so a scanner follows statements: what it can't follow (a
declaration without a body) it leaves out. It runs in Arrow batches, a file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("java", "ts", "tsx", "js", "jsx")
SCHEMA = "file string, name string, line_no int, cyclomatic int, cognitive int, max_nesting int"
_BLANK = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|&&|\|\||\?\?|\?\.|=>|->|\S")
_OPEN = {"(": ")", "{": "}", "[": "]"}
_BRANCH = ("if", "for", "while", "catch")
_HEADS = (*_BRANCH, "switch", "do", "try", "else", "finally", "return", "throw")


class Scan:
    def __init__(self, text: str, java: bool = False):
        self.java = java
        bare = _BLANK.sub(lambda m: '""' + "\n" * m[0].count("\n"), text)
        found = list(_TOKEN.finditer(bare))
        self.t = [m[0] for m in found]
        self.at = [m.start() for m in found]
        self.bare = bare
        self.close: dict[int, int] = {}
        held: list[int] = []
        for i, w in enumerate(self.t):
            if w in _OPEN:
                held.append(i)
            elif held and w == _OPEN[self.t[held[-1]]]:
                self.close[held.pop()] = i

    def word(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def functions(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(name, line, cyclomatic, cognitive, nesting) of functions outside others."""
        i = 0
        while i < len(self.t):
            told = self.header(i)
            if not told:
                i += 1
                continue
            name, body = told
            self.cyclomatic, self.cognitive, self.deepest = 1, 0, 0
            end = self.block(body, 0) if self.word(body) == "{" else self.stretch(body, 0, (";", ",", ")"))
            yield name, self.bare.count("\n", 0, self.at[i]) + 1, self.cyclomatic, self.cognitive, self.deepest
            i = max(end, i + 1)

    def header(self, i: int) -> tuple[str, int] | None:
        """Name and first token of the body of a function whose header begins here."""
        w = self.word(i)
        if w == "(" or self.word(i + 1) == "=>":
            after = self.after_type(self.close.get(i, -2) + 1) if w == "(" else i + 1
            if self.word(after) == "=>" and after > 0:
                k = i - 1 - (self.word(i - 1) == "async")
                named = self.word(k) in ("=", ":") and re.match(r"[A-Za-z_$]", self.word(k - 1))
                return (self.word(k - 1) if named else "(anonymous)"), after + 1
            return None
        if not re.match(r"[A-Za-z_$]", w) or w in _HEADS or w in ("new", "super", "this", "function") and w != "function" or self.word(i - 1) in (".", "new", "@", "function"):
            return None
        k = i + 1
        if w == "function":
            k += self.word(k) == "*"
            name = self.word(k) if self.word(k) != "(" else "(anonymous)"
            k += self.word(k) != "("
        else:
            name = w
        if self.word(k) != "(" or k not in self.close:
            return None
        after = self.close[k] + 1
        if self.word(after) == "throws":
            while self.word(after) not in ("{", ";", ""):
                after += 1
        after = self.after_type(after)
        return (name, after) if self.word(after) == "{" else None

    def after_type(self, i: int) -> int:
        """Past the ``: type`` of a result, if there is one."""
        if self.word(i) != ":":
            return i
        i += 1
        while re.match(r"[\w$\"]", self.word(i)) or self.word(i) in ("<", ">", ".", "[", "]", "|", ","):
            i += 1
        return i

    def decide(self, depth: int) -> int:
        self.cyclomatic += 1
        self.cognitive += 1 + depth
        self.deepest = max(self.deepest, depth + 1)
        return depth + 1

    def block(self, i: int, depth: int) -> int:
        end, i, inner = self.close.get(i, len(self.t)), i + 1, depth
        while i < end:
            # In Java every label is a decision beside its statements, ``default`` too; in
            # scripts a case holds its statements and ``default`` is none.
            if self.word(i) == "case":
                deeper = self.decide(depth)
                inner = depth if self.java else deeper
                i = self.stretch(i + 1, deeper, (":", "->"))
            elif self.word(i) == "default" and self.word(i + 1) in (":", "->"):
                if self.java:
                    self.decide(depth)
                i, inner = i + 2, depth
            else:
                i = max(self.statement(i, inner), i + 1)
        return end + 1

    def statement(self, i: int, depth: int) -> int:
        w = self.word(i)
        if w == "{":
            return self.block(i, depth)
        if w in _BRANCH or w == "switch":
            inner = depth if w == "switch" else self.decide(depth)
            i += 1 + (self.word(i + 1) == "await")
            if self.word(i) == "(":
                i = self.stretch(i + 1, inner, (")",))
            i = self.statement(i, inner)
            return self.statement(i + 1, inner) if w == "if" and self.word(i) == "else" else i
        if w in ("else", "try", "finally"):
            return self.statement(i + 1, depth)
        if w == "do":
            i = self.statement(i + 1, self.decide(depth))
            return self.stretch(i + 1, depth, (";",)) if self.word(i) == "while" else i
        return self.stretch(i + (w in ("return", "throw")), depth, (";",))

    def stretch(self, i: int, depth: int, stops: tuple[str, ...]) -> int:
        """Past an expression: to a stop, a closing bracket, or the next statement."""
        begun = i
        while i < len(self.t):
            w = self.t[i]
            if w in stops:
                return i + 1
            if w in (")", "]", "}") or w in _HEADS and i > begun and self.word(i - 1) not in (".", "=>"):
                return i
            if w == "{":
                i = self.block(i, depth)
                continue
            if w in ("(", "["):
                i = self.stretch(i + 1, depth, (_OPEN[w],))
                continue
            if w in ("&&", "||"):
                self.cyclomatic += 1
                self.cognitive += 1
            elif w == "?" and self.word(i + 1) not in (":", ")", ",", ";", "=", ">", "&", ""):
                self.decide(depth)
            i += 1
        return i


def function_metrics(files: DataFrame) -> DataFrame:
    """(file, name, line_no, cyclomatic, cognitive, max_nesting) of the outermost
    functions; callbacks count within theirs. A decision costs 1 and its nesting."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *x) for f, t in zip(batch["file"], batch["text"], strict=True) for x in Scan(t or "", f.lower().endswith(".java")).functions()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    ext = F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1))
    return files.where(ext.isin(*LANGUAGES)).select("file", "text").mapInPandas(run, SCHEMA)


def file_function_metrics(functions: DataFrame) -> DataFrame:
    """Sums and the worst function of each file."""
    return functions.groupBy("file").agg(
        F.sum("cyclomatic").alias("cyclomatic"), F.sum("cognitive").alias("cognitive"), F.max("max_nesting").alias("max_nesting"), F.count("*").alias("functions"),
        F.min_by("name", F.struct(-F.col("cyclomatic"), "line_no")).alias("worst"),
    )
