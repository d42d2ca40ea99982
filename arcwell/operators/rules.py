"""Architecture rules: what a project forbids, by layer, module and path of both ends.

Rules are configuration, a bounded list; each becomes two predicates. Files, far fewer than
edges, are asked once which rules each end of theirs could break; an edge breaks what its
two files' lists have in common, so that no pattern is tried on an edge and no rule meets
every edge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import glob_pattern

#: Rules of a project at most: each is two predicates of one expression.
MOST_RULES = 1_000
SELECTORS = ("fromLayer", "toLayer", "fromModule", "toModule", "fromPath", "toPath")
SCHEMA = f"rules array<struct<id:string,severity:string,description:string,forbid:struct<{','.join(f'{s}:string' for s in SELECTORS)}>>>, outOfScope array<struct<id:string,decision:string,reason:string,date:string>>"


@dataclass
class Rule:
    """A rule of the given name; ``forbid`` has some of SELECTORS, all of which must fit."""

    id: str
    severity: str = "error"
    description: str = ""
    forbid: dict[str, str] = field(default_factory=dict)

    def fits(self, end: str) -> Column:
        """Whether a file (file, layer, module) could be this rule's ``from`` or ``to`` end. A
        module or a path may be a pattern; a layer is a name, in any case."""
        out = F.lit(True)
        if layer := self.forbid.get(f"{end}Layer"):
            out = out & (F.lower("layer") == layer.lower())
        if module := self.forbid.get(f"{end}Module"):
            out = out & F.col("module").rlike(glob_pattern(module))
        if path := self.forbid.get(f"{end}Path"):
            out = out & F.col("file").rlike(glob_pattern(path))
        return F.coalesce(out, F.lit(False))


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a rules file, in its order; those without a selector forbid nothing and are
    left out. A file that is no JSON has none."""
    d = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    rows = d.select(F.explode("rules").alias("r")).select("r.*").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    told = [Rule(r["id"], r["severity"] or "error", r["description"] or "", {k: v for k, v in (r["forbid"].asDict() if r["forbid"] else {}).items() if v}) for r in rows]
    return [r for r in told if r.forbid]


def rule_violations(edges: DataFrame, files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, from_file, to_file), different ones, of edges (from_file, to_file) and
    files (file, layer, module). An edge within one file breaks no rule; a file that ``files``
    lacks, or whose layer or module is null, fits no selector that asks for it."""
    rules = [r for r in rules if r.forbid]
    if not rules:
        return edges.where(F.lit(False)).select(F.lit("").alias("rule"), F.lit("").alias("severity"), "from_file", "to_file")

    def could(end: str) -> Column:
        return F.filter(F.array(*[F.when(r.fits(end), F.lit(i)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())

    own = edges.select("from_file", "to_file").where("from_file <> to_file").distinct()
    f = files.select("file", "layer", "module").dropDuplicates(["file"])
    starts = f.select(F.col("file").alias("from_file"), could("from").alias("a")).where(F.size("a") > 0)
    ends = f.select(F.col("file").alias("to_file"), could("to").alias("b")).where(F.size("b") > 0)
    broken = own.join(starts, "from_file").join(ends, "to_file").select("from_file", "to_file", F.explode(F.array_intersect("a", "b")).alias("i"))
    name, severity = (F.get(F.array(*[F.lit(getattr(r, c)) for r in rules]), F.col("i")) for c in ("id", "severity"))
    return broken.select(name.alias("rule"), severity.alias("severity"), "from_file", "to_file")
