"""Comparing two analyses: what a change brings, its gates, questions and suggestions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .govern import new_rows

#: Thresholds of the deepening candidates: our own, the contract names none.
THIN_LINES, MANY_COUPLINGS, GOD_LINES, GOD_COMPLEXITY = 40, 20, 1500, 50


def new_risks(head: DataFrame, base: DataFrame) -> DataFrame:
    return new_rows(head, base, ["file", "title", "level"])


def new_violations(head: DataFrame, base: DataFrame) -> DataFrame:
    return new_rows(head, base, ["type", "from_id", "to_id"])


def new_rule_violations(head: DataFrame, base: DataFrame) -> DataFrame:
    return new_rows(head, base, ["rule", "from_id", "to_id"])


def risk_flags(changed: DataFrame, predictions: DataFrame, floor: int = 50) -> DataFrame:
    """Changed files (file) whose predicted risk is ``floor`` or more."""
    return predictions.where(F.col("score") >= floor).join(changed.select("file").distinct(), "file", "left_semi")


def others_affected(affected: DataFrame, changed: DataFrame) -> DataFrame:
    """Affected nodes (id) but the changed files (file) themselves."""
    return affected.join(changed.select(F.concat(F.lit("file:"), "file").alias("id")), "id", "left_anti")


def review_totals(impacts: DataFrame) -> DataFrame:
    """One row of (file, id): changed files with an impact, their affected nodes, and how many
    different ones these are."""
    return impacts.agg(F.count_distinct("file").alias("files"), F.count("*").alias("affected"), F.count_distinct("id").alias("distinct_affected"))


def reopened(changed: DataFrame, decisions: list[tuple[str, str]]) -> DataFrame:
    """(id, decision, file) of recorded decisions (id, text) that a changed file's bare name is
    in. The list is the user's own and small."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split("file", "/"), -1)), "\\.\\w+$", "")
    told = [F.struct(F.lit(i).alias("id"), F.lit(d).alias("decision")) for i, d in decisions]
    if not told:
        return changed.select(F.lit("").alias("id"), F.lit("").alias("decision"), "file").where(F.lit(False))
    hit = F.filter(F.array(*told), lambda d: F.contains(F.lower(d["decision"]), stem))
    return changed.where(stem != "").select("file", F.explode(hit).alias("d")).select("d.id", "d.decision", "file")


def review_questions(edges: DataFrame, changed: DataFrame, n: int = 3) -> DataFrame:
    """(file, question): for changed files with a database dependency, their first."""
    data = edges.where(F.col("to_kind").isin("plsql", "table", "column")).join(changed.select(F.concat(F.lit("file:"), "file").alias("from_id")), "from_id", "left_semi")
    first = data.groupBy("from_id").agg(F.min(F.struct("to_id", "to_kind")).alias("t"))
    name = F.regexp_replace("t.to_id", "^[a-z]+:", "")
    said = F.when(F.col("t.to_kind") == "plsql", F.concat(F.lit("Are the parameters and effects of "), name, F.lit(" still those that it calls?")))
    said = said.otherwise(F.concat(F.lit("Are writes to the "), F.col("t.to_kind"), F.lit(" "), name, F.lit(" and its triggers still valid?")))
    return first.select(F.regexp_replace("from_id", "^file:", "").alias("file"), said.alias("question")).orderBy("file").limit(n)


def review_gates(risks: DataFrame, violations: DataFrame, rules: DataFrame, health_delta: float | None, spec: str) -> DataFrame:
    """(gate, failed, found) of a list as ``new-high-risks,new-violations,new-rule-violations,
    health-drop:5``; gates that aren't known are left out. No health, no drop."""
    spark = risks.sparkSession
    out = []
    for gate in [g.strip() for g in spec.split(",") if g.strip()]:
        name, _, limit = gate.partition(":")
        if name == "new-high-risks":
            found = risks.where(F.col("level").isin("critical", "high")).count()
        elif name == "new-violations":
            found = violations.count()
        elif name == "new-rule-violations":
            found = rules.where("severity = 'error'").count()
        elif name == "health-drop":
            try:
                found = int(health_delta is not None and health_delta < -float(limit))
            except ValueError:
                continue
        else:
            continue
        out.append((gate, found > 0, found))
    return spark.createDataFrame(out, "gate string, failed boolean, found long")


def deepening(files: DataFrame, cycles: DataFrame) -> DataFrame:
    """(file, reason) of (file, lines, complexity, coupling_in, coupling_out) and files in a
    cycle (file): pass-throughs, high coupling, god modules, circles."""
    thin = (F.col("lines") < THIN_LINES) & (F.col("coupling_in") >= 1) & (F.col("coupling_out") == 1)
    reasons = F.array(
        F.when(thin, "pass-through"), F.when(F.col("coupling_in") + F.col("coupling_out") > MANY_COUPLINGS, "high-coupling"), F.when((F.col("lines") > GOD_LINES) | (F.col("complexity") > GOD_COMPLEXITY), "god-module"))
    own = files.select("file", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))
    return own.unionByName(cycles.select("file", F.lit("circular").alias("reason")).distinct())


def ingest_meetings(meetings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memory entries (entity, kind, summary, detail, source) of the decisions that name an
    entity, and suggestions (id, decision, reason, day) of those out of scope, from
    (id, title, ts, decisions: array of (id, decision_type, summary, rationale, entity,
    owner, due))."""
    d = meetings.select("id", "title", "ts", F.explode("decisions").alias("d"))
    out = F.coalesce(F.col("d.decision_type") == "out-of-scope", F.lit(False))
    name = F.regexp_replace(F.concat_ws("-", F.lit("meeting"), "id", "d.id"), "[^a-zA-Z0-9-]", "-")
    asked = d.where(out).select(name.alias("id"), F.col("d.summary").alias("decision"), F.coalesce("d.rationale", F.concat(F.lit("Recorded in "), "title")).alias("reason"), F.to_date("ts").alias("day"))
    more = F.nullif(F.concat_ws(" · ", "d.rationale", F.concat(F.lit("owner: "), "d.owner"), F.concat(F.lit("due: "), "d.due")), F.lit(""))
    kept = d.where(~out & (F.coalesce("d.entity", F.lit("")) != "")).select(F.col("d.entity").alias("entity"), F.lit("decision").alias("kind"), F.col("d.summary").alias("summary"), more.alias("detail"), F.concat(F.lit("meeting:"), F.col("id").cast("string")).alias("source"))
    return kept, asked


def feedback(before: DataFrame, now: DataFrame, new: DataFrame, seen: DataFrame, floor: int = 60) -> DataFrame:
    """Predictions (file, score, fixes) of ``floor`` or more that came true: more fixes since,
    or a new risk (file), and not told before (file)."""
    b = before.where(F.col("score") >= floor).select("file", "score", F.col("fixes").alias("was"))
    met = b.join(now.select("file", F.col("fixes").alias("now")), "file", "left").join(new.select("file", F.lit(True).alias("risk")).distinct(), "file", "left")
    grown = F.coalesce(F.col("now") > F.col("was"), F.lit(False))
    return met.where(grown | F.col("risk").isNotNull()).join(seen.select("file"), "file", "left_anti").select("file", "score", F.when(grown, "fixes").otherwise("risk").alias("reason"))


def hit_rates(confirmed: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: the share of predictions that came true, and the contract's own figure, which
    counts only confirmed ones and so is 1 or 0."""
    n, k = predicted.agg(F.count("*").alias("predicted")), confirmed.agg(F.count("*").alias("confirmed"))
    rate = F.coalesce(F.try_divide(F.col("confirmed").cast("double"), "predicted"), F.lit(0.0))
    return n.crossJoin(k).select("predicted", "confirmed", rate.alias("hit_rate"), F.when(F.col("confirmed") > 0, 1.0).otherwise(0.0).alias("hit_rate_ref"))  # one row each


def dispatch_chain(rows: list[dict], find: Callable, create: Callable, change: Callable, assign: Callable) -> list[dict]:
    """Outcomes of dispatched events, for ``foreachBatch``: an open issue of the title is used
    again or made; then a change for it, then its assignee; a failing step leaves the issue
    alone. The four host calls are the caller's; each outcome is a row of the log."""
    log = []
    for row in rows:
        try:
            issue = find(row["title"])
            status, issue = ("reused", issue) if issue is not None else ("created", create(row))
        except Exception as e:
            log.append({**row, "issue": None, "status": "failed", "detail": str(e)})
            continue
        detail = ""
        try:
            assign(issue, change(issue, row))
            status += "+change"
        except Exception as e:
            status, detail = status + "+issue-only", str(e)
        log.append({**row, "issue": issue, "status": status, "detail": detail})
    return log
