"""Deltas, gates, rules, triage, memory and dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import glob_pattern, half_up, iso_week
from .ordered import with_position, with_previous

# States of the triage machine and where each may go (fixed values).
MOVES = {
    "needs-triage": ("needs-info", "ready-for-agent", "ready-for-human", "wontfix"),
    "needs-info": ("needs-triage",),
    "ready-for-agent": ("needs-triage", "done"),
    "ready-for-human": ("needs-triage", "done"),
    "wontfix": ("needs-triage",),
    "done": (),
}


def new_rows(head: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``head`` whose key ``base`` lacks (null keys are equal)."""
    return head.join(base.select(*key).distinct(), [head[k].eqNullSafe(base[k]) for k in key], "left_anti")


def set_delta(head: DataFrame, base: DataFrame) -> DataFrame:
    """added and removed items of two one-column tables."""
    return head.subtract(base).withColumn("change", F.lit("added")).unionByName(base.subtract(head).withColumn("change", F.lit("removed")))


def arch_rules(edges: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, severity, from_id, to_id) of edges whose ends both fit a rule's globs.
    The rule list is given by the user and small: it becomes one predicate each."""
    fits = [F.when(F.col("from_id").rlike(glob_pattern(a)) & F.col("to_id").rlike(glob_pattern(b)), F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity"))) for name, sev, a, b in rules]
    return edges.select("from_id", "to_id", F.explode(F.filter(F.array(*fits), lambda r: r.isNotNull())).alias("r")).select("r.rule", "r.severity", "from_id", "to_id").distinct()


def gates(one: DataFrame, limits: dict[str, Column]) -> DataFrame:
    """(gate, failed) for one row of counts."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(v, F.lit(False)).alias("failed")) for k, v in limits.items()])).alias("g")).select("g.*")


def triage_moves(requests: DataFrame) -> DataFrame:
    """Requests (id, state, wanted) with whether the move is allowed."""
    moves = F.broadcast(requests.sparkSession.createDataFrame([(a, b) for a, to in MOVES.items() for b in to], "state string, wanted string").withColumn("ok", F.lit(True)))
    return requests.join(moves, ["state", "wanted"], "left").select("id", "state", "wanted", F.coalesce("ok", F.lit(False)).alias("allowed"))


def triage_sync(queue: DataFrame, candidates: DataFrame) -> DataFrame:
    """The queue and those candidates whose id it lacks, as needs-triage."""
    new = candidates.dropDuplicates(["id"]).join(queue.select("id"), "id", "left_anti")
    return queue.select("id", "state").unionByName(new.select("id", F.lit("needs-triage").alias("state")))


def memory_latest(entries: DataFrame, bound: int | None = None) -> DataFrame:
    """The latest entry by entity, kind and the first 80 characters of its summary, whatever
    their case. One entry a key survives the map side."""
    row = F.struct(*[F.col(c) for c in entries.columns])
    key = ("entity", "kind", F.substring(F.lower("summary"), 1, 80).alias("said"))
    out = entries.groupBy(*key).agg(F.max_by(row, F.struct("ts", "id")).alias("row")).select("row.*")
    return out.orderBy(F.desc("ts"), F.desc("id")).limit(bound) if bound else out


def contradictions(entries: DataFrame) -> DataFrame:
    """Entities that both worked and failed."""
    return entries.groupBy("entity").agg(F.bool_or(F.col("result") == "worked").alias("w"), F.bool_or(F.col("result") == "failed").alias("f")).where("w AND f").select("entity")


def recall(entries: DataFrame, entity: str) -> DataFrame:
    """Entries where either name contains the other."""
    return entries.where(F.contains(F.lower("entity"), F.lit(entity.lower())) | F.contains(F.lit(entity.lower()), F.lower("entity")))


def by_reference(entries: DataFrame, kind: str, number: int) -> DataFrame:
    return entries.where(F.exists("links", lambda x: (x["kind"] == kind) & (x["number"] == number)))


def archive_weeks(entries: DataFrame, keep: int) -> DataFrame:
    """Entries beyond the latest ``keep``, counted by ISO week."""
    placed = with_position(entries.select("ts", "id"), [F.desc("ts"), F.desc("id")], "r")
    return placed.where(F.col("r") > keep).groupBy(iso_week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))


def dispatch(events: DataFrame, cap: int = 5, failures: int = 2) -> DataFrame:
    """The decision for each (id, ts, entity, trigger, failed_before), in order of ts and id:
    a key that was dispatched before on that day is a duplicate; then the daily cap; then
    the failure breaker. Only dispatched events make duplicates and use the cap.

    The first event of a key that the breaker lets through is dispatched unless the cap is
    reached: one row a key and day is ranked, and all events are held against these.
    """
    e = events.withColumn("day", F.to_date("ts")).withColumn("at", F.struct("ts", "id"))
    firsts = e.where(F.col("failed_before") < failures).groupBy("day", "entity", "trigger").agg(F.min("at").alias("first"))
    sent = firsts.withColumn("turn", F.row_number().over(Window.partitionBy("day").orderBy("first"))).where(F.col("turn") <= cap)
    last = sent.where(F.col("turn") == cap).select("day", F.col("first").alias("last"))
    keys = [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("day", "entity", "trigger")]
    met = e.alias("e").join(sent.drop("turn").alias("s"), keys, "left").select("e.*", "s.first").join(last, "day", "left")
    said = F.when(F.col("at") > F.col("first"), "duplicate").when(F.col("at") > F.col("last") if cap else F.lit(True), "capped").when(F.col("failed_before") >= failures, "blocked").otherwise("dispatched")
    return met.select("id", "day", said.alias("decision"))


def portfolio(projects: DataFrame) -> DataFrame:
    """Worst health first; unknown health last, as 101."""
    return with_position(projects, [F.coalesce("health", F.lit(101.0)).asc(), F.col("project").asc()])


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` (ts, score) with the change since the one before."""
    return with_previous(snapshots, ["ts"], "score", "_was").withColumn("delta", F.col("score") - F.col("_was")).drop("_was")


def self_delta(snapshots: DataFrame) -> DataFrame:
    """health-up and health-down events with their severity."""
    d = snapshot_deltas(snapshots).where("delta <> 0")
    sev = F.when(F.col("delta") <= -10, "critical").when(F.col("delta") < 0, "warn").otherwise("info")
    return d.select("ts", F.when(F.col("delta") < 0, "health-down").otherwise("health-up").alias("type"), sev.alias("severity"), F.abs("delta").alias("magnitude"))


def analysis_delta(before: dict[str, DataFrame], now: dict[str, DataFrame]) -> DataFrame:
    """(type, severity, entity, detail): what changed between two analyses, each of health
    (score, one row), risks (file, title, level), violations (rule, severity, from_file,
    to_file) and modules (module). Rows that repeat are one; a health that rounds to the
    same tenth, or is unknown once, is no change; where ``before`` is empty altogether
    everything is new."""
    score = now["health"].select(F.lit(1).alias("k"), "score").union(before["health"].select(F.lit(0), "score")).agg(*[F.max(F.when(F.col("k") == k, F.col("score"))).alias(c) for k, c in ((1, "new"), (0, "old"))])
    step = score.withColumn("d", half_up(F.col("new") - F.col("old"), 1)).where("d <> 0")
    down = F.col("d") < 0
    health = step.select(
        F.when(down, "health-down").otherwise("health-up").alias("type"), F.when(F.col("d") <= -10, "critical").when(down, "warn").otherwise("info").alias("severity"),
        F.lit(None).cast("string").alias("entity"), F.format_string("%.1f to %.1f", "old", "new").alias("detail"))
    level = F.when(F.col("level") == "critical", "critical").when(F.col("level") == "high", "warn").otherwise("info")
    risks = new_rows(now["risks"].select("file", "title", "level").distinct(), before["risks"], ["file", "title", "level"])
    risks = risks.select(F.lit("risk-new").alias("type"), level.alias("severity"), F.concat(F.lit("file:"), "file").alias("entity"), F.concat_ws(" ", "level", "title").alias("detail"))
    broken = new_rows(now["violations"].select("rule", "severity", "from_file", "to_file").distinct(), before["violations"], ["rule", "from_file", "to_file"])
    broken = broken.select(F.lit("rule-violation").alias("type"), F.when(F.col("severity") == "error", "critical").otherwise("warn").alias("severity"), F.concat(F.lit("file:"), "from_file").alias("entity"), F.concat_ws(" ", "rule", "to_file").alias("detail"))
    moved = set_delta(now["modules"].select("module"), before["modules"].select("module"))
    moved = moved.select(F.concat(F.lit("module-"), "change").alias("type"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("entity"), F.col("module").alias("detail"))
    return health.unionByName(risks).unionByName(broken).unionByName(moved)


def prediction_feedback(before: DataFrame, now: DataFrame, floor: int = 60) -> DataFrame:
    """Predictions of ``floor`` or more whose files had more fixes since."""
    b = before.where(F.col("score") >= floor).select("file", F.col("fixes").alias("was"))
    return b.join(now.select("file", "fixes"), "file").where("fixes > was").select("file", "was", "fixes")


def reviewers(changed: DataFrame, owners: DataFrame) -> DataFrame:
    """Owners of the changed files with their files."""
    return changed.join(owners, "file").groupBy("owner").agg(F.count("*").alias("files"))
