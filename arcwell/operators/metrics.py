"""Scores and aggregates over commits, files and modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import debt, difficulty, grade, half_up, offender


def churn(touches: DataFrame) -> DataFrame:
    """Per file of (file, author, day, added, deleted): totals, dates, main author."""
    by = touches.groupBy("file", "author").agg(F.count("*").alias("n"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.min("day").alias("first"), F.max("day").alias("last"))
    return by.groupBy("file").agg(
        F.sum("n").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.min("first").alias("first_day"), F.max("last").alias("last_day"),
        F.count("*").alias("authors"), F.min_by("author", F.struct(-F.col("n"), "author")).alias("main_author"), half_up(100.0 * F.max("n") / F.sum("n")).cast("long").alias("main_share"),
    )


def change_coupling(baskets: DataFrame, most: int = 40, least: int = 2, floor: float = 0.3, n: int | None = 200) -> DataFrame:
    """Pairs of items that change together: (a, b, together, degree). Baskets of 2 to
    ``most`` distinct items count; the degree is rounded before it is filtered."""
    b = baskets.select("basket", "item").distinct()
    size = b.groupBy("basket").agg(F.count("*").alias("k")).where(F.col("k").between(2, most))
    kept = b.join(size, "basket")
    pairs = kept.select("basket", F.col("item").alias("a")).join(kept.select("basket", F.col("item").alias("b")), "basket").where("a < b").groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    each = b.groupBy("item").agg(F.count("*").alias("k"))
    met = pairs.join(each.toDF("a", "ka"), "a").join(each.toDF("b", "kb"), "b")
    out = met.select("a", "b", "together", half_up(F.col("together") / F.least("ka", "kb"), 2).alias("degree")).where(F.col("degree") >= floor)
    out = out.orderBy(F.desc("degree"), F.desc("together"), "a", "b")
    return out.limit(n) if n else out


def bus_factor(shares: DataFrame, strict: bool) -> DataFrame:
    """Authors needed for more than half (``strict``) or half of a module's touches."""
    order = Window.partitionBy("module").orderBy(F.desc("touches"), "author")
    run = shares.withColumn("before", F.coalesce(F.sum("touches").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("touches").over(Window.partitionBy("module")))
    inside = (2 * F.col("before") <= F.col("total")) if strict else (2 * F.col("before") < F.col("total"))
    return run.groupBy("module").agg(F.sum(F.when(inside, 1).otherwise(0)).alias("bus_factor"), F.count("*").alias("authors"))


def ownership(shares: DataFrame, modules: DataFrame) -> DataFrame:
    """Owner, share, bus factor, onboarding hours and difficulty of each module, from
    (module, author, touches) and (module, files, complexity)."""
    top = shares.groupBy("module").agg(F.min_by("author", F.struct(-F.col("touches"), "author")).alias("owner"), F.max("touches").alias("most"), F.sum("touches").alias("total"))
    met = top.join(bus_factor(shares, strict=False), "module").join(modules, "module")
    hours = half_up((F.col("files") * 0.3 + F.col("complexity") * 1.5) * F.when(F.col("bus_factor") <= 1, 1.5).otherwise(1.0)).cast("long")
    return met.select("module", "owner", half_up(100.0 * F.col("most") / F.col("total")).cast("long").alias("share"), "authors", "bus_factor", hours.alias("hours")).withColumn("difficulty", difficulty(F.col("hours")))


def knowledge_risk(authors: DataFrame, files: DataFrame, floor: int = 8) -> DataFrame:
    """Files of a single author whose coupling and debt sum to ``floor`` or more."""
    met = authors.where("authors = 1").join(files, "file", "left")
    return met.select("file", "main_author", (F.coalesce("coupling_in", F.lit(0)) + F.coalesce("debt", F.lit(0))).alias("weight")).where(F.col("weight") >= floor)


def _max_normalised(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    top = df.agg(*[F.greatest(F.max(c), F.lit(1)).cast("double").alias("m_" + c) for c in weights])
    score = sum((w * F.col(c) / F.col("m_" + c) for c, w in weights.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(top)).withColumn("score", half_up(100 * score).cast("long")).drop(*["m_" + c for c in weights])


def risk_prediction(files: DataFrame, n: int | None = 50) -> DataFrame:
    """(file, commits, fixes, complexity, coupling) scored 0.4/0.2/0.2/0.2."""
    out = _max_normalised(files, {"commits": 0.4, "fixes": 0.2, "complexity": 0.2, "coupling": 0.2}).where("score > 0").orderBy(F.desc("score"), "file")
    return out.limit(n) if n else out


def hotspots(files: DataFrame) -> DataFrame:
    """round(100 * commits/max * complexity/max), positive."""
    top = files.agg(F.greatest(F.max("commits"), F.lit(1)).cast("double").alias("mc"), F.greatest(F.max("complexity"), F.lit(1)).cast("double").alias("mx"))
    s = half_up(100 * F.col("commits") / F.col("mc") * F.col("complexity") / F.col("mx")).cast("long")
    return files.crossJoin(F.broadcast(top)).select("file", "commits", "complexity", s.alias("score")).where("score > 0")


def file_metrics(files: DataFrame) -> DataFrame:
    """Adds debt and the hotspot flag to (complexity, cognitive, lines, coupling_in/out)."""
    d = debt(F.col("complexity"), F.col("cognitive"), F.col("lines"), F.col("coupling_out")).cast("long")
    return files.withColumn("debt", d).withColumn("hotspot", (F.col("complexity") > 15) & (F.col("coupling_in") > 3))


def module_metrics(files: DataFrame, shown: int = 5) -> DataFrame:
    """A row a module: whole-number averages (couplings to one place), maxima, sums, the most
    complex file and the first ``shown`` hotspots. max_nesting is 0 where files have none."""
    nesting = F.max("max_nesting") if "max_nesting" in files.columns else F.lit(0)
    out = files.groupBy("module").agg(
        F.count("*").alias("files"), half_up(F.avg("complexity")).cast("long").alias("avg_complexity"), F.max("complexity").cast("long").alias("max_complexity"),
        F.min_by("file", F.struct(-F.col("complexity"), "file")).alias("worst_file"), half_up(F.avg("cognitive")).cast("long").alias("avg_cognitive"), nesting.cast("long").alias("max_nesting"),
        F.sum("lines").alias("lines"), half_up(F.avg("coupling_in"), 1).alias("avg_coupling_in"), F.sum("debt").alias("debt"),
    )
    first = files.where("hotspot").withColumn("r", F.row_number().over(Window.partitionBy("module").orderBy("file"))).where(F.col("r") <= shown)
    first = first.groupBy("module").agg(F.array_sort(F.collect_list("file")).alias("hotspots"))
    return out.join(first, "module", "left").withColumn("hotspots", F.coalesce("hotspots", F.array().cast("array<string>")))


def project_totals(files: DataFrame, functions: DataFrame) -> DataFrame:
    """One row: debt, hotspots, and offending functions (cyclomatic, cognitive, max_nesting)."""
    one = files.agg(F.coalesce(F.sum("debt"), F.lit(0)).alias("debt"), F.count_if("hotspot").alias("hotspots"))
    bad = functions.agg(F.count_if(offender(F.col("cyclomatic"), F.col("cognitive"), F.col("max_nesting"))).alias("offenders"))
    return one.crossJoin(F.broadcast(bad))  # one row each


def complex_functions(functions: DataFrame, offenders: bool = False, n: int | None = None) -> DataFrame:
    """Functions, the most complex first."""
    out = functions.where(offender(F.col("cyclomatic"), F.col("cognitive"), F.col("max_nesting"))) if offenders else functions
    out = out.orderBy(F.desc("cyclomatic"), F.desc("cognitive"), "file", "name")
    return out.limit(n) if n else out


def counts_by(facts: DataFrame, *by: str) -> DataFrame:
    """Facts by language, level, pattern or type."""
    return facts.groupBy(*by).agg(F.count("*").alias("n"))


def churn_of_files(files: DataFrame, touched: DataFrame) -> DataFrame:
    """All of ``files`` with the commits and fixes of ``touched`` (file, commits, fixes), 0
    where it has none."""
    return files.join(touched, "file", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("commits", "fixes")})


def knowledge_order(modules: DataFrame) -> DataFrame:
    """(module, bus_factor, share): what hangs on the fewest people first."""
    return modules.orderBy("bus_factor", F.desc("share"), "module")


def token_statistics(calls: DataFrame) -> DataFrame:
    """(tool, calls, tokens, average, most) of (tool, tokens)."""
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), half_up(F.avg("tokens")).cast("long").alias("average"), F.max("tokens").alias("most"))


def module_descriptors(files: DataFrame) -> DataFrame:
    """(module, files, languages, tokens) of (module, language, size_bytes)."""
    return files.groupBy("module").agg(F.count("*").alias("files"), F.array_sort(F.collect_set("language")).alias("languages"), F.ceil(F.sum("size_bytes") / 4).alias("tokens"))


def trend(snapshots: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` snapshots (ts, score) in time order, scaled to 0 to 1 between their least
    and largest score (0.5 where these are equal)."""
    last = snapshots.orderBy(F.desc("ts")).limit(n)
    ends = last.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    level = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return last.crossJoin(F.broadcast(ends)).select("ts", "score", half_up(level, 4).alias("level")).orderBy("ts")


def roi(modules: DataFrame, rate: float = 100.0, hours_per_point: float = 0.5) -> DataFrame:
    """Hours, days and cost of each module's debt."""
    h = modules.where("debt > 0").select("module", "debt", half_up(F.col("debt") * hours_per_point, 1).alias("hours"))
    return rescale(h.withColumn("days", half_up(F.col("hours") / 8, 1)), rate)


def roi_files(files: DataFrame, rate: float = 100.0, hours_per_point: float = 0.5, n: int = 40) -> DataFrame:
    """Hours and cost of each file's debt, the most first."""
    h = files.where("debt > 0").select("file", "debt", half_up(F.col("debt") * hours_per_point, 1).alias("hours"))
    return rescale(h, rate).orderBy(F.desc("debt"), "file").limit(n)


def saved_hours(impacted: DataFrame, minutes: float = 5.0) -> DataFrame:
    """One row: hours saved by ``minutes`` a node of (impacted)."""
    return impacted.agg(half_up(F.coalesce(F.sum("impacted"), F.lit(0)) * minutes / 60, 1).alias("hours_saved"))


def rescale(costs: DataFrame, rate: float) -> DataFrame:
    """Costs at another rate, from the hours already rounded."""
    return costs.withColumn("cost", half_up(F.col("hours") * rate).cast("long"))


def health(scalars: DataFrame) -> DataFrame:
    """The score from one row of debt, risks, violations, dead, coupled, unresolved,
    edges, lines, files: six clamped penalties, rounded to one place."""
    lines, files = F.greatest(F.col("lines"), F.lit(1)) / 1000.0, F.greatest(F.col("files"), F.lit(1)).cast("double")

    def penalty(raw, cap: int):
        return half_up(F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(cap))), 1)

    parts = {
        "p_debt": penalty(F.col("debt") / lines / 2, 25), "p_risks": penalty(2 * F.col("risks") / lines, 25), "p_violations": penalty(2 * 100 * F.col("violations") / files, 15),
        "p_dead": penalty(100 * F.col("dead") / files, 10), "p_coupling": penalty(100 * F.col("coupled") / files, 15), "p_resolution": penalty(100 * F.col("unresolved") / F.greatest(F.col("edges"), F.lit(1)) / 10, 10),
    }
    out = scalars.select(*[v.alias(k) for k, v in parts.items()])
    out = out.withColumn("score", F.greatest(F.lit(0.0), half_up(100 - sum((F.col(k) for k in parts), F.lit(0.0)), 1)))
    return out.withColumn("grade", grade(F.col("score")))


# Weight of a risk by its level (fixed values).
RISK_WEIGHT = {"critical": 4.0, "high": 2.0, "medium": 0.5, "low": 0.1}
# Most points that a dimension can cost (fixed values).
HEALTH_MOST = {"debt": 25, "risks": 25, "violations": 15, "deadCode": 10, "coupling": 15, "resolution": 10}


def health_report(files: DataFrame, risks: DataFrame, violations: DataFrame, dead: DataFrame, edges: DataFrame) -> DataFrame:
    """(dimension, penalty, raw, most, score, grade): the health of an analysis, a row a
    dimension, from its facts: files (lines, debt, coupling_in, coupling_out), risks (level),
    violations and dead parts (a row each), edges (confidence).

    Risks weigh by level; nulls weigh nothing. ``raw`` is what is counted: debt a thousand
    lines, the risks' weight, numbers of violations, dead parts and files of more than 20
    neighbours, and the share of edges that aren't resolved. No files and no lines count as one.
    """
    one = lambda d, **sums: d.agg(*[F.coalesce(v, F.lit(0.0)).cast("double").alias(k) for k, v in sums.items()])
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in RISK_WEIGHT.items() for x in kv]), F.col("level"))
    # Each fact is one row; named values are put together by grouping.
    facts = [
        one(files, files=F.count("*"), lines=F.sum("lines"), debt=F.sum("debt"), coupled=F.count_if(F.col("coupling_in") + F.col("coupling_out") > 20)),
        one(risks, risks=F.sum(weight)), one(violations, violations=F.count("*")), one(dead, dead=F.count("*")),
        one(edges, edges=F.count("*"), loose=F.count_if(~F.col("confidence").eqNullSafe("resolved")))]
    told = None
    for f in facts:
        values = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in f.columns])).alias("x")).select("x.*")
        told = values if told is None else told.union(values)
    names = [c for f in facts for c in f.columns]
    row = told.agg(*[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in names])
    kloc, many = F.greatest(F.col("lines"), F.lit(1.0)) / 1000, F.greatest(F.col("files"), F.lit(1.0))
    share = F.when(F.col("edges") > 0, 100 * F.col("loose") / F.col("edges")).otherwise(0.0)
    costs = {
        "debt": (F.col("debt") / kloc, F.col("debt") / kloc / 2), "risks": (F.col("risks"), 2 * F.col("risks") / kloc), "violations": (F.col("violations"), 200 * F.col("violations") / many),
        "deadCode": (F.col("dead"), 100 * F.col("dead") / many), "coupling": (F.col("coupled"), 100 * F.col("coupled") / many), "resolution": (share, share / 10)}
    each = [F.struct(F.lit(k).alias("dimension"), half_up(F.least(F.greatest(cost, F.lit(0.0)), F.lit(float(HEALTH_MOST[k]))), 1).alias("penalty"), half_up(raw, 2).alias("raw"), F.lit(HEALTH_MOST[k]).alias("most")) for k, (raw, cost) in costs.items()]
    row = row.select(F.array(*each).alias("d"))
    lost = F.aggregate("d", F.lit(0.0), lambda a, x: a + x["penalty"])
    row = row.withColumn("score", F.greatest(F.lit(0.0), half_up(100 - lost, 1)))
    return row.select(F.explode("d").alias("d"), "score").select("d.*", "score", grade(F.col("score")).alias("grade"))


def start_here(ownership: DataFrame, n: int = 5) -> DataFrame:
    """(module, hours): the ``n`` modules of low difficulty that take longest to learn, of
    ``ownership``; where a newcomer begins."""
    return ownership.where("difficulty = 'low'").orderBy(F.desc("hours"), "module").limit(n).select("module", "hours")


def skills_overview(suggestions: DataFrame, predictions: DataFrame, out_of_scope: DataFrame, triage: DataFrame) -> DataFrame:
    """(part, n): how much of each there is, and the triage queue in all and by two states (state)."""
    count = lambda d, part: d.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    states = triage.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("ready-for-agent", "needs-triage")])
    told = states.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(f"`{c}`").alias("n")) for c in states.columns])).alias("x")).select("x.*")
    parts = [count(suggestions, "suggestions"), count(predictions, "predictions"), count(out_of_scope, "out-of-scope"), count(triage, "triage"), told]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
