"""What a repository says of itself: roots, diffs, logs of fixes, stack, artifacts."""

from __future__ import annotations

import json
import re
from pathlib import Path
from urllib import request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FRONTEND_DIRS = "^(frontend|ui|web|client|app|webapp)$"
BACKEND_DIRS = "^(backend|api|server|service|services|core)$"
FIX_WORDS = "(?i)\\b(fix|bug|hotfix|corrige|conserta|patch|defect)\\b"
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "java": "Java", "kt": "Kotlin", "scala": "Scala", "py": "Python",
    "rb": "Ruby", "go": "Go", "rs": "Rust", "cs": "C#", "cpp": "C++", "c": "C", "php": "PHP", "swift": "Swift", "dart": "Dart", "sql": "SQL", "plsql": "PL/SQL", "pls": "PL/SQL", "pck": "PL/SQL",
    "pks": "PL/SQL", "pkb": "PL/SQL", "prc": "PL/SQL", "fnc": "PL/SQL", "trg": "PL/SQL", "pkg": "PL/SQL", "html": "HTML", "css": "CSS", "scss": "SCSS",
}
PACKAGES = {"react": "React", "vue": "Vue", "@angular/core": "Angular", "next": "Next.js", "nuxt": "Nuxt", "express": "Express", "fastify": "Fastify", "nestjs": "NestJS", "@nestjs/core": "NestJS", "electron": "Electron"}
MANAGERS = {"package-lock.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "pom.xml": "maven", "build.gradle": "gradle", "requirements.txt": "pip", "Cargo.toml": "cargo", "go.mod": "go modules"}
def _side(name: str) -> str | None:
    return next((side for side, pattern in (("front", FRONTEND_DIRS), ("back", BACKEND_DIRS)) if re.match(pattern, name, re.IGNORECASE)), None)


def find_scan_root(path: str) -> str:
    """Where a front end and a back end lie side by side and ``path`` is one of them, the folder
    of both; else, and where that folder can't be read, ``path``."""
    here = Path(path)
    try:
        sides = {_side(p.name) for p in here.parent.iterdir() if p.is_dir()}
    except OSError:
        return path
    return str(here.parent) if _side(here.name) and sides >= {"front", "back"} else path


def changed_names(spark: SparkSession, *paths: str) -> DataFrame:
    """(file): the different names in outputs of ``git diff --name-only`` (working tree, index,
    two branches) and ``git ls-files --others``, one a line."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("file")).where("file <> ''").distinct()


def fix_churn(commits: DataFrame, since: Column | None = None) -> DataFrame:
    """(file, commits, fixes, last_fix, last_fix_subject) of (sha, ts, subject, file); a commit
    whose subject has a word for a fix is one."""
    d = commits.where(F.col("ts") >= since) if since is not None else commits
    fix = F.col("subject").rlike(FIX_WORDS)
    last = F.max(F.when(fix, F.struct("ts", "sha", "subject")))
    return d.groupBy("file").agg(F.count("*").alias("commits"), F.count_if(fix).alias("fixes"), last.alias("l")).select("file", "commits", "fixes", F.col("l.sha").alias("last_fix"), F.col("l.subject").alias("last_fix_subject"))


def authorship(commits: DataFrame, since: Column | None = None) -> DataFrame:
    """(file, author, touches, last) of (author, ts, file)."""
    d = commits.where(F.col("ts") >= since) if since is not None else commits
    return d.groupBy("file", "author").agg(F.count("*").alias("touches"), F.max("ts").alias("last"))


def known_files(commits: DataFrame, files: DataFrame, most: int | None = 4_000) -> DataFrame:
    """Rows of the latest ``most`` commits (sha, ts) whose file still exists."""
    if most:
        latest = commits.groupBy("sha").agg(F.max("ts").alias("at")).orderBy(F.desc("at"), "sha").limit(most).select("sha")
        commits = commits.join(F.broadcast(latest), "sha", "left_semi")
    return commits.join(files.select("file"), "file", "left_semi")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON artifact, or None where it is absent or isn't JSON."""
    try:
        d = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        d.limit(1).collect()
        return d
    except Exception as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "MALFORMED", "Malformed", "FAILED_READ_FILE")):
            return None
        raise


def with_roles(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files with the first of their patterns as role (file, pattern)."""
    return files.drop("role").join(patterns.groupBy("file").agg(F.min("pattern").alias("role")), "file", "left")


def languages(files: DataFrame) -> DataFrame:
    """(language, n), the most common first, of (file)."""
    ext = F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)
    return files.select(name.alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


def stack(files: DataFrame) -> DataFrame:
    """(kind, name): frameworks and package managers of (file, text), from manifests and names."""
    def has(pattern: str) -> Column:
        return F.coalesce(F.bool_or(F.col("file").rlike(pattern)), F.lit(False))

    manifest = F.max(F.when(F.col("file") == "package.json", F.col("text")))
    names = F.array_union(*[F.coalesce(F.json_object_keys(F.get_json_object("manifest", f"$.{k}")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    one = files.agg(
        manifest.alias("manifest"), has("(pom\\.xml|\\.java$)").alias("jvm"), has("^pom\\.xml$").alias("maven"), has("^build\\.gradle(\\.kts)?$").alias("gradle"), has("(Controller|Service)").alias("spring"),
        has("\\.py$").alias("py"), has("^requirements\\.txt$").alias("pip"), has("django").alias("django"), has("(fastapi|flask)").alias("flask"), *[has("^" + re.escape(f) + "$").alias(f"m{i}") for i, f in enumerate(MANAGERS)])
    one = one.withColumn("names", names)
    found = [F.when(F.array_contains("names", k), F.lit(v)) for k, v in PACKAGES.items()]
    jvm, py = F.col("jvm"), F.col("py")
    found += [F.when(jvm & F.col("maven"), F.lit("Maven")), F.when(jvm & F.col("gradle"), F.lit("Gradle")), F.when(jvm & F.col("spring"), F.lit("Spring"))]
    found += [F.when(py & F.col("pip"), F.lit("Python")), F.when(py & F.col("django"), F.lit("Django")), F.when(py & F.col("flask"), F.lit("FastAPI/Flask"))]
    told = lambda kind, c: one.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.filter(F.array(*c), lambda x: x.isNotNull()))).alias("name"))
    return told("framework", found).unionByName(told("manager", [F.when(F.col(f"m{i}"), F.lit(v)) for i, v in enumerate(MANAGERS.values())]))


# -- Sinks ------------------------------------------------------------------------


def analysis_json(parts: dict[str, DataFrame], most: int = 1_000) -> DataFrame:
    """(json): one nested summary of small tables, ``most`` rows of each."""
    out = None
    for name, d in parts.items():
        rows = d.limit(most).agg(F.collect_list(F.struct(*d.columns)).alias(name))
        out = rows if out is None else out.crossJoin(rows)  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def markdown(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """A report: a table a section, ``most`` rows of each, with a note of what is left out."""
    out = [f"# {title}", ""]
    for name, d in sections.items():
        rows = d.limit(most + 1).collect()
        out += [f"## {name}", "", "| " + " | ".join(d.columns) + " |", "|" + " --- |" * len(d.columns)]
        out += ["| " + " | ".join(str("" if x is None else x).replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in rows[:most]]
        out += ["", *(["More rows are left out.", ""] if len(rows) > most else [])]
    return "\n".join(out)


def mermaid(pairs: DataFrame, most: int = 200) -> str:
    """A diagram of the heaviest pairs (a, b, weight)."""
    rows = pairs.orderBy(F.desc("weight"), "a", "b").limit(most).collect()
    ids = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in (r["a"], r["b"])}))}
    nodes = [f'  {i}["{n}"]'.replace('"', "#quot;").replace("[#quot;", '["').replace("#quot;]", '"]') for n, i in ids.items()]
    return "\n".join(["graph LR", *nodes, *[f"  {ids[r['a']]} -->|{r['weight']}| {ids[r['b']]}" for r in rows]])


def svg(pairs: DataFrame, most: int = 200) -> str:
    """The same as a picture: nodes on a circle, edges as wide as they weigh."""
    from html import escape
    from math import cos, log1p, pi, sin

    rows = pairs.orderBy(F.desc("weight"), "a", "b").limit(most).collect()
    names = sorted({x for r in rows for x in (r["a"], r["b"])})
    at = {n: (400 + 300 * cos(2 * pi * i / max(1, len(names))), 400 + 300 * sin(2 * pi * i / max(1, len(names)))) for i, n in enumerate(names)}
    lines = [f'<line x1="{at[r["a"]][0]:.1f}" y1="{at[r["a"]][1]:.1f}" x2="{at[r["b"]][0]:.1f}" y2="{at[r["b"]][1]:.1f}" stroke="#888" stroke-width="{log1p(r["weight"]):.2f}"/>' for r in rows]
    dots = [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="6"/><text x="{x + 8:.1f}" y="{y:.1f}" font-size="11">{escape(str(n))}</text>' for n, (x, y) in at.items()]
    return '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 900 800">' + "".join(lines + dots) + "</svg>"


def html_page(title: str, sections: dict[str, DataFrame], picture: str = "", most: int = 50) -> str:
    """A report as one page: a picture, and a table a section."""
    from html import escape

    out = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>", picture]
    for name, d in sections.items():
        cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{escape(str('' if x is None else x))}</{tag}>" for x in r) + "</tr>"
        out.append(f"<h2>{escape(name)}</h2><table>{cells('th', d.columns)}{''.join(cells('td', r) for r in d.limit(most).collect())}</table>")
    return "".join(out)


def webhook(url: str, most: int = 100, timeout: float = 8.0):
    """A sink for ``foreachBatch``: posts a batch's rows as JSON, at most ``most``, and never
    fails the stream."""
    def send(batch: DataFrame, number: int) -> None:
        rows = [r.asDict(True) for r in batch.limit(most).collect()]
        if rows:
            told = request.Request(url, json.dumps({"batch": number, "events": rows}, default=str).encode(), {"Content-Type": "application/json"})
            try:
                request.urlopen(told, timeout=timeout).close()
            except OSError:
                pass

    return send


def replace_index(tables: dict[str, DataFrame], root: str, spark: SparkSession) -> None:
    """Rebuild an index beside the old one, and put it in its place when it is whole."""
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(f"{root}.next"), True)  # what a failed run left
    for name, d in tables.items():
        d.write.mode("overwrite").parquet(f"{root}.next/{name}")
    if fs.exists(path(root)):
        fs.delete(path(f"{root}.old"), True)
        fs.rename(path(root), path(f"{root}.old"))
    fs.rename(path(f"{root}.next"), path(root))
    fs.delete(path(f"{root}.old"), True)

