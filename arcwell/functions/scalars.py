"""Scalar expressions shared by the operators. All are built-in JVM functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contract.
FRONTEND = ("tsx", "jsx", "vue", "html", "css", "scss", "less", "osw")
DATABASE = ("sql", "plsql", "pls", "pck", "pks", "pkb", "prc", "fnc", "trg", "pkg")
FRONTEND_FOLDERS = ("frontend", "front", "ui", "web", "webapp", "client", "pages", "components", "views")
FRONTEND_FOLDER_END = "(^|[-_.])(frontend|front|ui|web|client)$"
ROLE_SUFFIXES = (
    "Controller", "Service", "Repository", "Manager", "Handler", "Helper", "Utils", "Util", "Impl", "Facade", "Adapter", "Factory", "Provider", "Processor", "Builder", "Mapper", "Component",
    "Module", "Resolver", "Interceptor", "Guard", "Filter", "Validator", "Converter", "Transformer", "Listener", "Consumer", "Producer", "Publisher", "Subscriber", "Observer", "Dao", "Bo", "Vo",
    "Dto", "Entity", "Model", "Bean", "Page", "View", "Screen", "Widget", "Store", "Reducer", "Selector", "Action", "Saga", "Effect", "Hook", "Composable",
)


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded half towards +infinity (built-in ``round`` goes away from zero)."""
    k = 10.0**places
    return F.floor(x * k + 0.5) / k


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; 0 for a zero norm."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def file_layer(path: Column, ext: Column) -> Column:
    """database, frontend or backend of a file."""
    parts = F.split(F.lower(path), "/")
    front = F.exists(parts, lambda p: p.isin(*FRONTEND_FOLDERS) | p.rlike(FRONTEND_FOLDER_END))
    return F.when(F.lower(ext).isin(*DATABASE), "database").when(F.lower(ext).isin(*FRONTEND) | (F.lower(ext).isin("ts", "js", "json", "md") & front), "frontend").otherwise("backend")


def glob_pattern(glob: str) -> str:
    """An anchored regular expression: ``**`` crosses ``/``, ``*`` doesn't."""
    out = "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob))
    return f"^{out}$"


def offender(cyclomatic: Column, cognitive: Column, nesting: Column) -> Column:
    return (cyclomatic > 10) | (cognitive > 15) | (nesting > 4)


def debt(complexity: Column, cognitive: Column, lines: Column, coupling_out: Column) -> Column:
    def over(x: Column, limit: int, factor: int, most: int) -> Column:
        return F.when(x > limit, F.least(factor * (x - limit), F.lit(most))).otherwise(0)

    return over(complexity, 20, 2, 40) + over(cognitive, 15, 1, 20) + F.when(lines > 1500, 10).when(lines > 500, 3).otherwise(0) + over(coupling_out, 15, 1, 15)


def risk_label(coupling: Column, lines: Column) -> Column:
    return F.when((coupling > 50) | (lines > 1000), "critical").when((coupling > 20) | (lines > 500), "high").when((coupling > 10) | (lines > 300), "medium").when(coupling > 4, "low").otherwise("clean")


def spoken(name: Column) -> Column:
    """Camel case, dashes and underscores as spaces, lower case."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(apart, "[-_]", " ")))


def responsibility(path: Column, type_name: Column | None = None, module: Column | None = None) -> Column:
    """A label of at most 60 characters: the type's name, else the file's, without one role
    suffix; a label of one character gives way to the module's name, else the file's."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(.)\\.[^.]*$", "$1")
    name = base if type_name is None else F.coalesce(type_name, base)
    bare = F.trim(F.regexp_replace(name, f"(?i)({'|'.join(ROLE_SUFFIXES)})$", ""))
    label = spoken(F.when(bare != "", bare).otherwise(name))
    other = spoken(base if module is None else F.coalesce(module, base))
    return F.substring(F.when(F.length(label) > 1, label).otherwise(other), 1, 60)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("E")


def difficulty(hours: Column) -> Column:
    return F.when(hours > 40, "high").when(hours > 16, "medium").otherwise("low")


def name_score(name: Column, query: str) -> Column:
    """100 equal, 80 prefix, 60 contained, else 40 times the share of words contained."""
    q = query.lower()
    words = [w for w in q.split() if w]
    share = sum((F.when(F.contains(F.lower(name), F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / max(1, len(words))
    return F.when(F.lower(name) == q, 100.0).when(F.lower(name).startswith(q), 80.0).when(F.contains(F.lower(name), F.lit(q)), 60.0).otherwise(40.0 * share)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The messages whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in pairs]), lambda x: x.isNotNull())


def split_terms(text: Column) -> Column:
    """Lower-case terms of at least three letters, camel case split."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z]+"), lambda t: F.length(t) >= 3)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def project_id(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 12)


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("yearofweek"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def url_template(url: Column) -> Column:
    """Lower case without query, api prefix and outer slashes; parameters as ``*``."""
    bare = F.regexp_replace(F.lower(url), "[?#].*$", "")
    bare = F.regexp_replace(bare, "^https?://[^/]+", "")
    bare = F.regexp_replace(bare, "^/?api(/v[0-9]+)?(/|$)", "/")
    return F.regexp_replace(F.regexp_replace(bare, "\\{[^}/]*\\}|:[a-z_][a-z0-9_]*|\\$\\{[^}]*\\}", "*"), "^/+|/+$", "")


def sanitized(name: Column) -> Column:
    """An id: all but letters, digits and underscores to one underscore, at most 50."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_]", "_"), "_+", "_"), 1, 50)


def repository_slug(url: Column) -> Column:
    """owner/name of a remote in its ssh or https form; null for others."""
    return F.nullif(F.regexp_extract(F.trim(url), "^(?:https?://[^/]+/|ssh://[^/]+/|[^@/]+@[^:/]+:)([^/]+/[^/]+?)(?:\\.git)?/?$", 1), F.lit(""))


def days_since(day: Column, today: Column) -> Column:
    """Whole days, 0 for days to come."""
    return F.greatest(F.datediff(today, day), F.lit(0))


def path_segments(path: Column) -> Column:
    """Segments of a URL path: lower case, without query, trailing slash and api prefix."""
    bare = F.split(F.lower(F.regexp_replace(path, "/+$", "")), "\\?")[0]
    bare = F.regexp_replace(F.regexp_replace(bare, "^/api/v[0-9]+", ""), "^/api", "")
    return F.filter(F.split(bare, "/"), lambda p: p != "")


def route_segments(route: Column) -> Column:
    """The same of an endpoint's route, parameters as ``*``."""
    return path_segments(F.regexp_replace(route, "\\{[^}]+\\}|:[^/]+", "*"))


def domain_keyword(path: Column) -> Column:
    """What a file's name says of its domain: without extension and one role suffix."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.(java|ts|tsx|js|jsx|py|cs|kt)$", "")
    name = F.regexp_replace(name, "(?i)[-_](service|controller|resource|api|client|repository|repo|facade|handler|component|module)$", "")
    name = F.regexp_replace(name, "(?i)(Controller|Service|Resource|Api|Client|Repository|Facade|Handler|Component|Module)$", "")
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
