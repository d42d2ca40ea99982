"""Endpoints and HTTP calls, whose statements may take several lines.

A file is asked once whether it has a marker at all; then each line with one gets the
statement that begins there, as far as its parentheses go. All of that happens inside a
file's row, without a shuffle; only the few marked lines of files with classes meet a
window for their class's base path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a statement at most.
STATEMENT_LINES = 12
# Extensions and names (fixed values).
CALLER_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs")
ENDPOINT_EXTENSIONS = ("java", "kt", "ts", "js", "py")
ENDPOINT_PATHS = "(?i)controller|route|handler|resource|endpoint|api|servlet|web"
VERB = "Get|Post|Put|Patch|Delete"
CLIENTS = "axios|https?|httpClient|\\$http|request|superagent|ky|got|fetch"


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, "\\.([^./]+)$", 1))


def balance(line: Column) -> Column:
    """Parentheses that a line opens less those it closes, without its strings and comment."""
    bare = F.regexp_replace(F.regexp_replace(line, "'[^']*'|\"[^\"]*\"|`[^`]*`", ""), "//.*$", "")
    return F.length(F.regexp_replace(bare, "[^(]", "")) - F.length(F.regexp_replace(bare, "[^)]", ""))


def marked(files: DataFrame, marker: str) -> DataFrame:
    """(file, line_no, line, said, before, after, near, ahead): each line of (file, text) that
    ``marker`` fits and that is no comment; the statement that begins on it, up to
    STATEMENT_LINES lines; the two lines before and after it; it and three more; and the first line after the
    statement that is neither empty nor an annotation nor a comment. A null text has none."""
    rows = files.where(F.col("text").rlike(marker)).select("file", F.split("text", "\n", -1).alias("rows"))
    told = lambda x: x.rlike(marker) & ~x.rlike("^\\s*(//|\\*|/\\*|#(?!\\{))")
    each = F.transform("rows", lambda x, i: F.when(told(x), F.struct((i + 1).alias("line_no"), x.alias("line"), F.slice("rows", i + 1, STATEMENT_LINES + 6).alias("next"), F.slice("rows", F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))).alias("before"))))
    d = rows.select("file", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("m")).select("file", "m.*")
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("over"))
    step = lambda s, x: F.when(s["over"], s).otherwise(F.struct((s["depth"] + balance(x)).alias("depth"), (s["n"] + 1).alias("n"), (s["depth"] + balance(x) <= 0).alias("over")))
    d = d.withColumn("n", F.aggregate(F.slice("next", 1, STATEMENT_LINES), begin, step)["n"])
    rest = F.filter(F.slice("next", F.col("n") + 1, 6), lambda x: ~x.rlike("^\\s*(@|//|\\*|/\\*|$)"))
    return d.select("file", "line_no", "line", F.array_join(F.slice("next", 1, F.col("n")), "\n").alias("said"), F.array_join("before", "\n").alias("before"), F.array_join(F.slice("next", 2, 2), "\n").alias("after"), F.array_join(F.slice("next", 1, 4), "\n").alias("near"), F.get(rest, F.lit(0)).alias("ahead"))


def http_calls(files: DataFrame) -> DataFrame:
    """(method, url, file, line_no, confidence) of script files, tests left out: fetch, axios
    by method and by object, HttpClient, requests by ``open``; every form that a line has.
    What is put together at run time is ``inferred`` from its literal end."""
    q = "['\"`]"
    text = lambda n: f"({q})((?:(?!\\{n})\\S)+)\\{n}"  # noqa: E731  (a string; n is the number of its quote's group)
    verbs = "get|post|put|delete|patch"
    marker = f"(?i)\\bfetch\\s*\\(|\\baxios\\b|\\bhttp\\w*\\s*\\.\\s*({verbs})\\b|\\.open\\s*\\(|\\burl\\s*:\\s*{q}"
    own = files.where(extension(F.col("file")).isin(*CALLER_EXTENSIONS) & ~F.col("file").rlike("node_modules|\\.spec\\.|\\.test\\."))
    d = marked(own, marker)
    said = F.col("said")
    part = lambda p, i=1, of=said: F.nullif(F.regexp_extract(of, p, i), F.lit(""))
    at = "(?i)^[^\\n]*?"  # a form begins on its own line
    asked = f"(?i)\\bmethod\\s*:\\s*{q}?(POST|PUT|DELETE|PATCH)"
    options = said.rlike("\\bfetch\\s*\\(\\s*[^,()]+,\\s*\\w")
    method = F.upper(F.coalesce(part(asked), F.when(options, part(asked, of=F.col("before"))), F.lit("GET")))

    def form(method: Column, url: Column, confidence: str) -> Column:
        return F.when(method.isNotNull() & url.isNotNull(), F.struct(method.alias("method"), url.alias("url"), F.lit(confidence).alias("confidence")))

    fetched = part(f"{at}\\bfetch\\s*\\(\\s*{text(1)}", 2)
    late = F.coalesce(part(f"{at}\\bfetch\\s*\\(\\s*[\\w.]+\\s*\\+\\s*{q}(/[^'\"`]*){q}"), part(f"{at}\\bfetch\\s*\\(\\s*`[^`]*\\$\\{{[^}}]+\\}}(/[^`]*)`"))
    axios = f"{at}\\baxios\\.({verbs}|head)(?:<[^>]*>)?\\s*\\(\\s*{text(2)}"
    named = f"(?i)\\bmethod\\s*:\\s*{q}({verbs}){q}"
    whole = said.rlike(f"{at}\\baxios(?:\\.request)?(?:<[^>]*>)?\\s*\\(\\s*\\{{")
    at_once = F.when(whole, said).otherwise(F.col("line"))
    client = f"{at}\\bhttp\\w*\\s*\\.\\s*({verbs})(?:<[^()]*>)?\\s*\\(\\s*"
    literal, joined = client + text(2), client + f"(?:this\\.\\w+|environment\\.\\w+|\\w+)\\s*\\+\\s*{text(2)}"
    template = client + "`[^`]*\\$\\{[^}]+\\}(/[^`?]+)[^`]*`"
    opened = f"{at}\\.open\\s*\\(\\s*{q}(GET|POST|PUT|DELETE|PATCH){q}\\s*,\\s*{text(2)}"
    up = lambda p: F.upper(part(p))
    forms = F.array(
        form(method, fetched, "resolved"), F.when(fetched.isNull(), form(method, late, "inferred")),
        form(up(axios), part(axios, 3), "resolved"), form(F.upper(part(named, of=at_once)), part(f"(?i)\\burl\\s*:\\s*{text(1)}", 2, at_once), "resolved"),
        form(up(literal), part(literal, 3), "resolved"), F.when(part(literal).isNull(), F.coalesce(form(up(joined), part(joined, 3), "inferred"), form(up(template), part(template, 2), "inferred"))),
        form(up(opened), part(opened, 3), "resolved"))
    each = d.select("file", "line_no", F.explode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))).alias("c"))
    return each.select("c.method", "c.url", "file", "line_no", "c.confidence")


def route(*parts: Column) -> Column:
    """Parts joined by single slashes, without a closing slash or star."""
    whole = F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", *parts)), "/+", "/")
    return F.regexp_replace(F.regexp_replace(whole, "\\*+$", ""), "(.)/$", "$1")


def endpoints(files: DataFrame) -> DataFrame:
    """(method, route, file, line_no): JVM annotations (Spring, JAX-RS, Micronaut, servlets) and
    decorators below the base path of their class, script routers and Python decorators.

    An annotation belongs to the class or method that comes next; a class without one has no
    base. A method-level ``RequestMapping`` that names no method is ANY; a servlet's methods
    have its first pattern. Scripts count only where their path says that they answer
    requests, and a call of an HTTP client isn't a route.
    """
    t, said, file = F.col("line"), F.col("said"), F.col("file")
    marker = f"@(?:Request|{VERB})Mapping\\b|@Path\\b|@WebServlet\\b|@Controller\\b|@(?:GET|POST|PUT|PATCH|DELETE|HEAD)\\b|@(?:{VERB})\\s*\\(|\\b(?:class|interface)\\s+\\w+|\\bvoid\\s+do(?:Get|Post|Put|Delete)\\s*\\(|(?i:\\.(?:get|post|put|patch|delete|head|route)\\s*\\(\\s*['\"`]/)"
    ext = extension(file)
    own = files.where(ext.isin(*ENDPOINT_EXTENSIONS) & (ext.isin("java", "kt") | file.rlike(ENDPOINT_PATHS)))
    d = marked(own, marker).withColumn("jvm", extension(file).isin("java", "kt"))
    part = lambda p, i=1, of=said: F.nullif(F.regexp_extract(of, p, i), F.lit(""))
    first = "\\s*\\(\\s*(?:(?:[^\"')]|\"[^\"]*\")*?\\b(?:value|path|uri|urlPatterns)\\s*=\\s*)?[{\\[]?\\s*['\"`]([^'\"`]*)['\"`]"
    is_class = t.rlike("\\b(class|interface)\\s+\\w+")
    heads_class = F.coalesce(F.col("ahead").rlike("\\b(class|interface)\\s+\\w+"), F.lit(False)) & ~is_class
    mapping = part(f"^[^\\n]*?@(?:RequestMapping|Path|Controller|WebServlet){first}")
    d = d.withColumn("is_class", is_class).withColumn("heads", heads_class & mapping.isNotNull()).withColumn("mapping", mapping)
    # A class's base is what the annotation right above it among these lines says, or one on its own line.
    order = Window.partitionBy("file").orderBy("line_no")
    above = F.last(F.when(F.col("is_class"), F.struct(F.lit("").alias("b"))).when(F.col("heads"), F.struct(F.col("mapping").alias("b"))), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("above", above)
    d = d.withColumn("base", F.coalesce(F.last(F.when(F.col("is_class"), F.coalesce("mapping", "above.b", F.lit(""))), True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    base, jvm = F.col("base"), F.col("jvm")

    def told(method: Column, path: Column) -> Column:
        return F.when(method.isNotNull(), F.struct(F.upper(method).alias("method"), path.alias("route")))

    spring = f"^[^\\n]*?@({VERB})Mapping\\b"
    sub = F.coalesce(part(f"^[^\\n]*?@(?:{VERB})Mapping{first}"), F.lit(""))
    bare = (sub == "") & (base == "")
    asked = F.when(t.rlike("@RequestMapping\\b") & ~F.col("heads") & ~F.col("is_class"), F.coalesce(part("\\bmethod\\s*=\\s*[{\\[]?\\s*(?:RequestMethod\\.)?(\\w+)"), F.lit("ANY")))
    near = F.concat_ws("\n", F.regexp_extract("before", "(?m)^\\s*@Path[^\\n]*\\Z", 0), "line", F.regexp_extract("after", "\\A(?:\\s*@[^\\n]*\\n)?\\s*(@Path\\b[^\\n]*)", 1))
    answers = "@(GET|POST|PUT|PATCH|DELETE|HEAD)\\b"
    micronaut = f"^[^\\n]*?@({VERB}){first}"
    serves = "\\b(?:protected|public)\\s+void\\s+do(Get|Post|Put|Delete)\\s*\\("
    nest = f"^[^\\n]*?@({VERB})\\s*\\(\\s*['\"`]?([^'\"`)]*?)['\"`]?\\s*\\)"
    routers = "(?i)(\\w[\\w$]*)(?:\\(\\))?\\.(get|post|put|patch|delete|head)\\s*\\(\\s*['\"`](/[^'\"`]*)['\"`]"
    decorators = "(?i)@\\w+\\.(get|post|put|patch|delete|route)\\s*\\(\\s*['\"]([^'\"]+)['\"]"
    jvm_form = F.coalesce(
        F.when(~bare, told(part(spring), route(base, sub))), told(asked, route(base, F.coalesce("mapping", F.lit("")))),
        told(part(answers, of=t), route(base, F.coalesce(F.nullif(F.regexp_extract(near, f"@Path{first}", 1), F.lit("")), F.lit("")))),
        told(part(micronaut), route(base, part(micronaut, 2))), F.when(base != "", told(part(serves, of=t), route(base))))
    script_form = F.coalesce(
        F.when(~extension(file).isin("py"), told(part(nest), route(base, F.coalesce(part(nest, 2), F.lit(""))))),
        told(F.regexp_replace(F.upper(part(decorators)), "^ROUTE$", ""), route(part(decorators, 2))),
        F.when(~F.coalesce(part(routers).rlike(f"(?i)^({CLIENTS})$"), F.lit(False)), told(part(routers, 2), route(part(routers, 3)))))
    out = d.withColumn("e", F.when(jvm, jvm_form).otherwise(script_form)).where("e IS NOT NULL")
    posted = F.upper(F.regexp_extract("said", "(?i)methods\\s*=\\s*[\\[(]\\s*['\"](\\w+)", 1))
    return out.select(F.when(F.col("e.method") != "", F.col("e.method")).when(posted != "", posted).otherwise("GET").alias("method"), "e.route", "file", "line_no")
