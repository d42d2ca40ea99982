"""Declared structure: schema tables, front-end modules, screens, Java type names.

All are expressions: a whole-text pattern gives the blocks, ``explode`` the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import round_checkpoint

CREATE = "(?is)\\bcreate\\s+(?:or\\s+replace\\s+)?table\\s+(?:if\\s+not\\s+exists\\s+)?([\\w\"`.\\[\\]]+)\\s*\\((.*?)\\)\\s*;"
TABLE_COLUMNS = ["table_name", "column_name", "type", "nullable", "primary_key", "unique_key", "ref_table", "file", "source"]
SCREEN_SUFFIXES = ("Controller", "Component", "View", "Screen", "Page")
NGRX = ("action", "reducer", "effect", "selector")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _ext(column: str = "file") -> Column:
    return F.lower(F.regexp_extract(column, "\\.([^./]+)$", 1))


def _snake(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), "^_", "")


def _blocks(files: DataFrame, pattern: str) -> DataFrame:
    d = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("s"))
    return d.select("file", F.regexp_extract("s", pattern, 1).alias("name"), F.regexp_extract("s", pattern, 2).alias("body"))


NAME = "[\"`\\[]?(\\w+)[\"`\\]]?"


def _items(body: Column) -> Column:
    """A list split at the commas outside parentheses (one level of them), line comments off."""
    flat = F.regexp_replace(F.regexp_replace(body, "--[^\\n]*", ""), "\\s+", " ")
    return F.filter(F.transform(F.regexp_extract_all(flat, F.lit("((?:[^,()]|\\([^()]*\\))+)"), 1), lambda x: F.trim(x)), lambda x: x != "")


def sql_tables(files: DataFrame) -> DataFrame:
    """A row a column of CREATE TABLE statements; keys and references may be told in the column
    or in a clause of their own."""
    d = _blocks(files.where(_ext() == "sql"), CREATE).withColumn("items", _items(F.col("body")))
    clause = "(?i)^(constraint " + NAME + " )?(primary key|foreign key|unique|check|index|key)\\b"
    told = F.filter("items", lambda x: x.rlike(clause))
    listed = lambda word: F.flatten(F.transform(F.filter(told, lambda x: x.rlike(f"(?i)\\b{word}\\b")), lambda x: F.split(F.regexp_replace(F.regexp_extract(x, f"(?i){word}[^(]*\\(([^)]*)\\)", 1), "[\"`\\[\\]\\s]", ""), ",")))
    to = "(?i)foreign key ?\\( ?" + NAME + " ?\\) ?references (?:\\w+\\.)?" + NAME
    refs = F.map_from_entries(F.transform(F.filter(told, lambda x: x.rlike(to)), lambda x: F.struct(F.regexp_extract(x, to, 1), F.regexp_extract(x, to, 2))))
    d = d.select("file", F.element_at(F.split(F.regexp_replace("name", "[\"`\\[\\]]", ""), "\\."), -1).alias("table_name"), listed("primary key").alias("keys"), listed("unique").alias("uniques"), refs.alias("refs"), F.explode("items").alias("r"))
    column = "^" + NAME + " (\\w+(?: ?\\([^)]*\\))?)(.*)$"
    d = d.where(~F.col("r").rlike(clause)).withColumn("column_name", _first(F.col("r"), column)).withColumn("rest", F.lower(F.regexp_extract("r", column, 3))).where("column_name IS NOT NULL")
    key = F.col("rest").contains("primary key") | F.array_contains("keys", F.col("column_name"))
    return d.select(
        "table_name", "column_name", F.upper(F.regexp_extract("r", column, 2)).alias("type"), (~F.col("rest").contains("not null") & ~F.col("rest").contains("primary key")).alias("nullable"), key.alias("primary_key"),
        (F.col("rest").rlike("\\bunique\\b") | F.array_contains("uniques", F.col("column_name"))).alias("unique_key"),
        F.coalesce(_first(F.col("r"), "(?i)\\breferences (?:\\w+\\.)?" + NAME), F.col("refs")[F.col("column_name")]).alias("ref_table"), "file", F.lit("sql").alias("source"))


def _statements(text: Column, end: str) -> Column:
    """A text cut where ``end`` fits."""
    return F.filter(F.transform(F.split(text, end), lambda x: F.trim(x)), lambda x: x != "")


def _told(d: DataFrame, source: str, name: Column, kind: Column, nullable: Column, key: Column, unique: Column, ref: Column) -> DataFrame:
    """TABLE_COLUMNS of rows (file, table_name, r): a declaration each."""
    out = d.select("table_name", name.alias("column_name"), F.coalesce(kind, F.lit("unknown")).alias("type"), nullable.alias("nullable"), key.alias("primary_key"), unique.alias("unique_key"), ref.alias("ref_table"), "file", F.lit(source).alias("source"))
    return out.where("column_name IS NOT NULL AND table_name IS NOT NULL")


def prisma_tables(files: DataFrame) -> DataFrame:
    """Models: a field a line, ``name Type? @attributes``; lists are relations, no columns."""
    d = _blocks(files.where(_ext() == "prisma"), "(?s)\\bmodel\\s+(\\w+)\\s*\\{([^{}]*)\\}").select("file", F.col("name").alias("table_name"), F.explode(_statements(F.col("body"), "\\n")).alias("r"))
    word = F.split(F.col("r"), "\\s+")
    kind, rest = F.get(word, F.lit(1)), F.col("r")
    d = d.where(~rest.startswith("//") & ~rest.startswith("@@") & kind.isNotNull()).where(~F.get(F.split(F.col("r"), "\\s+"), F.lit(1)).endswith("[]"))
    return _told(d, "prisma", F.get(word, F.lit(0)), F.regexp_replace(kind, "\\?$", ""), kind.endswith("?"), rest.contains("@id"), rest.contains("@unique"), F.lit(None).cast("string"))


def django_tables(files: DataFrame) -> DataFrame:
    """Model classes: what is assigned to a ``models`` field in the class's own body."""
    python = files.where(_ext() == "py").select("file", F.explode(F.split("text", "(?m)^(?=class\\s)")).alias("s")).where(F.col("s").rlike("^class\\s+\\w+\\s*\\(\\s*(models\\.)?Model\\s*\\)"))
    d = python.select("file", F.regexp_extract("s", "^class\\s+(\\w+)", 1).alias("table_name"), F.explode(F.regexp_extract_all("s", F.lit("(?m)^(?: {4}|\\t)(\\w+\\s*=\\s*models\\.\\w+\\(.*)$"), 1)).alias("r"))
    kind, rest = F.regexp_extract("r", "models\\.(\\w+)", 1), F.regexp_replace("r", "\\s", "")
    points = kind.isin("ForeignKey", "OneToOneField")
    return _told(d, "django", _first(F.col("r"), "^(\\w+)"), kind, rest.contains("null=True"), rest.contains("primary_key=True"), rest.contains("unique=True"), F.when(points, _first(rest, "\\((?:to=)?['\"]?(\\w+)")))


def _annotated(text: Column, member: str) -> Column:
    """The members of a class body with the annotations before them: the body's statements."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)/\\*.*?\\*/", ""), "//[^\\n]*", "")
    body = F.regexp_extract(bare, "(?s)\\bclass\\b[^{]*\\{(.*)$", 1)
    return F.filter(_statements(body, "[;{}](?![^(]*\\))"), lambda x: x.rlike(member))


def jpa_tables(files: DataFrame) -> DataFrame:
    """Entities: fields marked as id or column."""
    text, r = F.col("text"), F.col("r")
    named = F.coalesce(_first(text, "@Table\\s*\\([^)]*?name\\s*=\\s*[\"'](\\w+)"), _snake(_first(text, "\\bclass\\s+(\\w+)")))
    d = files.where((_ext() == "java") & text.contains("@Entity")).select("file", named.alias("table_name"), F.explode(_annotated(text, "@(Id|Column|JoinColumn)\\b")).alias("r"))
    own = F.regexp_extract(F.regexp_replace(r, "\\s*=.*$", ""), "(\\w+)\\s*$", 1)
    field = F.regexp_extract(F.regexp_replace(r, "@\\w+\\s*(\\([^)]*\\))?", " "), "(\\w+)\\s*(?:=|$)", 1)
    name = F.coalesce(_first(r, "@(?:Join)?Column\\s*\\([^)]*?name\\s*=\\s*[\"'](\\w+)"), F.nullif(field, F.lit("")), F.nullif(own, F.lit("")))
    key = r.rlike("@Id\\b")
    return _told(d, "jpa", name, F.lit(None).cast("string"), ~key, key, F.lit(False), F.lit(None).cast("string"))


def typeorm_tables(files: DataFrame) -> DataFrame:
    """Entities of scripts: properties below a column decorator."""
    text, r = F.col("text"), F.col("r")
    named = F.coalesce(_first(text, "@(?:Entity|Table)\\s*\\(\\s*['\"`](\\w+)"), _snake(F.regexp_replace(_first(text, "\\bclass\\s+(\\w+)"), "Entity$", "")))
    d = files.where(_ext().isin("ts", "js") & text.contains("@Entity")).select("file", named.alias("table_name"), F.explode(_annotated(text, "@(Primary\\w*|Column|JoinColumn)\\b")).alias("r"))
    flat = F.regexp_replace(r, "\\s", "")
    bare = F.regexp_replace(r, "@\\w+\\s*(\\([^)]*\\))?", " ")
    return _told(d, "typeorm", _first(bare, "(\\w+)\\s*[!?]?\\s*:"), F.lit(None).cast("string"), flat.contains("nullable:true"), flat.contains("@Primary"), flat.contains("unique:true"), F.lit(None).cast("string"))


def sequelize_tables(files: DataFrame) -> DataFrame:
    """``define`` and ``init`` calls: the objects of their first object."""
    text, r = F.col("text"), F.col("r")
    named = F.coalesce(_first(text, "\\.define\\s*\\(\\s*['\"`](\\w+)"), _snake(_first(text, "\\bclass\\s+(\\w+)\\s+extends\\s+Model")))
    after = F.regexp_extract(text, "(?s)(?:\\.define\\s*\\(\\s*['\"`]\\w+['\"`]\\s*,|\\.init\\s*\\()\\s*\\{(.*)$", 1)
    d = files.where(_ext().isin("ts", "js") & text.contains("equelize")).select("file", named.alias("table_name"), F.explode(F.regexp_extract_all(after, F.lit("(\\w+\\s*:\\s*\\{[^{}]*\\})"), 1)).alias("r"))
    flat = F.regexp_replace(r, "\\s", "")
    return _told(d, "sequelize", _first(r, "^(\\w+)"), _first(r, "DataTypes\\.(\\w+)"), flat.contains("allowNull:true"), flat.contains("primaryKey:true"), flat.contains("unique:true"), F.lit(None).cast("string"))


def db_tables(files: DataFrame) -> DataFrame:
    """TABLE_COLUMNS of all schema dialects: SQL, and five object mappers. No cap on columns is
    set."""
    out = sql_tables(files)
    for tables in (prisma_tables, django_tables, jpa_tables, typeorm_tables, sequelize_tables):
        out = out.unionByName(tables(files))
    return out.select(*TABLE_COLUMNS)


def ng_modules(files: DataFrame) -> DataFrame:
    """(name, file, declarations, imports, exports, providers, lazy_routes) of the
    decorator between ``@NgModule`` and its class."""
    d = files.where(_ext().isin("ts", "tsx") & F.col("text").contains("@NgModule"))
    body = F.regexp_extract("text", "(?s)@NgModule(.*?)(?:export\\s+class\\b|\\z)", 1)
    d = d.withColumn("body", F.regexp_replace(body, "//[^\\n]*", ""))

    def listed(key: str) -> Column:
        inner = F.regexp_extract("body", f"(?s)\\b{key}\\s*:\\s*\\[((?:[^\\[\\]]|\\[[^\\]]*\\])*)\\]", 1)
        return F.filter(F.split(F.regexp_replace(inner, "\\s+", ""), ","), lambda x: x.rlike("^[A-Z]")).alias(key)

    lazy = "(?s)path\\s*:\\s*['\"`]([^'\"`]*)['\"`][^}]*?loadChildren\\s*:\\s*(?:\\(\\s*\\)\\s*=>\\s*import\\(\\s*)?['\"`]([^'\"`]+)"
    routes = F.transform(F.regexp_extract_all("text", F.lit(lazy), 0), lambda x: F.struct(F.regexp_extract(x, lazy, 1).alias("path"), F.regexp_extract(x, lazy, 2).alias("module_path")))
    name = F.coalesce(_first(F.col("text"), "(?s)@NgModule.*?export\\s+class\\s+(\\w+)"), F.regexp_extract("file", "([^/]+)\\.[^.]*$", 1))
    return d.select(name.alias("name"), "file", listed("declarations"), listed("imports"), listed("exports"), listed("providers"), routes.alias("lazy_routes"))


def store_items(lines: DataFrame) -> DataFrame:
    """(type, name, file, line_no) of actions, reducers, effects, selectors and stores."""
    t = F.col("text")
    made = "\\b(?:const|let)\\s+(\\w+)\\s*=\\s*create(Action|Reducer|Effect|Selector)\\s*\\("
    kind = F.coalesce(F.lower(_first(t, made, 2)), F.when(t.rlike("@Effect\\b.*?\\w+\\s*=\\s*this"), "effect"), F.when(t.rlike("StoreModule\\.(forRoot|forFeature)\\b"), "store"))
    name = F.coalesce(_first(t, made), F.when(kind == "effect", _first(t, "(\\w+)\\s*=\\s*this")))
    return lines.where(_ext().isin("ts", "tsx")).select(kind.alias("type"), name.alias("name"), "file", "line_no").where("type IS NOT NULL")


def json_strings(files: DataFrame, most_depth: int = 12) -> DataFrame:
    """(file, value): the different strings in the JSON texts of (file, text), of any object and
    array down to ``most_depth``; keys are none. A text that isn't JSON has none."""
    front = files.select("file", F.try_parse_json("text").alias("v")).where("v IS NOT NULL")
    found = None
    for _ in range(most_depth + 1):
        front = round_checkpoint(front.withColumn("kind", F.schema_of_variant("v")))
        told = front.where("kind = 'STRING'").select("file", F.variant_get("v", "$", "string").alias("value"))
        found = told if found is None else found.union(told)
        open_ = front.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'").select("file", "v")
        if open_.isEmpty():
            break
        inner = files.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("w"))
        front = open_.lateralJoin(inner).select("file", F.col("w").alias("v"))
    return found.distinct()


def screen_links(files: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence) of screen files (``.osw``) and the code files that
    their name or a string in them names; resolved when the name has one file only. The
    bare name is inferred. A screen that isn't JSON is searched for strings as it is."""
    stem = F.regexp_extract("file", "([^/]+)\\.[^.]*$", 1)
    code = files.where(_ext().isin("ts", "tsx", "js", "jsx")).select(F.col("file").alias("to_id"), stem.alias("base"))
    sizes = code.groupBy("base").agg(F.count("*").alias("n"))
    own = F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, 2, 1 << 20))
    screens = files.where(_ext() == "osw").select("file", "text")
    broken = screens.where(F.try_parse_json("text").isNull()).select("file", F.explode(F.regexp_extract_all("text", F.lit("\"([A-Z][A-Za-z0-9_]{2,60})\""), 1)).alias("value"))
    told = json_strings(screens).where(F.col("value").rlike("^[A-Z][A-Za-z0-9_]{2,60}$")).union(broken).select(F.col("file").alias("from_id"), F.col("value").alias("base"), F.lit(True).alias("sure"))
    by_name = F.array(*[F.struct(F.concat(own, F.lit(s)).alias("base"), F.lit(True).alias("sure")) for s in SCREEN_SUFFIXES], F.struct(own.alias("base"), F.lit(False).alias("sure")))
    tries = screens.select(F.col("file").alias("from_id"), F.explode(by_name).alias("x")).select("from_id", "x.base", "x.sure").union(told).distinct()
    met = tries.join(sizes, "base").join(code, "base").groupBy("from_id", "to_id").agg(F.max(F.col("sure") & (F.col("n") == 1)).alias("one"))
    return met.select("from_id", "to_id", F.when(F.col("one"), "resolved").otherwise("inferred").alias("confidence"))


def java_types(files: DataFrame) -> DataFrame:
    """(full_name, simple, package, kind, abstract, parents, file) of Java types."""
    head = "(?m)^\\s*(?:(?:public|protected|private|static|final|abstract|sealed)\\s+)*(?:class|interface|enum)\\s+\\w+[^{;]*\\{"
    d = files.where(_ext() == "java").select("file", F.regexp_extract("text", "(?m)^\\s*package\\s+([\\w.]+)\\s*;", 1).alias("package"), F.explode(F.regexp_extract_all("text", F.lit(head), 0)).alias("h"))
    bare = F.regexp_replace("h", "<[^<>]*>", "")
    parents = F.filter(F.split(F.concat_ws(",", F.regexp_extract(bare, "\\bextends\\s+([\\w.,\\s]+?)(?:\\bimplements\\b|\\{)", 1), F.regexp_extract(bare, "\\bimplements\\s+([\\w.,\\s]+)", 1)), "\\s*,\\s*"), lambda x: F.trim(x) != "")
    d = d.select("file", "package", F.regexp_extract("h", "\\b(class|interface|enum)\\s+(\\w+)", 1).alias("kind"), F.regexp_extract("h", "\\b(class|interface|enum)\\s+(\\w+)", 2).alias("simple"), F.col("h").rlike("\\babstract\\b").alias("abstract"), F.transform(parents, lambda x: F.trim(x)).alias("parents"))
    return d.withColumn("full_name", F.concat_ws(".", F.nullif("package", F.lit("")), "simple"))


def implementors(types: DataFrame) -> DataFrame:
    """(parent, child) full names: interfaces or abstract classes and those that name
    them as a parent."""
    up = types.where("kind = 'interface' OR abstract").select(F.col("full_name").alias("parent"), "simple")
    down = types.select(F.col("full_name").alias("child"), F.explode("parents").alias("p")).withColumn("simple", F.element_at(F.split("p", "\\."), -1))
    return down.join(up, "simple").where("parent <> child").select("parent", "child").distinct()


def resolve_types(uses: DataFrame, types: DataFrame, files: DataFrame) -> DataFrame:
    """(file, simple, full_name, tier) of names used in Java files: 1 imported by name,
    2 of the same package, 3 of a package imported whole, 4 any of that name; the first
    tier that gives any wins."""
    texts = files.where(_ext() == "java")
    named = texts.select("file", F.explode(F.regexp_extract_all("text", F.lit("(?m)^\\s*import\\s+([\\w.]+(?:\\.\\*)?)\\s*;"), 1)).alias("target"))
    package = texts.select("file", F.regexp_extract("text", "(?m)^\\s*package\\s+([\\w.]+)\\s*;", 1).alias("package"))
    used = uses.where(_ext() == "java").select("file", "simple").distinct()
    known = used.join(types.select("simple", "full_name", F.col("package").alias("of")), "simple")
    by_import = known.join(named.select("file", F.col("target").alias("full_name"), F.lit(1).alias("tier")), ["file", "full_name"])
    by_package = known.join(package.where("package <> ''").select("file", F.col("package").alias("of"), F.lit(2).alias("tier")), ["file", "of"])
    whole = named.where("target LIKE '%.*'").select("file", F.regexp_replace("target", "\\.\\*$", "").alias("of"), F.lit(3).alias("tier"))
    found = known.withColumn("tier", F.lit(4))
    for d in (by_import, by_package, known.join(whole, ["file", "of"])):
        found = found.unionByName(d)
    found = found.groupBy("file", "simple", "full_name").agg(F.min("tier").alias("tier"))
    best = found.groupBy("file", "simple").agg(F.min("tier").alias("tier"))
    return found.join(best, ["file", "simple", "tier"]).select("file", "simple", "full_name", "tier")
