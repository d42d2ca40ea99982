"""Calls of stored routines in back-end code, in nine styles and by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import BACKEND_EXTENSIONS, of_kind
from .webforms import marked

# A file without one of these has no call (fixed values).
KEYWORDS = (
    "SimpleJdbcCall|StoredProcedure|[Cc]allable[Ss]tatement|jdbcTemplate|namedParameterJdbcTemplate|\\{call |BEGIN |oracledb|cx_Oracle|OracleCommand|SqlCommand|ExecuteNonQuery|executeQuery|EXECUTE IMMEDIATE|"
    "callProc|callproc|callProcedure|executeProcedure|@Procedure|procedureName|withProcedureName|withCatalogName|\\{\\s*\\?\\s*=\\s*call "
)
NAME = "[\"']([\\w$#.]+)[\"']"


def db_calls(files: DataFrame) -> DataFrame:
    """(routine, package, file, line_no, confidence) of back-end files (file, text), tests and
    files without a key word left out; names in upper case, the package being the part
    before the last. A string that only looks like a qualified name is ``inferred``, and none
    where its line says a call by one of the commonest styles."""
    own = of_kind(files, *BACKEND_EXTENSIONS).where(~F.col("file").rlike("\\.spec\\.|\\.test\\.") & F.col("text").rlike(KEYWORDS))
    # Strings in capitals with a dot are the last style.
    marker = f"(?i)@Procedure\\b|StoredProcedureQuery|withCatalogName|ProcedureName\\s*\\(|\\bcall\\s+[\\w$#.]+|callproc|\\b(?:execute|query)\\s*\\(|(?:Oracle|Sql)Command|(?-i:[\"'][A-Z_][A-Z0-9_]*\\.[A-Z_])"
    d = marked(own, marker)
    part = lambda p, of="said": F.nullif(F.regexp_extract(of, p, 1), F.lit(""))
    at = "(?i)^[^\\n]*?"
    catalog = part(f"(?i)withCatalogName\\s*\\(\\s*{NAME}\\s*\\)", "line")
    chained = F.when(catalog.isNotNull(), part(f"(?i)withProcedureName\\s*\\(\\s*{NAME}\\s*\\)", "near"))
    goes_on = F.col("line").rlike("^\\s*\\.") & F.col("before").rlike("(?i)withCatalogName")  # told by the line above
    alone = F.when(catalog.isNull() & ~goes_on, F.coalesce(part(f"{at}withProcedureName\\s*\\(\\s*{NAME}"), part(f"{at}new\\s+SimpleJdbcCall[^.]+\\.setProcedureName\\s*\\(\\s*{NAME}")))
    escaped = part(f"{at}\\{{\\s*(?:\\?\\s*=\\s*)?call\\s+([\\w$#.]+)")
    asked = F.coalesce(part(f"{at}createStoredProcedureQuery\\s*\\(\\s*{NAME}"), F.when(~F.col("line").rlike("@Named|procedureName"), part(f"{at}StoredProcedureQuery[^\"'\\n]*{NAME}")))
    block = F.when(F.col("line").rlike("oracledb|BEGIN"), part(f"{at}\\b(?:execute|query)\\s*\\(\\s*[\"'`](?:BEGIN\\s+)?([\\w$#.]+)\\s*[(;]"))
    named = part(f"{at}@NamedStoredProcedureQuery[^\"']*(?:[\"'][^\"']*[\"'][^\"']*)*?procedureName\\s*=\\s*{NAME}")
    sure: list[Column] = [
        part(f"{at}@Procedure\\s*\\(\\s*(?:(?:procedureName|value)\\s*=\\s*)?{NAME}"), named, F.when(chained.isNotNull(), F.concat_ws(".", catalog, chained)), alone, escaped, asked, block,
        part(f"{at}callproc\\s*\\(\\s*{NAME}"), part(f"{at}new\\s+(?:Oracle|Sql)Command\\s*\\(\\s*{NAME}")]
    loose = part("[\"']([A-Z_][A-Z0-9_]*\\.[A-Z_][A-Z0-9_]*(?:\\.[A-Z_][A-Z0-9_]*)?)[\"']", "line")
    loose = F.when(alone.isNull() & escaped.isNull() & asked.isNull(), loose)
    told = F.concat(F.transform(F.array_distinct(F.filter(F.array(*sure), lambda x: x.isNotNull())), lambda x: F.struct(x.alias("name"), F.lit("resolved").alias("confidence"))), F.filter(F.array(F.when(loose.isNotNull(), F.struct(loose.alias("name"), F.lit("inferred").alias("confidence")))), lambda x: x.isNotNull()))
    each = d.select("file", "line_no", F.explode(told).alias("c")).select("file", "line_no", F.split(F.upper("c.name"), "\\.").alias("p"), "c.confidence")
    rows = each.select(F.element_at("p", -1).alias("routine"), F.when(F.size("p") > 1, F.element_at("p", -2)).alias("package"), "file", "line_no", "confidence")
    # One row a call: what is sure wins.
    return rows.groupBy("routine", "package", "file", "line_no").agg(F.max("confidence").alias("confidence"))
