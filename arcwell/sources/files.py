"""Source trees, version-control logs and index folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a scan skips, and what it reads (fixed values).
SKIP = ("node_modules", ".git", "dist", "build", "out", "target", "coverage", ".next", ".nuxt", ".svelte-kit", "__pycache__", ".venv", "venv", ".idea", ".vscode", "vendor", "bin", "obj")
EXTENSIONS = (
    "ts tsx js jsx mjs cjs java kt scala py rb go rs cs cpp c h php swift dart html htm css scss sass less sql plsql pls pck pks pkb prc fnc trg pkg "
    "json yaml yml toml xml properties env osw md mdx graphql gql proto"
).split()
LARGEST = 512 * 1024


def scan_files(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """(file, ext, size_bytes, lines, text) below ``root``; skipped folders, dot folders,
    other extensions and files over 512 KB are left out before contents are decoded."""
    # The name's end is tested while files are listed: others are never opened.
    glob = "*.{" + ",".join([*EXTENSIONS, *map(str.upper, EXTENSIONS)]) + "}"
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + root.rstrip("/").replace(".", "\\.") + "/", "")
    d = d.withColumn("file", rel).withColumn("ext", F.lower(F.regexp_extract("file", "\\.([^./]+)$", 1)))
    folders = F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1)
    keep = (F.col("length") <= LARGEST) & F.col("ext").isin(*EXTENSIONS) & ~F.exists(folders, lambda p: p.isin(*SKIP) | p.startswith("."))
    out = d.where(keep).select("file", "ext", F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("text"))
    out = out.withColumn("lines", F.size(F.split("text", "\n", -1)))
    return out.orderBy("file").limit(most) if most else out


def parse_git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, ts, subject, file, added, deleted) from the text of
    ``git log --numstat --format=%x1e%H%x1f%an%x1f%at%x1f%s``; renames take the new name."""
    d = spark.read.option("lineSep", "\x1e").text(path).where("trim(value) <> ''")
    rows = F.split("value", "\n")
    head = F.split(F.get(rows, F.lit(0)), "\x1f")
    d = d.select(F.get(head, F.lit(0)).alias("sha"), F.get(head, F.lit(1)).alias("author"), F.timestamp_seconds(F.get(head, F.lit(2)).cast("long")).alias("ts"), F.get(head, F.lit(3)).alias("subject"), F.explode(F.filter(rows, lambda x: x.rlike("^[0-9-]+\\t[0-9-]+\\t"))).alias("row"))
    part = F.split("row", "\t")
    name = F.regexp_replace(F.regexp_replace(F.get(part, F.lit(2)), "\\{[^{}]* => ([^{}]*)\\}", "$1"), "^.* => ", "")
    number = lambda i: F.coalesce(F.try_cast(F.get(part, F.lit(i)), "long"), F.lit(0)) if hasattr(F, "try_cast") else F.coalesce(F.get(part, F.lit(i)).try_cast("long"), F.lit(0))
    return d.select("sha", "author", "ts", "subject", F.regexp_replace(name, "//+", "/").alias("file"), number(0).alias("added"), number(1).alias("deleted"))


def write_index(tables: dict[str, DataFrame], root: str) -> None:
    """Rebuild an index: one Parquet folder a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def open_index(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table of the index, or None when it is absent."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append_jsonl(entries: DataFrame, path: str) -> None:
    """Append JSON lines in folders by ISO week (column iso_week)."""
    entries.write.mode("append").partitionBy("iso_week").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with broken ones skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def modules(files: DataFrame, least: int = 5) -> DataFrame:
    """(file, module): the first two folders, folded to the first where they hold fewer
    than ``least`` files; files of the root are ``root``."""
    parts = F.split("file", "/")
    one = F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("root")
    two = F.when(F.size(parts) > 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(one)
    d = files.select("file", one.alias("one"), two.alias("two"))
    sizes = d.groupBy("two").agg(F.count("*").alias("n"))
    return d.join(sizes, "two").select("file", F.when(F.col("n") >= least, F.col("two")).otherwise(F.col("one")).alias("module"))
