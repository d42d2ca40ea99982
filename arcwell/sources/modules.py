"""Modules of a source tree, from its paths alone.

Folders are counted once; everything after that is grouping and joining of folders, of
which there are far fewer than files. Nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoint

# Folders that name no module, folders that hold source trees, short names of sub-projects,
# endings that make a sub-project, and bounds (fixed values).
NO_MODULE = (
    "src main test java kotlin resources webapp dist build target generated out output app lib internal pkg cmd assets static public styles environments i18n "
    "locale fonts images icons themes scss less com br org net io co gov edu uk de fr ru"
).split()
SOURCE_DIRS = "src app lib packages modules apps internal pkg cmd source sources".split()
SHORT_NAMES = "frontend backend api web app core service worker server client ui gateway proxy admin mobile cli bff".split()
SUB_PROJECT = "(?i)(^|[-_.])(frontend|front|backend|back|api|web|ui|client|server|mobile|bff|gateway|admin)$"
MANY_FILES, GROUP_FILES, MOST_DEPTH = 80, 5, 10
ROOT = "__root__"


def short_name(top: Column) -> Column:
    """The end of a folder's name from its last word that is a known part of a system; the
    last word, if none is."""
    words = F.split(top, "[-_]")
    at = F.array_max(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.lower(F.element_at(words, i)).isin(*SHORT_NAMES)))
    return F.coalesce(F.array_join(F.slice(words, at, F.size(words)), "-"), F.element_at(words, -1))


def split_depths(folders: DataFrame) -> DataFrame:
    """(top, depth): how many folders below it name a module of a sub-project, of (top, inner,
    n): the first depth at which two different names that could be modules' have GROUP_FILES
    files each, if the depths above it have a single folder or none that could name one."""
    deep = folders.where(F.size("inner") > 0).select("top", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("inner"), F.lit(MOST_DEPTH))), lambda d: F.slice("inner", 1, d))).alias("prefix"))
    groups = deep.groupBy("top", "prefix").agg(F.sum("n").alias("n"))
    last = F.element_at("prefix", -1)
    names = groups.select("top", F.size("prefix").alias("depth"), "n", last.alias("last"), last.isin(*NO_MODULE).alias("infra"))
    told = names.groupBy("top", "depth").agg(
        (F.count_distinct(F.when((F.col("n") >= GROUP_FILES) & ~F.col("infra"), F.col("last"))) >= 2).alias("splits"),
        ((F.count("*") > 1) & ~F.bool_and("infra")).alias("ends"))
    first = told.groupBy("top").agg(F.min(F.when(F.col("splits"), F.col("depth"))).alias("split"), F.min(F.when(F.col("ends") & ~F.col("splits"), F.col("depth"))).alias("end"))
    return first.select("top", F.when(F.col("split") < F.coalesce("end", F.lit(MOST_DEPTH + 1)), F.col("split")).otherwise(1).alias("depth"))


def folder_keys(folders: DataFrame) -> DataFrame:
    """(folder, n, top, key, name) of folders (folder, n): what each belongs to before small
    and like-named groups are put together; a null key where the root has too few files."""
    parts = F.split("folder", "/")
    d = folders.select("folder", "n", F.element_at(parts, 1).alias("top"), F.slice(parts, 2, F.size(parts)).alias("inner"))
    named, tree = F.col("top").rlike(SUB_PROJECT), F.col("top").isin(*SOURCE_DIRS)
    tops = d.groupBy("top").agg(F.sum("n").alias("files"))
    subs = checkpoint(tops.where(~tree & (F.col("top") != "") & (named | (F.col("files") >= MANY_FILES))).select("top", named.alias("named")))
    met = d.join(subs.withColumn("sub", F.lit(True)), "top", "left").join(split_depths(d.join(subs, "top", "left_semi")), "top", "left")
    within = F.slice("inner", 1, F.coalesce("depth", F.lit(1)))
    met = met.withColumn("within", F.when(F.col("sub"), F.when(F.size("inner") == 0, F.lit(ROOT)).otherwise(F.array_join(within, "/"))))
    ways = met.where("sub").groupBy("top").agg(F.count_distinct("within").alias("ways"))
    met = checkpoint(met.join(ways, "top", "left"))
    is_split, whole = F.col("ways") > 1, F.col("ways") == 1
    key = (
        F.when(F.col("top") == "", F.when(F.col("n") >= GROUP_FILES, ROOT))
        .when(is_split, F.concat_ws("/", "top", "within"))
        .when(whole & F.col("named"), F.concat_ws("/", "top", F.lit(ROOT)))
        .when(tree & (F.size("inner") > 0), F.concat_ws("/", F.col("top"), F.element_at("inner", 1)))
        .otherwise(F.col("top")))
    prefixed = is_split | (whole & F.col("named"))
    last = F.substring_index("key", "/", -1)
    name = F.when(F.coalesce(prefixed, F.lit(False)) & F.contains(F.col("key"), F.lit("/")), F.when(last == ROOT, short_name(F.col("top"))).otherwise(F.concat_ws("/", short_name(F.col("top")), last))).otherwise(last)
    return met.withColumn("key", key).select("folder", "n", "top", "key", name.alias("name"))


def name_folders(folders: DataFrame, most: int | None = 25) -> DataFrame:
    """(folder, module) of folders (folder, n), '' being the root.

    Groups of one name and top folder are one module; a name belongs to the top folder with
    the largest such group, and others' groups are told apart by their top folder. A module
    of fewer than GROUP_FILES files goes to the first of these that there is: the one with
    its top folder's short name, with its top folder's name, the root's, the largest of its
    top folder; but only if that one has as many. Null: folders of a root with too few
    files, and of modules that aren't among the ``most`` largest.
    """
    d = checkpoint(folder_keys(folders))
    groups = d.where("key IS NOT NULL").groupBy("key", "top", "name").agg(F.sum("n").alias("files"))
    owner = groups.groupBy("name").agg(F.min_by("top", F.struct(-F.col("files"), "key")).alias("owner"))
    said = F.when(F.col("top") == F.col("owner"), F.col("name")).otherwise(F.concat_ws("/", "top", "name"))
    groups = checkpoint(groups.join(owner, "name").select("key", "top", said.alias("module"), "files"))
    sized = checkpoint(groups.groupBy("module").agg(F.sum("files").alias("files"), F.min_by("top", F.struct(-F.col("files"), "key")).alias("top")))
    largest = sized.groupBy("top").agg(F.min_by("module", F.struct(-F.col("files"), "module")).alias("largest"))
    small = sized.where(F.col("files") < GROUP_FILES).join(largest, "top")
    tries = small.select("module", F.posexplode(F.array(short_name(F.col("top")), "top", F.lit(ROOT), "largest")).alias("turn", "host"))
    found = tries.join(sized.select(F.col("module").alias("host"), F.col("files").alias("held")), "host").groupBy("module").agg(F.min_by(F.struct("host", "held"), "turn").alias("h"))
    moved = found.where((F.col("h.host") != F.col("module")) & (F.col("h.held") >= GROUP_FILES)).select("module", F.col("h.host").alias("host"))
    placed = checkpoint(sized.join(moved, "module", "left").select("module", "files", F.coalesce("host", "module").alias("host")))
    kept = placed.groupBy("host").agg(F.sum("files").alias("files"))
    if most:
        kept = kept.orderBy(F.desc("files"), "host").limit(most)
    hosts = placed.join(kept.select("host"), "host").select("module", "host")
    keys = groups.join(hosts, "module").select("key", F.col("host").alias("module"))
    return d.select("folder", "key").join(keys, "key", "left").select("folder", "module")


def detect_modules(files: DataFrame, most: int | None = 25) -> DataFrame:
    """(file, module) of all (file); a null module where ``name_folders`` has none."""
    folder = F.when(F.contains(F.col("file"), F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    d = files.select("file", folder.alias("folder"))
    named = name_folders(d.groupBy("folder").agg(F.count("*").alias("n")), most)
    return d.join(named, "folder").select("file", "module")
