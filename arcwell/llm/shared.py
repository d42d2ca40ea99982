"""Session helpers: shared checkpoints and table access."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of at most this many rows of up to three integers (24 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Keys of more rows than this are joined by a broadcast, see ``join_one``.
HOT_ROWS = 1_000
#: Rows that Spark hands to a Python worker at once, about a chunk of texts. Spark's own
#: 10,000 rows of text are 20 MB and more on both sides of the pipe.
ARROW_ROWS, ARROW_KEY, ARROW_DEFAULT = "500", "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Where the session
    names none, a temporary one, but only in a local session, whose executors are this
    machine's; on a cluster that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="arcwell-")
    return _own_folders[context.applicationId]


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def rows(df: DataFrame) -> int:
    """How many rows a frame has, each partition counted where it lies: ``count`` would write
    a shuffle file a partition for the sum."""
    return df._jdf.queryExecution().toRdd().count()


def small(df: DataFrame) -> DataFrame:
    """A table of a few integers a row, marked for broadcast while its rows are few."""
    return F.broadcast(df) if rows(df) <= BROADCAST_ROWS else df


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids``: broadcast while they are few."""
    return docs.join(small(checkpoint(ids)), "doc_id", "left_anti")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark's own paths lie."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_one(many: DataFrame, one: DataFrame, key: str, count: str) -> DataFrame:
    """``many`` joined with ``one``, which has each key once and in ``count`` how many rows
    of ``many`` have it. Rows of hot keys meet a broadcast of these keys' rows, so that no
    task gets a whole hot key; the others are shuffled. A key is hot from HOT_ROWS rows on,
    and from a millionth of all rows on: the broadcast has BROADCAST_ROWS rows at most."""
    one = checkpoint(one)
    total = one.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    least = max(HOT_ROWS, total // BROADCAST_ROWS)
    hot, cold = one.where(F.col(count) > least).drop(count), one.where(F.col(count) <= least).drop(count)
    met = many.join(cold, key)
    if hot.isEmpty():
        return met
    return many.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key).unionByName(many.join(F.broadcast(hot), key))


_own_folders: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that their Python
    workers can import it wherever they run; and hand them smaller batches, unless the
    session has a size of its own."""
    context = spark.sparkContext
    if spark.conf.get(ARROW_KEY) == ARROW_DEFAULT:
        spark.conf.set(ARROW_KEY, ARROW_ROWS)
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="arcwell-")) / "arcwell_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        context.addPyFile(str(to))
        _shipped.add(context.applicationId)
    return spark
