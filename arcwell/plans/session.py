"""Session defaults, table access and shared checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("arcwell")
    builder = builder.master(master) if master else builder
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks a core that ``dealt`` makes.
DEALS = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt anew by ``keys`` over all cores, before much work is done for each of them. A
    table of few bytes a row comes as one task or two, whatever its rows are, and adaptive
    planning would put a shuffle of so few bytes together again unless it is told a number."""
    return df.repartition(DEALS * df.sparkSession.sparkContext.defaultParallelism, *keys)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of ``spark.checkpoint.dir``. Where the session names none,
    a temporary folder serves a local session; on a cluster that is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="arcwell-"))
    return df.checkpoint(eager=True)


def round_checkpoint(df: DataFrame) -> DataFrame:
    """``checkpoint`` for loops that join a round's rows with themselves. A checkpoint keeps the
    optimizer's estimate of its plan, and estimates of joins multiply: after some twenty such
    rounds they are numbers of millions of digits, and planning stands still. Here the rows
    come back without an estimate; joins go by what the shuffles turn out to hold."""
    kept = checkpoint(df)
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), session)
