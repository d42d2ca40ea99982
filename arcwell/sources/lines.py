"""Texts to lines, and the line-stateful helpers that extractors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_lines(files: DataFrame) -> DataFrame:
    """(file, line_no from 1, text); trailing empty lines are kept."""
    return files.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "text")).select("file", (F.col("k") + 1).alias("line_no"), "text")


def _by() -> Window:
    return Window.partitionBy("file").orderBy("line_no")


def last_marker(marker: Column) -> Column:
    """The last non-null marker at or above the line."""
    return F.last(marker, ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0))


def resettable(marker: Column, reset: Column) -> Column:
    """As ``last_marker``, but nothing from a line on where ``reset`` holds."""
    last = last_marker(F.when(reset, F.struct(F.lit(None).cast("string").alias("m"))).when(marker.isNotNull(), F.struct(marker.alias("m"))))
    return last["m"]


def context(before: int, after: int) -> Column:
    """The lines around, joined by spaces."""
    return F.concat_ws(" ", F.collect_list("text").over(_by().rowsBetween(-before, after)))


def next_meaningful(fits: Column, within: int) -> Column:
    """The first of the next lines that fits."""
    return F.first(F.when(fits, F.col("text")), ignorenulls=True).over(_by().rowsBetween(1, within))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, found before the shuffle; of rows equal in ``order`` the
    smallest."""
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*key).agg(F.min(row).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in df.columns])
