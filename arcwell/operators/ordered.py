"""Positions and predecessors in a total order of all rows, without one task for all.

Rows are dealt by ranges of the order and written, so that a range stays what it is; each
range counts by itself, and one row a range tells the next ones where they begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import checkpoint


def _ranges(d: DataFrame, order: list[Column]) -> DataFrame:
    return checkpoint(d.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def with_position(d: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``d`` with ``name``, each row's place (from 1) in ``order``, which must be total."""
    parts = _ranges(d, order)
    begun = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("_part").agg(F.count("*").alias("n")).select("_part", begun.alias("_begun"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_begun")
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, place.cast("int")).drop("_part", "_begun")


def with_previous(d: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``d`` with ``name``, the ``value`` of the row before in the total order of these columns;
    null for the first."""
    parts = _ranges(d, [F.col(c) for c in order])
    held = F.struct(F.col(value).alias("v"))
    last = parts.groupBy("_part").agg(F.max_by(held, F.struct(*order)).alias("_last"))
    carried = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))
    before = F.lag(held).over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(carried), "_part").withColumn(name, F.coalesce(before, "_before")["v"]).drop("_part", "_before")
