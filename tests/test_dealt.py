"""Rows are dealt over all cores before each becomes much work, and walked once."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcwell import text_queries
from arcwell.plans import shapes
from arcwell.sources import dbsource


def test_rows_are_dealt_before_the_walk(spark, tmp_path):
    """A small table comes as one task; the texts made of its rows are walked in many."""
    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    d = shapes.pick(spark, str(tmp_path), "customer", "c_custkey", ["a<k>", "b<k>"])
    assert d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["text"] for r in d.collect()) == sorted(f"{'ab'[k % 2]}{k}" for k in range(40))


def test_units_are_walked_once_and_say_their_own(spark):
    """Two routines of one name on one line: neither has the other's tables."""
    text = "CREATE PACKAGE BODY k AS PROCEDURE p IS BEGIN DELETE FROM A1; END; PROCEDURE p(x NUMBER) IS BEGIN UPDATE B1 SET y = 1; END; END;\n"
    d = dbsource.object_facts(dbsource.units(spark.createDataFrame([("k.sql", text), ("none.sql", None)], "file string, text string")))
    assert d._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted((r["type"], r["params"] or "", r["tables_read"], r["tables_written"]) for r in d.collect())
    assert got == [("package body", "", [], []), ("procedure", "", ["A1"], ["A1"]), ("procedure", "x NUMBER", [], ["B1"])]


def test_files_of_calls_are_dealt(spark, tmp_path):
    """Path and text of a row come together, without a join, over all cores."""
    spark.range(33).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    d = shapes.pick_files(spark, str(tmp_path), "customer", "c_custkey", [("a<k>.java", "x<k>"), ("b<k>.js", "y<k>")])
    assert d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "Join" not in text_queries.routine_call_forms(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert {(r["file"], r["text"]) for r in d.collect()} == {(f"a{k}.java", f"x{k}") if k % 2 == 0 else (f"b{k}.js", f"y{k}") for k in range(33)}
