"""The driver's tables as facts of the engine: typed edges, commits, lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import with_previous
from .session import table


def _edges(df: DataFrame, a: str, ak: str, b: str, bk: str, via: str, sure=None) -> DataFrame:
    """One edge per pair of keys; resolved wins. Keys are told apart as they are in the table,
    and become ids after the shuffle."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = d.select(a, b).distinct() if sure is None else d.groupBy(a, b).agg(F.max(F.when(sure, 1).otherwise(0)).alias("_sure"))
    c = F.lit("resolved") if sure is None else F.when(F.col("_sure") == 1, "resolved").otherwise("inferred")
    return d.select(F.concat(F.lit(ak + ":"), F.col(a).cast("string")).alias("from_id"), F.concat(F.lit(bk + ":"), F.col(b).cast("string")).alias("to_id"), F.lit(ak).alias("from_kind"), F.lit(bk).alias("to_kind"), F.lit(via).alias("via"), c.alias("confidence"))


def typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The star schema as a dependency graph of six families. No two of them have the same kinds
    of ends, so that edges repeat within a family alone."""
    line = table(spark, sf, "lineitem")
    families = (
        _edges(table(spark, sf, "nation"), "n_nationkey", "nation", "n_regionkey", "region", "belongs-to"),
        _edges(table(spark, sf, "customer"), "c_custkey", "customer", "c_nationkey", "nation", "belongs-to"),
        _edges(table(spark, sf, "supplier"), "s_suppkey", "supplier", "s_nationkey", "nation", "belongs-to"),
        _edges(table(spark, sf, "orders"), "o_orderkey", "order", "o_custkey", "customer", "call", F.col("o_orderstatus") == "F"),
        _edges(line, "l_orderkey", "order", "l_suppkey", "supplier", "reads"),
        _edges(line, "l_orderkey", "order", "l_partkey", "part", "reads"),
    )
    return reduce(DataFrame.unionByName, families)


def upper_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The three small families alone."""
    return typed_edges(spark, sf).where("via = 'belongs-to'")


def user_steps(spark: SparkSession, sf: str, least: int) -> DataFrame:
    """Consecutive users of the event log, kept when seen ``least`` times."""
    e = with_previous(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["ts", "event_id"], "user_id", "before").where("before IS NOT NULL AND before <> user_id")
    e = e.groupBy("before", "user_id").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    return e.select(F.format_string("u%d", "before").alias("from_id"), F.format_string("u%d", "user_id").alias("to_id"), "weight", F.lit("next").alias("via"), F.lit("resolved").alias("confidence"))


def nation_trade(spark: SparkSession, sf: str, share: float = 0.05) -> DataFrame:
    """Supplier nation to customer nation where it holds ``share`` of the supplier
    nation's lines or more."""
    line, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    d = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = d.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("weight"))
    w = w.withColumn("total", F.sum("weight").over(Window.partitionBy("s_nationkey"))).where((F.col("weight") >= share * F.col("total")) & (F.col("s_nationkey") != F.col("c_nationkey")))
    return w.select(F.format_string("n%d", "s_nationkey").alias("from_id"), F.format_string("n%d", "c_nationkey").alias("to_id"), "weight", F.lit("trade").alias("via"), F.lit("resolved").alias("confidence"))


def touches(spark: SparkSession, sf: str) -> DataFrame:
    """Events as commits: file = user, author = event type, added = value."""
    return table(spark, sf, "events").select(F.format_string("u%d", "user_id").alias("file"), F.col("event_type").alias("author"), F.to_date("ts").alias("day"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("added"), F.lit(1).cast("long").alias("deleted"))


def shares(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier by brand as author by module."""
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy(F.col("p_brand").alias("module"), F.format_string("s%d", "l_suppkey").alias("author")).agg(F.count("*").alias("touches"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files: complexity = size, lines = quantity, coupling = orders, suppliers."""
    d = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("coupling_in"), F.count_distinct("l_suppkey").alias("coupling_out"), F.sum("l_quantity").cast("long").alias("lines"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("module"), F.col("p_size").cast("long").alias("complexity"))
    return p.join(d, F.col("p_partkey") == F.col("l_partkey")).select(F.format_string("p%d", "p_partkey").alias("file"), "module", "complexity", (F.col("complexity") - 10).alias("cognitive"), "lines", "coupling_in", "coupling_out")


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Users as files: commits, fixes (errors), complexity (types), coupling (days)."""
    return table(spark, sf, "events").groupBy(F.format_string("u%d", "user_id").alias("file")).agg(F.count("*").alias("commits"), F.count_if(F.col("event_type") == "error").alias("fixes"), F.count_distinct("event_type").alias("complexity"), F.count_distinct(F.to_date("ts")).alias("coupling"))


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.format_string("doc/%d", "doc_id").alias("file"), "text")


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.format_string("page/%d", "page_id").alias("file"), "url", F.col("html").alias("text"))


def memory(spark: SparkSession, sf: str) -> DataFrame:
    """Events as memory entries: entity = key of props, purchase worked, error failed."""
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.format_string("u%d", "user_id").alias("entity"), F.col("event_type").alias("kind"), F.coalesce("props", F.lit("")).alias("summary"), F.when(F.col("event_type") == "purchase", "worked").when(F.col("event_type") == "error", "failed").otherwise("none").alias("result"))
