"""Mixing sources to target weights, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint, small

WORD = "[^\\x20\\x09-\\x0D]+"


ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def sized(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, source, size): all columns of a row are one struct, so that no name of
    theirs meets one of ours."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), words.alias("size"))


def goals(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, rate), a row a source, from (source, size)."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)).cast("int") + 1)
    weighed = totals.withColumn("weight", weigh).withColumn("cap", most * F.col("source_size"))
    # In order of cap per weight the full sources come first: one pass finds the level.
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    # The level rises while full sources are set aside and falls after: its top is it.
    leveled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    out = leveled.select("source", "source_size", F.least(F.col("weight") * F.col("level"), "cap").alias("target"))
    return out.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))


def _rated(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str) -> DataFrame:
    """The rows of ``sized`` with their source's goal and their copies. The goals, a row a
    source, are broadcast while they are few, so that no text is shuffled."""
    rows = sized(docs)
    goal = small(checkpoint(goals(rows.select("source", "size"), weights, share, most))).withColumnRenamed("source", "of")
    met = rows.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    copies = F.floor("rate") + (drawn < F.col("rate") - F.floor("rate")).cast("long")
    return met.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """All columns of ``docs`` (same-named ones replaced) and size, source_size,
    target, rate, copies, taken.

    Sizes are words; a null or empty text has 0 and is taken 0 times its size. Sources
    in code-point order, null last (a source of its own), weigh ``weights`` in turn and
    share ``share`` times all words; none gets more than ``most`` times its own, and
    what it leaves is shared by the others by weight. A source without words has target
    and rate 0. Each document is taken floor(rate) times and once more if a hash of its
    doc_id falls below the fraction, so reruns agree and repeated rows are taken alike.
    An empty table gives no rows.

    The targets come from one row per source: rows are summed before any shuffle, and a
    source of any size is one number.
    """
    met = _rated(docs, weights, share, most, seed).withColumn("taken", F.col("size") * F.col("copies"))
    return met.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in ADDED], *ADDED)


def materialise(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns unchanged whatever their
    names, as often as ``mix`` takes it."""
    met = _rated(docs, weights, share, most, seed).where("copies > 0")
    return met.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn")).select("doc.*")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         2.0::DOUBLE * source_size AS cap FROM totals),
leveled AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM totals)
             - coalesce(sum(cap) OVER w, 0.0::DOUBLE)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS lvl
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         least(weight * (SELECT max(lvl) FROM leveled), cap)::DOUBLE AS target FROM leveled),
rated AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS rate FROM goals)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST(d.size * (floor(rate) + CASE WHEN CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)
       / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""
