"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; ``run`` writes each result as Parquet in the shared folder and reads it back.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwell.llm import langid, mixing, neardup, packing, substring
from arcwell.llm.shared import checkpoint, drop_folder, drop_ids, shared_folder, ship, small


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; each row without one goes, whatever its id.

    Null, empty and letterless texts go; null declarations and sources are no evidence;
    repeated rows share one verdict; a row whose doc_id is null or shared is judged like
    any other; other columns of any name are kept as they are; no rows give no rows. Rows
    are named by a 64-bit hash of all that their verdict depends on, nulls too.
    """
    ship(spark)
    parts = ["doc_id", "text", "lang", "source"]
    named = docs.select(whole(docs), *parts, F.xxhash64(*parts, *[F.col(x).isNull() for x in parts]).alias("row"))
    told = langid.identify(named.select(F.col("row").alias("doc_id"), "text", "lang", "source"), F.col("lang"), F.col("source"))
    rejected = told.where("rejected").select(F.col("doc_id").alias("row")).distinct()
    return named.select("doc", "row").join(small(checkpoint(rejected)), "row", "left_anti").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one of the smallest id.

    Texts that are null, empty or without words are alike to nothing and stay. Of rows
    that share a kept doc_id one stays, one of the least text; rows with a null doc_id all
    stay. Other columns of any name are kept as they are; no rows give no rows.
    """
    ship(spark)
    told = checkpoint(neardup.near_duplicates(docs.select("doc_id", "text")))
    gone = told.where("NOT kept").select("doc_id").distinct()
    repeated = checkpoint(told.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    kept = drop_ids(docs.select(whole(docs), F.col("doc_id").cast("long").alias("doc_id")), gone)
    if repeated.isEmpty():
        return kept.select("doc.*")
    once = kept.join(small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("doc", F.struct("doc.text")).alias("doc"))
    return drop_ids(kept, repeated).select("doc").unionByName(once.select("doc")).select("doc.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that a document of a smaller id has.

    Null, empty and short texts stay as they are, and rows with a null doc_id; rows that
    repeat a doc_id don't remove from each other. n_chars follows the text; other columns
    of any name are kept as they are; no rows give no rows.
    """
    ship(spark)
    return substring.strip(docs, 50)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says, up to twice.

    A null source is a source of its own; null and empty texts have no words, and a source
    without words goes; repeated rows and equal ids are drawn alike. Other columns of any
    name are kept as they are; no rows give no rows.
    """
    ship(spark)
    return mixing.materialise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: where each piece of each document lies, see ``packing.pack``.

    Null and empty texts are one closing id; rows that repeat an id and rows without one
    are packed each; other columns are ignored; no rows give no rows.
    """
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2048)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the language model, similarity and packing stages: tests hold
#: the pipeline against brute force.
ORACLE_SQL = None


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``doc``: no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. Each stage's table goes once the
    next one is written; the last one's stays, as the result is read from it."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
