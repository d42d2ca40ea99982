"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, codes, langid, mixing, neardup, packing, quality, search, substring, tokens, toxicity, urls, webp
from .shared import checkpoint, ship, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies, see ``packing.pack``: null text is the closing id
    alone, repeats and null ids are packed each, no rows give no rows."""
    return packing.pack(table(ship(spark), sf_dir, "documents"), VOCABULARY, PATTERN, 2048)


def op2_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document, see ``neardup.near_duplicates``: null and wordless texts
    stand alone, repeats of an id are one node, no rows give no rows."""
    return neardup.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document, see ``toxicity.score``: null and wordless texts score by the
    bias, repeats alike, 0.5 without labels, no rows give no rows."""
    return toxicity.score(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, see ``mixing.mix``: a null source is one, null texts
    have size 0, equal ids are drawn alike, no rows give no rows."""
    return mixing.mix(table(ship(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each page, see ``urls.judge``: a null URL has no host and no rule, repeats
    are judged alike, no rows give no rows."""
    return urls.judge(table(ship(spark), sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of each query, see ``search.top_k``: unusable vectors take no part, ties go to
    the smaller id, no rows give no rows."""
    return search.top_k(table(ship(spark), sf_dir, "embeddings"), 5)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, see ``tokens.token_counts``: null and empty texts have none,
    repeats are counted each, no rows give no rows."""
    return tokens.token_counts(table(ship(spark), sf_dir, "documents"), VOCABULARY, PATTERN)


def op8_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forms of each text, see ``webp.media``: a null text is an empty one, equal texts
    have equal rows, no rows give no rows."""
    return webp.media(table(ship(spark), sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, see ``langid.identify_pages``."""
    return langid.identify_pages(table(ship(spark), sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses, see ``substring.digest``: null, empty and short texts lose
    nothing, nor do rows of one id to each other, no rows give no rows."""
    return substring.digest(table(ship(spark), sf_dir, "documents"), 50)


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each usable vector, see ``codes.fit`` and ``codes.encode``: unusable vectors
    take no part, null labels are one label, repeats are rows of their own, a table without a
    usable vector gives no rows."""
    vectors = table(ship(spark), sf_dir, "embeddings")
    books = codes.fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    sha = hashlib.sha256(books.text().encode()).hexdigest()
    coded = codes.label_errors(checkpoint(codes.encode(vectors, books)))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector of 64 components, see ``centroids.sort_means``: unusable
    vectors take no part, repeats are rows of their own, no usable vector gives no rows."""
    return centroids.digest(*centroids.sort_means(table(ship(spark), sf_dir, "embeddings")))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document, see ``quality.judge``: null and wordless texts
    fail the base, a null source is no host, repeats are judged each, no rows give no rows."""
    return quality.digest(table(ship(spark), sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_best_fit_packing, op2_setsketch_near_dedup, op3_ftrl_toxicity, op4_source_mixing, op5_url_filters, op6_exact_top_k, op7_token_counts, op8_lossless_webp, op9_language_id, op10_substring_dedup, op11_product_codes, op12_sort_means, op13_host_rules]
    return {f.__name__: f for f in own}


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256.0::DOUBLE * e::DOUBLE) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": mixing.ORACLE_SQL, "op6_exact_top_k": OP6_SQL, "op11_product_codes": codes.oracle_sql(), "op12_sort_means": centroids.oracle_sql(), "op13_host_rules": quality.ORACLE_SQL}
