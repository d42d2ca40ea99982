"""Vector code compression: product codes with a kd-tree per codebook.

A vector is cut into equal parts, and each part becomes the number of its nearest
codebook entry. In each round the driver builds one kd-tree a codebook and broadcasts
them (as large as the codebooks, whatever the table holds); tasks search them for blocks
of rows and send one row of integer sums an entry; the entries become their means.

The search is branch and bound: a node is left out for a row only if its box is strictly
farther than the row's best so far, so that nodes of equal bound are visited and the entry
of the lowest index wins a tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_one
from .vectors import PARTIAL, Sums, blocks, integers, means, partial, squared, tamed, usable

#: Entries of a leaf.
LEAF = 32
LONG = 2**63 - 1


@dataclass
class Node:
    """Entries ``rows`` (ascending) in the box from ``low`` to ``high``; those of ``left``
    are at most ``cut`` in component ``axis``, those of ``right`` at least."""

    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axis: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(entries: np.ndarray, rows: np.ndarray | None = None) -> Node:
    rows = np.arange(len(entries)) if rows is None else np.sort(rows)
    own = entries[rows]
    node = Node(rows, own.min(0), own.max(0))
    wide = node.high - node.low
    if len(rows) > LEAF and wide.any():
        node.axis = int(wide.argmax())
        order = rows[np.argsort(own[:, node.axis], kind="stable")]
        half = len(rows) // 2
        node.cut = int(entries[order[half], node.axis])
        node.left, node.right = kd_tree(entries, order[:half]), kd_tree(entries, order[half:])
    return node


class Search:
    """Nearest entries of the rows of ``x``; ``products`` counts the distances computed."""

    def __init__(self, x: np.ndarray, entries: np.ndarray, tree: Node):
        self.x, self.entries = tamed(x, entries), entries
        self.best = np.full(len(x), np.inf) if self.x.dtype == np.float64 else np.full(len(x), LONG, np.int64)
        self.at = np.zeros(len(x), np.int64)
        self.products = 0
        self._visit(tree, np.arange(len(x)))

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        own = self.x[rows]
        bound = np.square(np.maximum(node.low - own, 0) + np.maximum(own - node.high, 0)).sum(1)
        rows = rows[bound <= self.best[rows]]
        if not len(rows):
            return
        if node.left is None:
            away = squared(self.x[rows], self.entries[node.rows])
            self.products += away.size
            first = away.argmin(1)
            d, at = away[np.arange(len(rows)), first], node.rows[first]
            closer = (d < self.best[rows]) | ((d == self.best[rows]) & (at < self.at[rows]))
            self.best[rows[closer]], self.at[rows[closer]] = d[closer], at[closer]
            return
        low = self.x[rows, node.axis] <= node.cut
        for child, own in ((node.left, rows[low]), (node.right, rows[~low]), (node.right, rows[low]), (node.left, rows[~low])):
            if len(own):
                self._visit(child, own)


@dataclass
class Codebooks:
    """``entries[p]`` has the entries of part p as rows of integers."""

    entries: np.ndarray
    scale: int

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, len(self.entries), axis=1)

    def text(self) -> str:
        return ",".join(str(v) for v in self.entries.ravel().tolist())


def _first(table: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """Parts of the vectors of the smallest ids. Ids alone are ranked among all rows, then
    the vectors of these few are fetched."""
    own = table.select(F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding")).where(usable("embedding") & F.col("vec_id").isNotNull())
    least = own.select("vec_id", F.size("embedding").alias("dim")).orderBy("vec_id", "dim").first()
    if least is None or least["dim"] % parts:
        return None
    own = own.where(F.size("embedding") == least["dim"])
    ids = own.select("vec_id").orderBy("vec_id").limit(entries).distinct()
    chosen = own.join(F.broadcast(ids), "vec_id", "left_semi").orderBy("vec_id", "embedding").limit(entries).collect()
    x = integers(np.array([r["embedding"] for r in chosen], np.float64), scale)
    return Codebooks(np.stack(np.split(x, parts, axis=1)), scale)


def fit(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds; None where no row can start one (an empty table, no
    usable vector, or a first vector that can't be cut into equal parts).

    Each codebook starts as its part of the ``entries`` usable vectors of the smallest ids
    (null ids start none; equal ids in order of their vectors, repeats counted; fewer, if
    there are fewer). Vectors of another length than the first one's take no part. An entry
    that no part is nearest to stays. A table is read once a round; nothing of it is kept.
    """
    spark = table.sparkSession
    books = _first(table, parts, entries, scale)
    if books is None:
        return None
    rows, dim = table.select("embedding"), books.dim
    for _ in range(rounds):
        told = spark.sparkContext.broadcast((books.entries, [kd_tree(e) for e in books.entries]))

        def add(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            entries, trees = told.value
            sums = {p: Sums(len(e), e.shape[1]) for p, e in enumerate(entries)}
            for _, x in blocks(batches, dim, scale):
                for p, own in enumerate(np.split(x, len(entries), axis=1)):
                    sums[p].add(Search(own, entries[p], trees[p]).at, own)
            yield partial(sums)

        entries_now = books.entries.copy()
        for (part, entry), mean in means(rows.mapInArrow(add, PARTIAL), dim // parts).items():
            entries_now[part, entry] = mean
        books = Codebooks(entries_now, scale)
    return books


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over
    parts) of every usable vector of the codebooks' length, repeats and null ids as rows of
    their own."""
    told = table.sparkSession.sparkContext.broadcast((books.entries, [kd_tree(e) for e in books.entries]))
    dim, scale = books.dim, books.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, trees = told.value
        for (ids, labels), x in blocks(batches, dim, scale):
            code, error = np.zeros((len(x), len(entries)), np.uint8), np.zeros(len(x), np.int64)
            for p, own in enumerate(np.split(x, len(entries), axis=1)):
                found = Search(own, entries[p], trees[p])
                code[:, p] = found.at
                error += found.best.astype(np.int64)
            text = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    own = table.select("vec_id", "label", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    return own.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector (array of double) that its code stands for: entries over scale."""
    told = coded.sparkSession.sparkContext.broadcast(books.entries / books.scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digits = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(batch.num_rows, -1)
            flat = np.concatenate([part[digits[:, p]] for p, part in enumerate(told.value)], axis=1)
            offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat.ravel())], ["vec_id", "embedding"])

    own = coded.select("vec_id", "code")
    return own.mapInArrow(run, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, embedding array<double>")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error of all rows of its label (null is one). Rows
    are summed before they are shuffled; hot labels meet a broadcast of their sums."""
    keyed = coded.withColumn("_key", F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("label").cast("string"))))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long")
    totals = keyed.groupBy("_key").agg(total.alias("label_error"), F.count("*").alias("_rows"))
    return join_one(keyed, totals, "_key", "_rows").drop("_key", "_rows")


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by all distances, on doubles that hold the integers exactly."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, x.p, min(CAST(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.v) + list_inner_product(b.v, b.v) AS BIGINT) * 1000 + b.e) AS m
  FROM x JOIN b{i} b ON x.p = b.p GROUP BY r, x.p)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT x.p, m % 1000 AS e, j, floor(sum(x.v[j]) / count(*)) AS s
  FROM a{i} a JOIN x ON a.r = x.r AND a.p = x.p, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS j) GROUP BY x.p, m % 1000, j),
n{i} AS (SELECT p, e, list(s ORDER BY j) AS v FROM m{i} GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN n{i} n ON b.p = n.p AND b.e = n.e)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda e: floor({scale}.0::DOUBLE * e::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM v, (SELECT unnest(range({parts})) AS p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM v WHERE vec_id IS NOT NULL ORDER BY e LIMIT {entries}),
b0 AS MATERIALIZED (SELECT p, e, x.v FROM first JOIN x USING (r)),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', m % 1000), '' ORDER BY p) AS code, CAST(sum(m // 1000) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN v USING (r), sha
"""
