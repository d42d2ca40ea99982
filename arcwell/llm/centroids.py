"""Centroid clustering by sort-means.

In each round the driver orders, for each centroid, the others by distance from it, and
broadcasts centroids and orders (their number squared, whatever the table holds). A row
scans from its previous assignment c in c's order and stops at the first centroid that is
strictly farther from c than twice the row's distance to c: by the triangle inequality
that one and all behind it are strictly farther from the row than c, so that ties survive.

The previous assignment isn't stored: a task works it out again from the centroids of the
rounds before, which costs a row a few distances, where writing the rows each round would
cost the table. Every REPLAY rounds rows are written with their assignment instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint
from .vectors import PARTIAL, Sums, blocks, integers, means, partial, squared, tamed, usable

#: Rounds worked out again before assignments are written.
REPLAY = 4
LONG = 2**63 - 1


class Order:
    """Centroids, their squared distances and each one's others, nearest first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.apart = squared(centroids, centroids)
        ranked = np.argsort(self.apart, axis=1, kind="stable")
        self.others = [row[row != c] for c, row in enumerate(ranked)]


class Assignment:
    """Nearest centroids of ``x``, of equally near ones the smallest number, from ``was`` on;
    ``products`` counts the distances computed."""

    def __init__(self, x: np.ndarray, was: np.ndarray, order: Order):
        y = tamed(x, order.centroids)
        c = order.centroids.astype(y.dtype)
        own = np.square(y - c[was]).sum(1)
        self.best, self.at, self.products = own.copy(), was.copy(), len(x)
        for now in np.unique(was):
            rows = np.flatnonzero(was == now)
            for j in order.others[now]:
                rows = rows[order.apart[now, j] <= 4 * own[rows]]
                if not len(rows):
                    break
                d = np.square(y[rows] - c[j]).sum(1)
                self.products += len(rows)
                closer = (d < self.best[rows]) | ((d == self.best[rows]) & (j < self.at[rows]))
                self.best[rows[closer]], self.at[rows[closer]] = d[closer], j


def assign(x: np.ndarray, was: np.ndarray, orders: list[Order]) -> Assignment:
    """The assignment after the rounds of ``orders``, each from the one before."""
    for order in orders:
        found = Assignment(x, was, order)
        was = found.at
    return found


def _first(own: DataFrame, k: int, scale: int, seed: str) -> np.ndarray:
    """Vectors of the k smallest hashes of ``seed:vec_id``, ties in order of the vectors."""
    hashed = own.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    return integers(np.array([r["embedding"] for r in hashed.orderBy("h", "embedding").limit(k).collect()], np.float64), scale)


def sort_means(table: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every vector with exactly ``dim`` components, none null
    or non-finite; the centroids).

    Centroids start as the vectors of the ``k`` smallest hashes of their ids (null ids start
    none; fewer, if there are fewer; repeated ids each). Repeated rows and null ids are rows
    of their own. Without any starting vector no row is returned.
    """
    spark = table.sparkSession
    own = table.select(F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"))
    centroids = _first(own.where(usable("embedding", dim)), k, scale, seed)
    kind = own.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return own.where(F.lit(False)).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    rows = own.select("vec_id", F.lit(0).alias("was"), "embedding")
    orders = [Order(centroids)]
    for turn in range(rounds):
        told = spark.sparkContext.broadcast(orders)

        def add(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            sums = Sums(len(told.value[-1].centroids), dim)
            for (was,), x in blocks(batches, dim, scale):
                sums.add(assign(x, was.to_numpy().astype(np.int64), told.value).at, x)
            yield partial({0: sums})

        centroids = centroids.copy()
        for (_, c), mean in means(rows.select("was", "embedding").mapInArrow(add, PARTIAL), dim).items():
            centroids[c] = mean
        if (turn + 1) % REPLAY == 0:

            def note(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    column = batch.column(2)
                    for (ids, was, vectors), x in blocks(iter([pa.RecordBatch.from_arrays([*batch.columns, column], ["vec_id", "was", "embedding", "x"])]), dim, scale):
                        at = assign(x, was.to_numpy().astype(np.int64), told.value).at
                        yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), vectors], ["vec_id", "was", "embedding"])

            rows = checkpoint(rows.mapInArrow(note, f"vec_id {kind}, was int, embedding {own.schema['embedding'].dataType.simpleString()}"))
            orders = []
        orders = [*orders, Order(centroids)]
    told = spark.sparkContext.broadcast(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, was), x in blocks(batches, dim, scale):
            found = assign(x, was.to_numpy().astype(np.int64), told.value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.at, pa.int32()), pa.array(found.best.astype(np.int64))], ["vec_id", "cluster", "distance"])

    return checkpoint(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")), centroids


def digest(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256: one row a cluster comes
    to the driver and goes out again."""
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    shas = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in sums}
    told = [(c, min(d, LONG), min(sum(sums.values()), LONG), shas[c]) for c, d in sums.items()]
    facts = assigned.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """The same by all distances, on doubles that hold the integers exactly."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(CAST(list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * 1000 + c.c) AS m
  FROM v, c{i} c GROUP BY r)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT m % 1000 AS c, j, floor(sum(v.v[j]) / count(*)) AS x FROM a{i} JOIN v USING (r), (SELECT unnest(range(1, {dim + 1})) AS j) GROUP BY m % 1000, j),
n{i} AS (SELECT c, list(x ORDER BY j) AS v FROM m{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n{i}.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale}.0::DOUBLE * e::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
  SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})),
{", ".join(steps)},
found AS (SELECT vec_id, CAST(m % 1000 AS INTEGER) AS cluster, m // 1000 AS distance FROM a{rounds} JOIN v USING (r)),
sha AS (SELECT c, sha256(array_to_string(list_transform(v, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS h FROM c{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM found JOIN sha ON cluster = c
"""
