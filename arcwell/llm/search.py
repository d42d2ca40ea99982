"""Exact top-k inner-product search with dual cover trees.

Queries are taken in blocks bounded by bytes, each broadcast once and held against all
candidates where they lie: no vector is shuffled. In each task the block's query tree
meets cover trees of thousands of the task's own candidates (whatever size Spark's
batches have). A pair of nodes is pruned if the bound
``<q, c> + r_q |c| + r_c |q| + r_q r_c`` over its centres q, c and covering radii
can't reach the worst kth score of the node's queries; of a pair of leaves, only the
queries are multiplied whose own bound ``<q, c> + r_c |q|`` reaches their kth score.
These scores start from a bounded sample of candidates, so that pruning works from the
first node on. The best k a task finds for each query are merged by grouped aggregation.

Vectors whose products could pass 2**53 are multiplied as Python integers, they alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint

#: Bytes of a block of queries (broadcast), candidates in a tree, rows in a leaf, and
#: candidates that the first bounds come from.
QUERY_BYTES, TREE_ROWS, LEAF, SAMPLE = 32 << 20, 8_192, 128, 2_000
#: Integers are exact in float64 up to here.
EXACT = 2**53
LONG = 2**63 - 1


@dataclass
class Node:
    """Rows within ``radius`` of one of them, ``point``. Its children's centres are its
    own point (nesting) and others of its rows, at least ``scale`` apart (separation);
    each row belongs to the nearest, which is within ``scale`` (covering)."""

    point: int
    rows: np.ndarray
    radius: float
    norm: float
    scale: float = 0.0
    children: list[Node] = field(default_factory=list)
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None
    norms: np.ndarray | None = None


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, point: int | None = None, square: np.ndarray | None = None) -> Node:
    """A cover tree over points of ``x`` down to leaves of LEAF rows.

    A level's net is taken farthest point first until half the radius is covered, or
    until there are as many centres as the root of the number of rows, where a net of
    half the radius would hold nearly every point (high dimension). The level's scale is
    what the net covers then; farthest-first nets are that far apart at every length.
    """
    if rows is None:
        rows, square = np.arange(len(x)), np.einsum("ij,ij->i", x, x)
        middle = x.mean(0)
        point = int((square - 2 * (x @ middle)).argmin())
    own = x[rows]

    def away(p: int) -> np.ndarray:
        return np.sqrt(np.maximum(square[rows] + square[p] - 2 * (own @ x[p]), 0))

    near = away(point)
    node = Node(point, rows, float(near.max()), float(np.sqrt(square[point])))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    centers, owner = [point], np.zeros(len(rows), dtype=np.int64)
    while len(centers) < max(16, int(len(rows) ** 0.5)):
        far = int(near.argmax())
        if near[far] <= node.radius / 2:
            break
        d = away(int(rows[far]))
        closer = d < near
        near[closer], owner[closer] = d[closer], len(centers)
        centers.append(int(rows[far]))
    node.scale = float(near.max())
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(len(centers) + 1))
    node.children = [cover_tree(x, rows[order[a:b]], c, square) for c, a, b in zip(centers, cut[:-1], cut[1:], strict=True)]
    node.centers = x[centers]
    node.radii, node.norms = (np.array([getattr(c, k) for c in node.children]) for k in ("radius", "norm"))
    return node


class Best:
    """The best k of each query: scores and ids, worst last."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor.copy()  # known kth scores: what is below can't matter
        self.products = 0

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of rows x ids, without each query itself."""
        k = self.score.shape[1]
        self.products += scores.size
        use = (scores >= self.floor[rows][:, None]) & (own[:, None] != ids[None, :])
        for i in np.flatnonzero(use.any(1)):
            row, at = rows[i], np.flatnonzero(use[i])
            s, d = np.concatenate((self.score[row], scores[i, at])), np.concatenate((self.id[row], ids[at]))
            best = np.lexsort((d, -s))[:k]
            self.score[row], self.id[row] = s[best], d[best]
            self.floor[row] = max(self.floor[row], s[best[-1]])


def meet(a: Node, b: Node, queries: np.ndarray, q_norms: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Dual traversal of a pair that its caller's bound let through, the more promising
    children first. Radii and norms are rounded: a little is added to each bound so that
    nothing is lost."""
    if not a.children and not b.children:
        top = queries[a.rows] @ x[b.point] + q_norms[a.rows] * b.radius
        rows = a.rows[top + 1e-9 * (np.abs(top) + 1) >= best.floor[a.rows]]
        if len(rows):
            best.offer(rows, queries[rows] @ x[b.rows].T, ids[b.rows], q_ids[rows])
        return
    split = bool(a.children) and (not b.children or a.radius >= b.radius)
    many, one, point = (a, b, x[b.point]) if split else (b, a, queries[a.point])
    top = many.centers @ point + one.radius * many.norms + many.radii * one.norm + one.radius * many.radii
    top += 1e-9 * (np.abs(top) + 1)
    for k in np.argsort(-top):
        pair = (many.children[k], b) if split else (a, many.children[k])
        if top[k] >= best.floor[pair[0].rows].min():
            meet(*pair, queries, q_norms, q_ids, x, ids, best)


def search_block(queries: np.ndarray, q_ids: np.ndarray, tree: Node, x: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """All of ``x`` against all of ``queries``, the best of it into ``best``."""
    if len(ids) and len(q_ids):
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        other = cover_tree(x)
        top = queries[tree.point] @ x[other.point] + tree.radius * other.norm + other.radius * tree.norm + tree.radius * other.radius
        if top + 1e-9 * (abs(top) + 1) >= best.floor.min():
            meet(tree, other, queries, norms, q_ids, x, ids, best)


def exact_scores(queries: np.ndarray, x: np.ndarray) -> list[list[int]]:
    """Inner products as integers of any size, held to what a long can hold."""
    whole = [[int(v) for v in row] for row in x]
    return [[max(-LONG - 1, min(LONG, sum(p * int(q) for p, q in zip(row, own, strict=True)))) for row in whole] for own in queries]


def integers(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, dim): components floored after scaling; unusable vectors left out."""
    x = F.transform("embedding", lambda e: e.cast("double") * float(scale))
    fit = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    floored = F.transform(x, lambda e: F.when(F.abs(e) >= float(EXACT), e).otherwise(F.floor(e).cast("double")))
    return table.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), floored.alias("v"), F.size("embedding").alias("dim"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of TREE_ROWS rows or what a task has left, of batches of any size."""
    ids, x, held = [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, TREE_ROWS):
            piece = batch.slice(i, TREE_ROWS)
            ids.append(piece.column(0).to_numpy())
            x.append(_matrix(piece.column(1), dim))
            held += piece.num_rows
            if held >= TREE_ROWS:
                yield np.concatenate(ids), np.concatenate(x)
                ids, x, held = [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(x)


def _floors(queries: np.ndarray, q_ids: np.ndarray, s: np.ndarray, s_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth score among the sample: no better one is lost by asking for it."""
    floor = np.full(len(q_ids), -np.inf)
    if len(s_ids) > k:
        for i in range(0, len(q_ids), 1024):
            own = slice(i, i + 1024)
            products = queries[own] @ s.T
            products[q_ids[own, None] == s_ids[None, :]] = -np.inf
            floor[own] = -np.partition(-products, k - 1, axis=1)[:, k - 1]
    return floor


def top_k(table: DataFrame, k: int = 5, modulus: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other vectors for each
    vector whose id is divisible by ``modulus``, ties to the smaller id.

    Null and empty vectors, null ids, and vectors with a null or non-finite component (also
    one that scaling makes infinite) take no part; vectors of different lengths aren't
    compared. A query with fewer others gets them all. Rows that repeat an id are
    candidates each and are no partners of that id; a repeated query id is answered once
    per different vector. Scores are exact at any size; those beyond a long are the
    nearest long, and rank as such. Extra columns are ignored; an empty table gives no
    rows. A pass over the table serves QUERY_BYTES of queries.
    """
    spark = table.sparkSession
    held = integers(table, scale)
    most = F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))
    dims = held.groupBy("dim").agg(F.sum(F.when(F.col("vec_id") % modulus == 0, 1).otherwise(0)).alias("n"), most.alias("most")).collect()
    found = None
    for dim, n, largest in ((r["dim"], r["n"], r["most"]) for r in dims if r["n"]):
        tame = float(int((EXACT // dim) ** 0.5))
        wild = largest > tame
        own = held.where(F.col("dim") == dim).select("vec_id", "v")
        chosen = own.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)  # ids alone are ranked
        sample = own.join(F.broadcast(chosen), "vec_id", "left_semi").limit(2 * SAMPLE).toArrow()
        s_ids, s = sample.column(0).to_numpy(), _matrix(sample.column(1), dim)
        s_ids, s = (part[np.abs(s).max(1, initial=0) <= tame] for part in (s_ids, s))
        blocks = -(-n * dim * 8 // QUERY_BYTES)
        for block in range(blocks):
            part = own.where((F.col("vec_id") % modulus == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).distinct().toArrow()
            if not part.num_rows:
                continue
            q_ids, queries = part.column(0).to_numpy(), _matrix(part.column(1), dim)
            order = np.argsort(np.abs(queries).max(1) > tame, kind="stable")  # wild queries last
            q_ids, queries = q_ids[order], queries[order]
            calm = int((np.abs(queries).max(1) <= tame).sum())
            tree = cover_tree(queries[:calm]) if calm else None
            told = spark.sparkContext.broadcast((q_ids, queries, tree, _floors(queries[:calm], q_ids[:calm], s, s_ids, k)))

            def run(batches: Iterator[pa.RecordBatch], told=told, dim=dim, calm=calm, tame=tame, wild=wild) -> Iterator[pa.RecordBatch]:
                q_ids, queries, tree, floor = told.value
                best = Best(calm, k, floor)
                big: dict[int, list[tuple[int, int]]] = {}
                for ids, x in _trees(batches, dim):
                    fits = np.abs(x).max(1) <= tame if wild else np.ones(len(ids), bool)
                    search_block(queries[:calm], q_ids[:calm], tree, x[fits], ids[fits], best)
                    # Each pair with a wild side, by integers.
                    for rows, of in ((range(calm, len(q_ids)), fits), (range(len(q_ids)), ~fits)):
                        if len(rows) and of.any():
                            for row, scores in zip(rows, exact_scores(queries[rows.start :], x[of]), strict=True):
                                more = [(-s, int(i)) for s, i in zip(scores, ids[of], strict=True) if i != q_ids[row]]
                                big[row] = sorted(big.get(row, []) + more)[:k]
                row, rank = np.nonzero(best.score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(q_ids[row]), pa.array(best.id[row, rank]), pa.array(best.score[row, rank].astype(np.int64))], ["q", "query_id", "vec_id", "score"])
                flat = [(row, int(q_ids[row]), i, -s) for row, own in big.items() for s, i in own]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], ["q", "query_id", "vec_id", "score"])

            got = own.mapInArrow(run, "q long, query_id long, vec_id long, score long")
            order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
            got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            found = checkpoint(got) if found is None else found.union(checkpoint(got))
    if found is None:
        found = held.where(F.lit(False)).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    return found
