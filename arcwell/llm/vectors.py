"""Blocks of integer vectors out of Arrow batches, exact squared distances and means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, whatever size Spark's batches have.
BLOCK_ROWS = 8_192
#: Components beyond this, after scaling and flooring, are held at it: four times the squared
#: distance of two vectors of 64 components then fits a long.
MOST = 1 << 26
#: Integers are exact in float64 up to here.
EXACT = 2**53


def usable(column: str, dim: int | None = None) -> Column:
    """Whether a vector is neither null nor holds a null or non-finite component."""
    fit = F.forall(F.col(column), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    sized = F.size(column) > 0 if dim is None else F.size(column) == dim
    return F.coalesce(F.col(column).isNotNull() & sized & fit, F.lit(False))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values * float(scale)), -MOST, MOST).astype(np.int64)


def matrix(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``column`` that are usable vectors of ``dim`` components, these as integers)."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    flat = column.filter(fit).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(flat).all(1)
    return np.flatnonzero(fit.to_numpy(zero_copy_only=False))[finite], integers(flat[finite], scale)


def blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """(other columns, vectors) of at most BLOCK_ROWS rows; the last column has the vectors."""

    def block(held: list[pa.RecordBatch]) -> tuple[list[pa.Array], np.ndarray]:
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in pa.Table.from_batches(held).columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        at, x = matrix(columns[-1], dim, scale)
        return [c.take(pa.array(at)) for c in columns[:-1]], x

    held, n = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            held.append(batch.slice(i, BLOCK_ROWS))
            n += held[-1].num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
    if n:
        yield block(held)


def tamed(x: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """``x`` as float64 where sums of squared differences with the others, and four times
    these, are exact there; else as it is, in 64-bit integers."""
    largest = max((int(np.abs(y).max(initial=0)) for y in (x, *others)), default=0)
    return x.astype(np.float64) if 16 * x.shape[1] * largest * largest < EXACT else x


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, rows of x by rows of y."""
    if x.dtype == np.float64:
        y = y.astype(np.float64)
        return np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ y.T) + np.einsum("ij,ij->i", y, y)
    return np.stack([np.square(x - row).sum(1) for row in y], axis=1) if len(y) else np.zeros((len(x), 0), np.int64)


class Sums:
    """Number of rows and componentwise sums by group, as integers."""

    def __init__(self, groups: int, dim: int):
        self.n, self.sums = np.zeros(groups, np.int64), np.zeros((groups, dim), np.int64)

    def add(self, at: np.ndarray, x: np.ndarray) -> None:
        k = len(self.n)
        self.n += np.bincount(at, minlength=k)
        for j in range(x.shape[1]):  # a block's sum is below 2**53
            self.sums[:, j] += np.bincount(at, weights=x[:, j], minlength=k).astype(np.int64)


def partial(groups: dict[int, Sums]) -> pa.RecordBatch:
    """The sums that a task has, one row a group that has rows: part, entry, n, sums."""
    flat = [(p, int(e), int(s.n[e]), s.sums[e]) for p, s in groups.items() for e in np.flatnonzero(s.n)]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in flat], t) for i, t in enumerate(types)], ["part", "entry", "n", "sums"])


PARTIAL = "part int, entry int, n long, sums array<long>"


def means(partials: DataFrame, dim: int) -> dict[tuple[int, int], list[int]]:
    """floor(sum / count) of every group that has rows. Tasks send a row a group; what comes
    to the driver is a row a group too, as many as the codebooks have entries."""
    added = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
    found = partials.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()
    return {(r["part"], r["entry"]): [int(r[f"s{j}"]) // r["n"] for j in range(dim)] for r in found}
