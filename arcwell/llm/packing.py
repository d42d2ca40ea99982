"""Best-fit packing of tokenized documents with Martello-Toth dominance reduction.

Only the count of pieces of each length reaches the driver: at most ``capacity``
numbers at any size of corpus. The plan made from them says, for runs of equal
pieces, in which run of sequences they lie and at what offset; executors then look
up each piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint
from .textscan import chunks
from .tokens import encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int) -> DataFrame:
    told = vocabulary(docs, path, pattern)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(told)
        for batch, texts in chunks(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode([(t or b"").decode() for t in texts]), strict=True):
                ids += b"\0\0\0\0"
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class Plan:
    """Runs of equal pieces and the runs of sequences that they go to."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.rank = np.zeros(capacity + 1, dtype=np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.sequences = 0
        self.fixed = 0
        self.reduce()
        self.best_fit()

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.rank[length]), n, sequence, offset))
        self.rank[length] += n
        self.left[length] -= n

    def fix(self, *lengths: int, n: int) -> None:
        """n sequences, each of these pieces, for good."""
        offset = 0
        for length in lengths:
            self.put(length, n, self.sequences, offset)
            offset += length
        self.sequences += n
        self.fixed += n

    def largest(self, room: int) -> int:
        """The largest length left of at most ``room``; 0 if none."""
        at = np.flatnonzero(self.left[1 : room + 1]) if room > 0 else ()
        return int(at[-1]) + 1 if len(at) else 0

    def smallest_two(self, above: int = 0) -> tuple[int, int]:
        """The two smallest pieces longer than ``above`` (capacity + 1 for none)."""
        at = np.flatnonzero(self.left[above + 1 :])[:2] + above + 1
        none = self.capacity + 1
        if not len(at):
            return none, none
        first = int(at[0])
        return (first, first) if self.left[first] > 1 else (first, int(at[1]) if len(at) > 1 else none)

    def best_pair(self, room: int) -> int:
        """The largest sum of two pieces left that fits."""
        at = np.flatnonzero(self.left[: room + 1])
        best, hi = 0, len(at) - 1
        for lo in range(len(at)):
            while hi >= lo and at[lo] + at[hi] > room:
                hi -= 1
            if hi < lo:
                break
            k = hi if hi > lo or self.left[at[lo]] > 1 else hi - 1
            if k >= lo:
                best = max(best, int(at[lo] + at[k]))
        return best

    def reduce(self) -> None:
        """Fix sets that dominate every other feasible set of their largest piece.

        For the largest piece j and the room r beside it: alone if nothing fits;
        {j, k} with k the largest that fits, if k fills r, if no two pieces fit
        together, or if k is at least the best fitting pair while no three fit; and
        {j, a, b} with a the largest that fits and b the largest that fits beside
        both, if no three fit and no fitting pair's smaller piece exceeds b. Each
        replaces any other set by exchanging pieces for ones no shorter, so some best
        packing holds it.
        """
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                n, room = int(self.left[length]), self.capacity - length
                self.left[length] -= 1
                k = self.largest(room)
                one, two = self.smallest_two()
                three = one + two + self._third(one, two)
                couple = a = b = 0
                if k and k != room and one + two <= room and three > room:
                    couple = self.best_pair(room)
                    if couple > k:
                        a = k
                        self.left[a] -= 1
                        b = self.largest(room - a)
                        self.left[a] += 1
                        p, q = self.smallest_two(b)
                        if not b or p + q <= room:
                            a = b = 0
                self.left[length] += 1
                if not k:
                    self.fix(length, n=n)
                elif k == room or one + two > room or (three > room and couple <= k):
                    self.fix(length, k, n=n // 2 if k == length else min(n, int(self.left[k])))
                elif a:
                    uses = Counter((length, a, b))
                    self.fix(length, a, b, n=min(int(self.left[x]) // k for x, k in uses.items()))
                else:
                    break

    def _third(self, one: int, two: int) -> int:
        """The third smallest piece left."""
        least = np.flatnonzero(self.left)[:3]
        flat = np.repeat(least, np.minimum(self.left[least], 3))[:3]
        return int(flat[2]) if len(flat) > 2 else self.capacity + 1

    def best_fit(self) -> None:
        """Best-fit decreasing over what is left: each run of equal pieces goes to the
        fullest sequences with room, run by run."""
        free: dict[int, list[tuple[int, int]]] = {}  # room: runs of sequences (first, count)
        for length in range(self.capacity, 0, -1):
            room = length
            while self.left[length]:
                room = next((r for r in range(room, self.capacity + 1) if free.get(r)), 0)
                if not room:
                    fit = self.capacity // length
                    n = max(1, int(self.left[length]) // fit)
                    free.setdefault(self.capacity, []).append((self.sequences, n))
                    self.sequences += n
                    room = self.capacity
                first, count = free[room].pop()
                n = min(count, int(self.left[length]))
                self.put(length, n, first, self.capacity - room)
                if n < count:
                    free[room].append((first + n, count - n))
                if room > length:
                    free.setdefault(room - length, []).append((first, n))
                room = length
        self.runs.sort()

    def table(self) -> np.ndarray:
        return np.array(self.runs, dtype=np.int64).reshape(-1, 5)


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity).table()
    starts = {int(x): i for i, x in reversed(list(enumerate(plan[:, 0])))}
    ends = {int(x): i + 1 for i, x in enumerate(plan[:, 0])}
    told = spark.sparkContext.broadcast((plan, starts, ends))

    # Ranks within a length: counted in shares by a hash, so that no length is one group.
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))).cast("int")
    shared = cut.withColumn("share", share)
    sizes = shared.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("length", "share", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = shared.withColumn("within", within).join(base, ["length", "share"])

    @F.pandas_udf("sequence_id long, offset long")
    def look(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        runs, at, to = told.value
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for size in np.unique(lengths):
            own = np.flatnonzero(lengths == size)
            part = runs[at[int(size)] : to[int(size)]]
            k = np.searchsorted(part[:, 1], ranks[own], side="right") - 1
            sequence[own] = part[k, 3] + ranks[own] - part[k, 1]
            offset[own] = part[k, 4]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("at", look("length", F.col("base") + F.col("within") - 1)).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``capacity`` ids.

    A document's ids are its tokens and a closing 0; a null or empty text is that one
    0. Longer ones are cut into full pieces after a first one that may be shorter.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated
    rows are packed each; rows with a null doc_id too; extra columns are ignored; an
    empty table gives no rows.
    """
    return place(checkpoint(pieces(docs, path, pattern, capacity)), capacity)
