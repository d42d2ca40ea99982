"""Near-duplicate components by SetSketch registers.

1. Each document's set of shingle hashes is reduced to a signature (equal sets, equal
   signatures) and to SetSketch registers. Documents of equal sets are represented by
   the smallest doc_id.
2. Bands of registers are grouped. In each group that holds more than one set, every
   document is paired with one pivot only: first the smallest doc_id, then the one
   with the most links so far; of its pivots, a document is held against those that
   it shares the most groups with (what this leaves out, step 3 finishes). A joint likelihood estimate from all registers drops
   hopeless pairs; the others are confirmed on their full sets.
3. Groups that are one component by then are done: no other pair in them can change
   the answer. The documents of the others are finished exactly by a prefix-filter
   join, where a pair within the threshold must share one of its rarest shingles, at
   places that leave room for enough others.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import checkpoint, small
from .textscan import Words, chunks, mix, powers

#: 48 bands of 5 registers: a pair at 0.75 shares 11 of them on average, and none once in
#: 400,000 pairs, (1 - 0.75**5)**48; a test measures the 0.75**5.
BANDS, ROWS = 48, 5
#: SetSketch parameters: registers are floor(1 - log_BASE(least point of rate RATE)).
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Pairs estimated this far below the threshold (7 standard errors) aren't confirmed.
SLACK = 0.2
#: Pivots that a document is held against in each turn.
PIVOTS = 3
#: Counters by which shingles are ordered from rare to frequent.
SLOTS = 1 << 18

_rng = np.random.default_rng(977)
_XOR = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = 0xD6E8FEB86659FD93


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; a text of fewer
    words is one shingle, a text of none has none."""
    words = Words(texts)
    h = words.hashes(lower=True)
    weight = [np.uint64(x) for x in powers(_SHINGLE, k, "shingle")]
    n = len(h) - k + 1
    rolled = h[:n] * weight[0] if n > 0 else np.zeros(0, np.uint64)
    for j in range(1, k):
        if n > 0:
            rolled += h[j : j + n] * weight[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for j in range(b - a):
                short = short * np.uint64(_SHINGLE) + h[a + j]
            out.append(mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16) of sets that aren't empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    least = np.empty((BANDS * ROWS, len(sets)), dtype=np.uint64)
    held = np.empty_like(flat)
    for i in range(BANDS * ROWS):
        np.bitwise_xor(flat, _XOR[i], out=held)
        np.multiply(held, _MUL[i], out=held)
        least[i] = np.minimum.reduceat(held, at)
    point = -np.log1p(-(least.T.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(point) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def band_keys(regs: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(_SHINGLE) + regs[:, j::ROWS].astype(np.uint64))
    return key


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, signature s1/s2, registers and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, texts in chunks(batches):
                sets = shingle_sets(texts, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                regs: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if full:
                    some = [sets[i] for i in full]
                    at, flat = np.cumsum([0, *map(len, some)])[:-1], np.concatenate(some)
                    s1[full] = np.add.reduceat(mix(flat + np.uint64(11)), at)
                    s2[full] = np.add.reduceat(mix(flat ^ np.uint64(_SHINGLE)), at)
                    got = registers(some)
                    for i, r, b in zip(full, got, band_keys(got).view(np.int64), strict=True):
                        regs[i], keys[i] = r.tobytes(), b
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "s1", "s2", "regs", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, regs binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, members) for the documents in ``wanted`` (doc_id), from their texts."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, texts in chunks(batches):
                sets = [s.view(np.int64) for s in shingle_sets(texts, k)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "members"])

    return chosen.mapInArrow(run, "doc_id long, members array<long>")


def likelihood_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimates for rows of registers, given the
    sets' sizes: counts of greater, less and equal registers over a grid of values."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, 201)[None, :], np.minimum(u / v, v / u))

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    fit = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)
    return j[np.arange(len(j)), fit.argmax(1)]


def likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) whose estimate isn't far below the threshold."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        keep = np.zeros(len(a), dtype=bool)
        for i in range(0, len(a), 1000):
            s = slice(i, i + 1000)
            x, y = (np.frombuffer(b"".join(c[s]), "<u2").reshape(-1, BANDS * ROWS) for c in (a, b))
            keep[s] = likelihood_jaccard(x, y, n_a[s].to_numpy(float), n_b[s].to_numpy(float)) >= threshold - SLACK
        return pd.Series(keep)

    ids = checkpoint(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
    sketches = sketches.join(small(ids), "doc_id", "left_semi")
    left = sketches.select(F.col("doc_id").alias("u"), F.col("regs").alias("ru"), F.col("n_shingles").alias("nu"))
    right = sketches.select(F.col("doc_id").alias("v"), F.col("regs").alias("rv"), F.col("n_shingles").alias("nv"))
    met = pairs.join(left, "u").join(right, "v").where((F.least("nu", "nv") >= threshold * F.greatest("nu", "nv") - 1e-9) & near("ru", "rv", "nu", "nv"))
    return met.select("u", "v")


def confirm(pairs: DataFrame, docs: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Pairs (u, v) whose full sets reach the threshold."""
    pairs = checkpoint(pairs)
    ids = checkpoint(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
    sets = checkpoint(full_sets(docs, ids, k))
    met = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("members").alias("mu")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("members").alias("mv")), "v")
    both = F.size(F.array_intersect("mu", "mv"))
    return met.where(threshold.denominator * both >= threshold.numerator * (F.size("mu") + F.size("mv") - both)).select("u", "v")


def prefix_pairs(sets: DataFrame, labels: DataFrame, threshold: Fraction) -> DataFrame:
    """Pairs of different components that share a shingle of their prefixes: their
    rarest ``n - ceil(threshold * n) + 1``, in one order over all documents. Every pair
    within the threshold does."""
    spark = sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy().view(np.uint64) % np.uint64(SLOTS), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "n"])

    counts = np.zeros(SLOTS, dtype=np.int64)
    for slot, n in sets.select("members").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[slot] = n
    told = spark.sparkContext.broadcast(counts)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members in batch.column(1):
                s = members.values.to_numpy().view(np.uint64)
                keep = len(s) - -(-threshold.numerator * len(s) // threshold.denominator) + 1
                out.append(s[np.lexsort((s, told.value[s % np.uint64(SLOTS)]))[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m) for m in batch.column(1)], pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "n", "prefix"])

    rare = sets.select("doc_id", "members").mapInArrow(prefix, "doc_id long, n long, prefix array<long>").join(labels, "doc_id")
    rare = rare.select("doc_id", "n", "label", F.posexplode("prefix").alias("place", "shingle"))
    # Only shingles of several labels matter, and of these only pairs across labels are made:
    # first of labels, then of the documents of each; those of one label never meet.
    mixed = rare.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("shingle")
    rare = checkpoint(rare.join(mixed, "shingle", "left_semi"))
    # Of a pair's first common shingle on, both must hold the overlap that it needs: what
    # the best of a label could hold tells whether any of it can.
    up, down = threshold.numerator, threshold.denominator

    def fits(room_u: Column, room_v: Column, n_u: Column, n_v: Column) -> Column:
        return (up + down) * F.least(room_u, room_v) >= up * (n_u + n_v)

    named = rare.groupBy("shingle", "label").agg(F.max(F.col("n") - F.col("place")).alias("room"), F.min("n").alias("n"))
    left, right = (named.select("shingle", F.col("label").alias("l" + x), F.col("room").alias("r" + x), F.col("n").alias("m" + x)) for x in "uv")
    across = left.join(right, (left.shingle == right.shingle) & F.expr("lu < lv") & fits(F.col("ru"), F.col("rv"), F.col("mu"), F.col("mv"))).select(left.shingle, "lu", "lv", "rv", "mv")
    a, b = (rare.select("shingle", F.col("label").alias("l" + x), F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("place").alias("p" + x)) for x in "uv")
    room = F.col("nu") - F.col("pu")
    met = across.join(a, ["shingle", "lu"]).where(fits(room, F.col("rv"), F.col("nu"), F.col("mv"))).join(b, ["shingle", "lv"]).where(fits(room, F.col("nv") - F.col("pv"), F.col("nu"), F.col("nv")))
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link when their sets' Jaccard similarity is at least ``threshold``;
    component_id is the smallest doc_id reachable. Null, empty and all-space texts
    have no shingles and stand alone. Equal texts link. Rows that repeat a doc_id are
    one node with the links of each. A null doc_id has a null component and is kept.
    Extra columns are ignored; an empty table gives no rows.
    """
    table = checkpoint(sketch(docs, k).withColumn("row", F.monotonically_increasing_id()))
    filled = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = checkpoint(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row")))
    same = checkpoint(filled.select("doc_id", "s1", "s2").join(reps, ["s1", "s2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))

    # One row of each set, under the smallest doc_id that has it.
    own = table.select("row", "n_shingles", "regs", "bands").join(small(reps.select("row", F.col("rep").alias("doc_id"))), "row")
    banded = own.select("doc_id", F.explode("bands").alias("key"))
    met = checkpoint(banded.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "low"))
    grouped = checkpoint(banded.join(small(met), "key"))  # documents that share a band with another set

    known = same  # links, or the stars that stand for them
    for turn in range(2):
        if turn:
            degree = found.select(F.explode(F.array("u", "v")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("d"))
            about = checkpoint(degree.join(labels, "doc_id", "full"))
            placed = grouped.join(small(about), "doc_id", "left").select("doc_id", "key", F.coalesce("label", "doc_id").alias("label"), F.coalesce("d", F.lit(0)).alias("d"))
            open_keys = placed.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max_by(F.struct("doc_id", "label"), F.struct("d", -F.col("doc_id"))).alias("top")).where("a < b")
            pairs = placed.join(open_keys, "key").where("label <> top.label").select("doc_id", F.col("top.doc_id").alias("pivot"))
        else:
            pairs = grouped.where("doc_id <> low").select("doc_id", F.col("low").alias("pivot"))
        most = Window.partitionBy("doc_id").orderBy(F.desc("n"), "pivot")
        pairs = pairs.groupBy("doc_id", "pivot").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(most)).where(F.col("r") <= PIVOTS)
        pairs = pairs.select(F.greatest("doc_id", "pivot").alias("u"), F.least("doc_id", "pivot").alias("v")).distinct()
        if turn:
            pairs = pairs.join(held, ["u", "v"], "left_anti")
        held = pairs = checkpoint(pairs)
        found = checkpoint(confirm(likely(pairs, own.select("doc_id", "regs", "n_shingles"), float(threshold)), docs, k, threshold))
        labels = checkpoint(components(found.union(known)).withColumnRenamed("node", "doc_id"))
        known = labels.select(F.col("doc_id").alias("u"), F.col("label").alias("v"))

    placed = grouped.join(small(labels), "doc_id", "left").select("doc_id", "key", F.coalesce("label", "doc_id").alias("label"))
    left = placed.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    rest = checkpoint(placed.join(left, "key", "left_semi").select("doc_id", "label").distinct())
    sets = checkpoint(full_sets(docs, rest.select("doc_id").distinct(), k))
    found = confirm(prefix_pairs(sets, rest, threshold), docs, k, threshold)
    labels = components(found.union(known)).withColumnRenamed("node", "doc_id")
    out = table.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"), F.coalesce(F.coalesce("label", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
