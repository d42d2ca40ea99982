"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are single words, pairs of neighbours and pairs with one word between them
(skip-grams), of the lower-cased whole text without
punctuation at words' ends, hashed to 2**BITS slots and binary. Only
weights that the L1 term leaves are broadcast: a table of at most 2**BITS floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import Words, chunks, mix

BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 6.0, 0.01, 8
#: Labelled rows that the model is fitted on at most, those of the least hashes, whole
#: texts of any length; and their bytes in all. A byte of text has at most 1.5 features of
#: 4 bytes, so the driver gathers at most 6 * TRAIN_BYTES.
TRAIN_ROWS, TRAIN_BYTES = 10_000, 32 << 20


def grams(words: Words) -> Iterator[tuple[np.ndarray, int]]:
    """Slots of the features that begin at each word, and how many words they span."""
    h = words.hashes(bare=True)
    cut = np.uint64(64 - BITS)
    yield mix(h + np.uint64(1)) >> cut, 1
    yield mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> cut, 2
    yield mix(h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]) >> cut, 3


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes in the rows' order."""
    held = np.zeros(1 << BITS, dtype=np.int32)
    for at, _ in rows:
        held[at] += 1
    rows = [(at[held[at] > 1], y) for at, y in rows]  # a slot of one row tells nothing of others
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    bias = 0.0
    for _ in range(EPOCHS):
        for at, y in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            bias = -bz / ((BETA + bn**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            step = (np.sqrt(ni + g * g) - root) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / ALPHA * bias
            bn += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on labelled rows outside the held-out fold (crc32(doc_id) mod 5 = 0): at most
    TRAIN_ROWS different ones, in order of a hash, as long as their texts hold no more
    than TRAIN_BYTES together (one that doesn't fit any more is passed over)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = texts.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = own.select("h", F.octet_length("text").alias("size")).distinct().orderBy("h").limit(TRAIN_ROWS).collect()
    left, wanted = TRAIN_BYTES, []
    for r in sizes:
        if r["size"] <= left:
            left -= r["size"]
            wanted.append((r["h"],))
    picked = F.broadcast(docs.sparkSession.createDataFrame(wanted, "h long"))
    own = own.join(picked, "h").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, texts in chunks(batches):
                out = []
                for t in texts:
                    words = Words([t])
                    out.append(np.unique(np.concatenate([s for s, _ in grams(words)])).astype("<u4").tobytes() if len(words.starts) else b"")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "toxic", "slots"])

    rows = own.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "doc_id long, toxic int, slots binary").collect()
    rows.sort(key=lambda r: ((r["doc_id"] * 2654435761) % 2**32, r["doc_id"], r["slots"]))
    return fit([(np.frombuffer(r["slots"], "<u4"), int(r["toxic"] > 0)) for r in rows])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null, empty or wordless text is scored by the bias alone. Repeated rows score
    alike; a null doc_id is never held out. Without labels every score is 0.5 by its
    zero bias. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    weights, bias = train(docs, labels)
    at = np.flatnonzero(weights)
    told = spark.sparkContext.broadcast((at.astype(np.int32), weights[at], bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values, bias = told.value
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[slots] = values
        with np.errstate(over="ignore"):
            for batch, texts in chunks(batches):
                words = Words(texts)
                hits = []
                for slot, span in grams(words):
                    i = np.flatnonzero(dense[slot])
                    doc = np.searchsorted(words.first, i, side="right") - 1
                    inside = i + span <= words.first[doc + 1]
                    hits.append(doc[inside].astype(np.int64) << BITS | slot[i[inside]].astype(np.int64))
                hit = np.unique(np.concatenate(hits))
                total = np.bincount(hit >> BITS, weights=dense[hit & ((1 << BITS) - 1)], minlength=len(texts)) + bias
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
