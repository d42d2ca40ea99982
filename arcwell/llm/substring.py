"""Exact substring deduplication of word windows by recompression.

Words are named by hashes of their bytes, and in each round a pair of neighbouring
symbols (l, r) is replaced by one symbol, named by a hash of both, wherever a hash bit
of that round puts l left and r right. Names depend on the symbols alone, so all
executors agree on them without a shuffle, and equal substrings are parsed alike
except for at most 1, 2 and 4 words a side in the three rounds.

Two neighbouring symbols of the last round (2 to 16 words) are an anchor. A window's
anchor is the longest (ties by name) of those that start in its middle stretch of
``window - 30`` words: equal windows have equal anchors. Anchor names that occur in two
different texts are set in a bitmap of bounded size; only windows whose anchor is in it
are named themselves and compared. (A fuller bitmap lets more windows through; it never
loses one.) A window's name is 64 bits, and each repeat is verified by 64 other bits of
it: where documents that share a name differ in these, they are grouped by all 128.

Copies of a whole text, by 128 bits of two hashes of it, are settled first: all but the
one of the smallest id lose everything, and take no further part.

Runs of one word stay runs of equal symbols (naming one by its length would make a
window's parse depend on words outside it); their anchors are equal and collapse to
one name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, checkpoint, join_one, small
from .textscan import Words, chunks, mix, powers

ROUNDS = 3
#: Longest anchor and words lost at a window's ends, by ROUNDS; what is left of a
#: window for anchors to start in.
SPAN, LOST = 2 * 2**ROUNDS, 2**ROUNDS - 1
NONE = np.uint64(2**64 - 1)
#: Bits of the anchor bitmap: 8 for each shared name, within these bounds (128 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
_STEP, _OTHER_STEP = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def parse(words: Words, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the last round: name, first word, number of words, text."""
    at = np.arange(len(names))
    size = np.ones(len(names), dtype=np.int64)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    for turn in range(1, ROUNDS + 1):
        side = (mix(names + np.uint64(turn * 0x51ED270B)) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(names), dtype=bool)
        joined[:-1] = ~side[:-1] & side[1:] & (text[:-1] == text[1:])
        gone = np.zeros(len(names), dtype=bool)
        gone[1:] = joined[:-1]
        k = np.flatnonzero(joined)
        names = names.copy()
        names[k] = mix(names[k] * np.uint64(_STEP) + names[k + 1] + np.uint64(turn))
        size[k] += size[k + 1]
        names, at, size, text = names[~gone], at[~gone], size[~gone], text[~gone]
    return names, at, size, text


def anchor_keys(words: Words, names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Anchors: name, first word, key (least is best, lowest bit unset); the width of a
    window's middle stretch."""
    symbol, at, size, text = parse(words, names)
    both = np.flatnonzero(text[:-1] == text[1:]) if len(text) > 1 else np.zeros(0, np.int64)
    name = mix(symbol[both] * np.uint64(_STEP) + symbol[both + 1] + np.uint64(0x1234567))
    span = (size[both] + size[both + 1]).astype(np.uint64)
    key = ((np.uint64(63) - span) << np.uint64(58)) | (name >> np.uint64(7)) << np.uint64(1)
    return name, at[both], key, window - 2 * LOST - SPAN


def middles(n: int, at: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """The least key that starts in the middle stretch of the window at each word."""
    held = np.full(n + LOST + width, NONE)
    held[at] = key
    return sliding(held, width, np.minimum)[LOST : LOST + n]


def windows_inside(words: Words, window: int) -> np.ndarray:
    """Whether a window of its own text begins at each word."""
    n = len(words.starts)
    last = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(n) + window <= last


def sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """least over x[i : i + width], by doubling; shorter at the end."""
    done, out = 1, x.copy()
    while done < width:
        step = min(done, width - done)
        out[:-step] = least(out[:-step], out[step:])
        done += step
    return out


def window_names(names: np.ndarray, window: int, step: int = _STEP) -> np.ndarray:
    """A 64-bit name of each ``window`` words from each word on."""
    n = len(names)
    if n < window:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * powers(step, n, f"window {step}"), dtype=np.uint64)))
    return mix((total[window:] - total[:-window]) * powers(pow(step, -1, 2**64), n, f"inverse {step}")[: n - window + 1])


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, _id, text, _key): all columns of a row are one struct, so that no name of
    theirs meets one of ours."""
    text = F.col("text")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key"))


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def summaries(docs: DataFrame) -> DataFrame:
    """_id, _key, n_words and the digest of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            own = [(t or b"").split() for t in texts]  # bytes split at the six ASCII spaces, and only those
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(w) for w in own], pa.int64()), pa.array([_digest(w) for w in own], pa.string())], ["_id", "_key", "n_words", "digest"])

    return docs.select("_id", "text", "_key").mapInArrow(run, "_id long, _key long, n_words long, digest string")


def copies_of(docs: DataFrame) -> DataFrame:
    """(_id, _key) of texts that a smaller id has too."""
    ids = docs.where("_id IS NOT NULL AND text IS NOT NULL").select("_id", F.struct("_key", F.xxhash64(F.lit("other"), "text").alias("other")).alias("whole"))
    first = ids.groupBy("whole").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("n")).where("low < high").select("whole", "low", "n")
    return join_one(ids, first, "whole", "n").where("_id > low").select("_id", "whole._key").distinct()


def anchor_names(docs: DataFrame, window: int) -> DataFrame:
    """(_id, names): the distinct names of each document's window anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, texts in chunks(batches):
                words = Words(texts)
                name, at, key, width = anchor_keys(words, words.hashes(), window)
                best = middles(len(words.starts), at, key, width)[windows_inside(words, window)]
                kept = np.isin(key, np.unique(best))
                text = np.searchsorted(words.first, at[kept], side="right") - 1
                name = name[kept]
                cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
                out = [np.unique(name[a:b]).view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["_id", "names"])

    return docs.select("_id", "text").mapInArrow(run, "_id long, names array<long>")


def bitmap(names: DataFrame) -> np.ndarray:
    """The names of two documents or more as a bitmap of bounded size."""
    shared = names.select("_id", F.explode("names").alias("name")).groupBy("name").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).where("low < high").select("name")
    shared = checkpoint(shared)
    bits = LEAST_BITS
    wanted = 8 * shared.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    slot = shared.select(F.pmod("name", F.lit(bits)).alias("slot"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in slot.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("b")).toLocalIterator():
        # Buckets count from 1 with slot 1 at position 0; slot 0 is position 0 of bucket 0.
        own = np.unpackbits(np.frombuffer(r["b"], np.uint8), bitorder="little")
        at = np.flatnonzero(own) + (r["k"] - 1) * 32768 + 1 if r["k"] else np.zeros(1, np.int64)
        at = at % bits
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def covered_starts(docs: DataFrame, window: int) -> DataFrame:
    """(_id, tag, starts): word offsets of the windows that also start in a document of
    a smaller id. tag tells apart the texts of a repeated id."""
    told = docs.sparkSession.sparkContext.broadcast(bitmap(anchor_names(docs, window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = told.value
        with np.errstate(over="ignore"):
            for batch, texts in chunks(batches):
                words = Words(texts)
                names = words.hashes()
                name, at, key, width = anchor_keys(words, names, window)
                slot = (name & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
                key |= ((bits[slot >> 3] >> (slot & 7)) & 1).astype(np.uint64)
                best = middles(len(names), at, key, width)
                hit = np.flatnonzero(windows_inside(words, window) & (best & np.uint64(1) == 1))
                total, other = ((window_names(x, window, step)[hit] if len(hit) else np.zeros(0, np.uint64)).view(np.int64) for x, step in ((names, _STEP), (mix(names), _OTHER_STEP)))
                cut = np.searchsorted(hit, words.first)
                begins, sizes, found, checks = [], [], [], []
                for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    own = hit[a:b] - words.first[i]
                    edge = np.flatnonzero(np.diff(own) != 1) + 1
                    begin = np.concatenate(([0], edge)) if b > a else edge
                    begins.append(own[begin].astype(np.int32))
                    sizes.append(np.diff(np.append(begin, b - a)).astype(np.int32))
                    found.append(total[a:b])
                    checks.append(other[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(begins, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.int64())) for x in (found, checks))], ["_id", "_key", "begins", "sizes", "windows", "checks"])

    named = docs.select("_id", "text", "_key").mapInArrow(run, "_id long, _key long, begins array<int>, sizes array<int>, windows array<long>, checks array<long>").where(F.size("windows") > 0)
    return removals(checkpoint(named))


def removals(named: DataFrame) -> DataFrame:
    """(_id, tag, starts) of the windows whose 128 bits a smaller id has too, from the runs
    of windows of each text (begins, sizes) and their two names (windows, checks)."""
    pairs = F.arrays_zip(F.col("windows").alias("name"), F.col("checks").alias("check"))
    held = named.select("_id", F.explode(pairs).alias("w")).select("_id", "w.name", "w.check")
    first = held.groupBy("name").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("n"), F.min("check").alias("one"), F.max("check").alias("two"))
    first = checkpoint(first.where("low < high").select("name", "low", "n", (F.col("one") == F.col("two")).alias("sure")))
    starts = F.flatten(F.zip_with("begins", "sizes", lambda b, n: F.sequence(b, b + n - 1)))
    place = F.shiftleft(tag(F.col("_key")), 32)

    def each(source: DataFrame, *more: str) -> DataFrame:
        zipped = F.arrays_zip(F.col("windows").alias("name"), F.col("checks").alias("check"), starts.alias("start"))
        rows = source.select("_id", place.alias("t"), F.explode(zipped).alias("w"))
        return rows.select("_id", F.col("w.name").alias("name"), *[F.col(f"w.{x}").alias(x) for x in more], F.col("t").bitwiseOR(F.col("w.start").cast("long")).alias("place"))

    lost = join_one(each(named), first.where("sure").select("name", "low", "n"), "name", "n").where("_id > low").select("_id", "place")
    unsure = first.where("NOT sure").select("name")
    if not unsure.isEmpty():  # names that different windows share: grouped by all 128 bits
        mixed = each(named, "check").join(small(checkpoint(unsure)), "name", "left_semi").withColumn("both", F.struct("name", "check"))
        true = mixed.groupBy("both").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("n")).where("low < high").select("both", "low", "n")
        lost = lost.unionByName(join_one(mixed.select("_id", "both", "place"), true, "both", "n").where("_id > low").select("_id", "place"))
    lost = lost.select("_id", F.shiftright("place", 32).alias("tag"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"))
    return lost.groupBy("_id", "tag").agg(F.collect_set("start").alias("starts"))


def tag(key: Column) -> Column:
    return key.bitwiseAND(F.lit(0x7FFFFFFF))


def _removed(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def _chosen(docs: DataFrame, wanted: DataFrame, how: str, by: list[str]) -> DataFrame:
    """Rows of ``docs`` that are in ``wanted``, or aren't."""
    few = wanted.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(wanted) if few else wanted, by, how)


def _rewritten(docs: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """_id, _key, n_removed, digest and the kept text of documents that lose some words."""
    tagged = docs.select("_id", "_key", "text").withColumn("tag", tag(F.col("_key")))
    chosen = _chosen(tagged, starts.select("_id", "tag"), "left_semi", ["_id", "tag"]).dropDuplicates(["_id", "_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            out: list[list] = [[], [], []]
            for t, s in zip(texts, batch.column(3), strict=True):
                own = t.split()
                gone = _removed(len(own), s.values.to_numpy(), window)
                kept = b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g)
                for column, x in zip(out, (int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["_id", "_key", "n_removed", "digest", "kept"])

    return chosen.join(starts, ["_id", "tag"]).select("_id", "text", "_key", "starts").mapInArrow(run, "_id long, _key long, n_removed long, digest string, kept string")


def _plan(keyed: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Copies (_id, _key), and the lost windows of all other texts."""
    copies = checkpoint(copies_of(keyed.select("_id", "_key", "text")))
    others = _chosen(keyed.select("_id", "_key", "text").where("_id IS NOT NULL"), copies, "left_anti", ["_id", "_key"])
    return copies, checkpoint(covered_starts(others, window))


def digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Each word goes that some window of ``window`` words covers whose words also start
    in a document with a smaller doc_id; windows are judged on the input. Null, empty
    and short texts lose nothing. Rows that repeat a doc_id don't remove from each
    other; those with a null doc_id neither lose nor cause anything. Extra columns are
    ignored; an empty table gives no rows.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    copies, starts = _plan(keyed, window)
    cut = _rewritten(keyed, starts, window).select("_id", "_key", "n_removed", F.col("digest").alias("cut"))
    out = summaries(keyed).join(cut, ["_id", "_key"], "left").join(copies.withColumn("copy", F.lit(True)), ["_id", "_key"], "left")
    gone = F.col("copy").isNotNull() & (F.col("n_words") >= window)
    return out.select(
        F.col("_id").alias("doc_id"), "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut", "digest")).alias("kept_sha256"),
    )


def strip(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with the text of documents that lose words replaced by the kept words,
    joined by one space (n_chars, if there, follows); all other rows and columns are
    unchanged, whatever their names. Nulls, repeats, ties and empty tables as in
    ``digest``; a copy that loses all its words stays, with an empty text."""
    keyed = _keyed(docs)
    copies, starts = _plan(keyed, window)
    cut = _rewritten(keyed, starts, window).select("_id", "_key", "kept")
    names = checkpoint(cut.select("_id", "_key"))
    enough = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) >= window
    copied = _chosen(keyed, copies, "left_semi", ["_id", "_key"]).select("doc", F.when(enough, "").otherwise(F.col("text")).alias("kept"))
    changed = _chosen(keyed, names, "left_semi", ["_id", "_key"]).join(cut, ["_id", "_key"]).select("doc", "kept").unionByName(copied)
    doc = F.col("doc").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    rest = _chosen(_chosen(keyed, names, "left_anti", ["_id", "_key"]), copies, "left_anti", ["_id", "_key"])
    return rest.select("doc").unionByName(changed.select(doc.alias("doc"))).select("doc.*")
