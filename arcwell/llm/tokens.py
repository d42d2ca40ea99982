"""Token counts and ids by a map-side two-tier lookup (no pre-token shuffle).

Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens (their
ids, where ids are asked for), encoded once on the driver. Tier two is a bounded cache
in each worker, filled by encoding the misses of a batch in one call. Both are caches
only: what they hold never changes a result.

A pre-token here runs from one space to the next: a text is cut before each space that
a non-space follows. The vocabulary's own pattern never matches across such a cut, so
the pieces can be encoded apart. Texts with any other use of spaces are encoded whole.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textscan import chunks

#: Pre-tokens kept in a worker's cache, and the longest one kept (characters).
CACHE_PIECES, CACHE_LENGTH = 400_000, 48
#: Texts and bytes from which the broadcast table of frequent pre-tokens is taken, and its size.
WARM_TEXTS, WARM_BYTES, FREQUENT = 2_000, 8 << 20, 40_000

_ODD = re.compile(r" (?:\s|\Z)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, or their number, as the vocabulary's own library gives them, without
    added tokens. ``frequent`` answers before anything is encoded."""

    def __init__(self, spec: str, pattern: str, frequent: dict | None = None, lengths: bool = False):
        told = json.loads(spec)
        alphabet = byte_alphabet()
        special = {x["content"]: x["id"] for x in told["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): rank for token, rank in told["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {text: 1 if lengths else array("I", [i]).tobytes() for text, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.lengths, self.frequent, self.cached = lengths, frequent or {}, {}
        self.total = sum if lengths else b"".join
        self.missed = 0

    def whole(self, text: str) -> bytes | int:
        ids = self.bpe.encode_ordinary(text)
        return len(ids) if self.lengths else array("I", ids).tobytes()

    def learn(self, pieces: list[str]) -> dict:
        """Pre-tokens (each with a leading space understood) encoded in one call: only the
        first token of one can begin with a space."""
        if not pieces:
            return {}
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(pieces)), dtype="<u4")
        at = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
        self.missed += len(pieces)
        if self.lengths:
            return dict(zip(pieces, np.diff(at).tolist(), strict=True))
        raw, at = ids.tobytes(), (at * 4).tolist()
        return dict(zip(pieces, (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)), strict=True))

    def plain(self, texts: list[str]) -> list:
        """For texts without special strings."""
        cut = [None if _ODD.search(t) else t.split(" ") for t in texts]
        seen: set[str] = set()
        for pieces in cut:
            if pieces:
                seen.update(pieces[1:])
        misses = [p for p in seen if p not in self.frequent]
        new = self.learn([p for p in misses if p not in self.cached])
        if len(self.cached) + len(new) > CACHE_PIECES:
            self.cached = {p: self.cached[p] for p in misses if p in self.cached}
        self.cached.update(new)
        known = {p: self.frequent[p] if p in self.frequent else self.cached[p] for p in seen}
        get = known.__getitem__
        out = [self.whole(t) if p is None else self.total((self.whole(p[0]), *map(get, p[1:]))) for t, p in zip(texts, cut, strict=True)]
        for p in new:
            if len(p) > CACHE_LENGTH:
                del self.cached[p]
        return out

    def encode(self, texts: list[str]) -> list:
        """Little-endian unsigned 32-bit ids of each text, or their number."""
        if not self.cut:
            return self.plain(texts)
        parts = [self.cut.split(t) for t in texts]
        flat = iter(self.plain([x for p in parts for x in p[::2]]))
        return [self.total([next(flat) if k % 2 == 0 else self.special[x] for k, x in enumerate(p)]) for p in parts]


_encoders: dict[tuple, Encoder] = {}


def encoder(told: Broadcast) -> Encoder:
    """The worker's encoder: one per broadcast."""
    value = told.value
    if value["key"] not in _encoders:
        _encoders.clear()
        _encoders[value["key"]] = Encoder(value["spec"], value["pattern"], value["frequent"], value["lengths"])
    return _encoders[value["key"]]


def vocabulary(docs: DataFrame, path: str, pattern: str, lengths: bool = False) -> Broadcast:
    """Broadcasts the vocabulary file (a few MB) and the table of frequent pre-tokens, with
    their lengths or ids: at most FREQUENT, from at most WARM_TEXTS texts of the table's
    first rows. The sample warms the lookup; results don't depend on it."""
    spark: SparkSession = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    counts: Counter[str] = Counter()
    for (text,) in docs.where(F.length("text") < WARM_BYTES // WARM_TEXTS).select("text").limit(WARM_TEXTS).collect():
        if not _ODD.search(text):
            counts.update(p for p in text.split(" ")[1:] if len(p) <= CACHE_LENGTH)
    frequent = Encoder(spec, pattern, lengths=lengths).learn([p for p, n in counts.most_common(FREQUENT) if n > 1])
    return spark.sparkContext.broadcast({"key": (uuid.uuid4().hex, lengths), "spec": spec, "pattern": pattern, "lengths": lengths, "frequent": frequent})


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text
    count as one token each, as the library has it. Repeated rows are counted each;
    other columns are ignored; an empty table gives no rows.
    """
    told = vocabulary(docs, path, pattern, lengths=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(told)
        for batch, texts in chunks(batches):
            sizes = [len(t or b"") for t in texts]
            n = enc.encode([(t or b"").decode() for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
