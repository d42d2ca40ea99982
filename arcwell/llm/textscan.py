"""Vectorised word scanning and hashing over batches of UTF-8 texts.

A word is a maximal run of bytes outside ``{0x20, 0x09-0x0D}``. All of these are
ASCII, so scanning bytes of UTF-8 gives the same words as scanning characters.
Hashes depend on bytes alone, so every executor names equal words alike.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
#: Lower case, and ASCII punctuation without weight: ``word,`` is ``word``.
_BYTE_BARE = _BYTE_LOWER.copy()
_BYTE_BARE[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def powers(base: int, n: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1 << 16), dtype=np.uint64)
        filled = 1
        while filled < len(out):
            step = min(filled, len(out) - filled)
            out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 2**64))
            filled += step
        _powers[key] = have = out
    return have[:n]


def release() -> None:
    """Give freed memory back to the system, tables made for one very long text too:
    workers outlive their tasks, and an executor holds several."""
    for key in [k for k, v in _powers.items() if len(v) > 2 * CHUNK_BYTES]:
        del _powers[key]
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a list of byte strings (None counts as empty).

    ``first[i]:first[i + 1]`` are the words of text i; ``starts``/``ends`` are
    byte offsets into ``buf``.
    """

    def __init__(self, texts: list[bytes | None]):
        parts = [t or b"" for t in texts]
        self.raw = b"\n".join(parts) + b"\n"
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        word = ~_SEP[self.buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        self.text_at = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.text_at)

    def hashes(self, lower: bool = False, bare: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        table = _BYTE_BARE if bare else _BYTE_LOWER if lower else _BYTE
        n = len(self.buf)
        value = table[self.buf]
        value *= powers(_R, n, "r")
        value[_SEP[self.buf]] = 0
        return mix(np.add.reduceat(value, self.starts) * powers(_R_INV, n, "r-inverse")[self.starts])


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose ``text`` column holds about ``limit`` bytes."""
    try:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            begin, held = 0, 0
            for i, t in enumerate(texts):
                size = len(t or b"") + 1
                if held and held + size > limit:
                    yield batch.slice(begin, i - begin), texts[begin:i]
                    begin, held = i, 0
                held += size
            if begin < len(texts):
                yield batch.slice(begin), texts[begin:]
    finally:
        release()
