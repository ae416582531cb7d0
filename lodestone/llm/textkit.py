"""Byte-level text kernels shared by the operators: words, their hashes, shingles.

A word is a run of ``[0-9a-z]`` or bytes of non-ASCII characters after A-Z is lower-cased, i.e.
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; in UTF-8 every byte of a non-ASCII character is 0x80 or
more, so the rule holds byte by byte.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
CHUNK_BYTES = 1 << 21

_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True
_WORD[128:] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        n = max(n, PIECE + 65536)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in (("p", _BASE), ("i", inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW["p"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of several texts: ``buf`` lower-cased bytes, ``start``/``end`` byte spans, ``first`` the
    index of each text's first word (one more entry closes the last), ``hash`` 64-bit word hashes.

    Texts are held whole: three bytes for each of theirs and 24 for a word, so about ten for one of
    prose; hashing works on pieces of ``PIECE`` bytes."""

    __slots__ = ("buf", "end", "first", "hash", "start")

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.buf = _LOWER[raw]
        mask = np.empty(len(raw) + 1, bool)
        mask[0] = False
        np.take(_WORD, raw, out=mask[1:])
        edge = np.flatnonzero(mask[1:] != mask[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.start, at)
        self.hash = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):  # pieces end at word ends, so a long text needs no long power table
            base = int(self.start[lo])
            hi = max(int(np.searchsorted(self.end, base + PIECE, "right")), lo + 1)
            span = self.buf[base : int(self.end[hi - 1])]
            p, inv = _powers(len(span) + 1)
            acc = np.zeros(len(span) + 1, np.uint64)
            np.cumsum(_BYTE[span] * p[: len(span)], out=acc[1:])
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            self.hash[lo:hi] = (acc[e] - acc[s]) * inv[s]
            lo = hi
        self.hash = mix(self.hash ^ (self.end - self.start).astype(np.uint64))

    def spaced(self) -> bytes:
        """All words with one space between."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True))

    def spaced_at(self, i: np.ndarray) -> np.ndarray:
        """Where words begin in :meth:`spaced`."""
        return np.concatenate(([0], np.cumsum(self.end - self.start + 1)))[i]

    def joined(self, a: int, b: int) -> bytes:
        """Words a..b-1 with single spaces between."""
        return b" ".join(self.buf[self.start[i] : self.end[i]].tobytes() for i in range(a, b))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of every ``width`` neighbours of ``h``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : k + n]
    return mix(out)


def shingle_sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a text of fewer words, but not
    none, is one shingle; a text without words has none."""
    w = Words(texts)
    all_ = rolled(w.hash, width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(all_[a : b - width + 1]))
        elif b > a:
            out.append(rolled(w.hash[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()).to_pylist()


def slices(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a run of texts so that each part holds at most ``limit`` bytes, or one text."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def replace_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    cols = {k: batch.column(batch.schema.get_field_index(k)) for k in keep} | new
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


Batches = Iterator[pa.RecordBatch]


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library frees in its own way
        pass


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` as a task that leaves no memory with its worker, which lives on for later tasks."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            trim()

    return task
