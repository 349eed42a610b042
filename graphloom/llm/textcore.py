"""Byte-level text kernels shared by the corpus operators.

Everything works on one contiguous UTF-8 buffer per slice of documents, so that
word splitting, hashing and n-grams are a handful of numpy passes and no Python
object is made per word.  A word is a run of bytes outside ``\\x20\\x09-\\x0D``;
all those separators are ASCII, so byte positions and code points agree.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Python workers live on between tasks.  Large arrays are mapped apart, so that they go back to the system once freed.
with contextlib.suppress(OSError, AttributeError):
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
    _libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
pa.set_memory_pool(pa.system_memory_pool())

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SLICE_BYTES = 1 << 20

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    global _pow, _inv
    while len(_pow) < n:
        k = len(_pow)
        _pow = np.concatenate([_pow, _pow * U64(pow(BASE, k, 1 << 64))])
        _inv = np.concatenate([_inv, _inv * U64(pow(BASE_INV, k, 1 << 64))])
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix constants)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    c = batch.column(batch.schema.get_field_index(name))
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `limit` bytes; a longer document is a slice alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = text_buffer(column(batch, text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    with contextlib.suppress(NameError, AttributeError):  # what a task has freed goes back before the worker waits for the next one
        _libc.malloc_trim(0)


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, and for each document the index of its first word."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    sp = SPACE[buf]
    st, en = ~sp, ~sp
    st[1:] &= sp[:-1]
    en[:-1] &= sp[1:]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    st[first] = ~sp[first]
    en[last] = ~sp[last]
    starts = np.flatnonzero(st)
    return starts, np.flatnonzero(en) + 1, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are ascending and disjoint.  Another seed is another hash."""
    out = np.empty(len(starts), U64)
    value = np.arange(1, 257, dtype=U64)
    if seed:
        value = mix(value * U64(0x9E3779B97F4A7C15) + U64(seed))
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + chunk, "right")))
        hi = int(ends[j - 1])
        p, q = _powers(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, U64)
        np.cumsum(value[buf[lo:hi]] * p[: hi - lo], out=acc[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (acc[e] - acc[s]) * q[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def ngrams(h: np.ndarray, k: int, mult: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of the k items from each position; the last k - 1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= U64(mult)
        acc += h[i : i + n]
    return mix(acc)


def ngram_rows(wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the k-word windows inside single documents, and how many each document has."""
    per = np.maximum(wo[1:] - wo[:-1] - (k - 1), 0)
    return ragged(wo[:-1], per), per


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] of them), then begin[1], ..."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(begin - (ends - count), count)


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of x in each document's range."""
    c = np.zeros(len(x) + 1, x.dtype if x.dtype.kind == "f" else np.int64)
    np.cumsum(x, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def int64(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).cast(pa.int64()).to_numpy(zero_copy_only=False)
