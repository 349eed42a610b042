"""Side files that belong to chunks of input rows, found again by file and row.

A chunk is `CHUNK` consecutive rows of one file.  What an operator learns about the rows
of a chunk is one file in the shared folder, read when those rows come up in a later
scan, so that texts stay where they are.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from graphloom.llm import textcore as tc
from graphloom.llm.shared import FILE, ROW, filesystem, read_bytes, write_bytes

CHUNK = 4096


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches that lie in one chunk."""
    for b in batches:
        if not b.num_rows:
            continue
        files = tc.column(b, FILE).dictionary_encode().indices.to_numpy()
        key = tc.int64(b, ROW) // CHUNK
        cut = np.flatnonzero((files[1:] != files[:-1]) | (key[1:] != key[:-1])) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            yield b.slice(i, j - i)


def chunk_of(b: pa.RecordBatch) -> tuple[str, int]:
    return tc.column(b, FILE)[0].as_py(), int(tc.column(b, ROW)[0].as_py()) // CHUNK


def packed(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    raw = f.getvalue()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))))


def _path(folder: str, file: str, chunk: int) -> str:
    return f"{folder}/{hashlib.md5(file.encode()).hexdigest()}-{chunk}"


def keep(folder: str, file: str, chunk: int, **arrays: np.ndarray) -> None:
    write_bytes(_path(folder, file, chunk), packed(**arrays))


class Kept:
    """Reads a chunk's side file when its rows come up; {} if it has none."""

    def __init__(self, folder: str):
        self.folder, self.key, self.data = folder, None, {}

    def of(self, b: pa.RecordBatch) -> dict[str, np.ndarray]:
        if (key := chunk_of(b)) != self.key:
            path = _path(self.folder, *key)
            fs, at = filesystem(path)
            self.key, self.data = key, unpacked(read_bytes(path)) if fs.get_file_info(at).type.name == "File" else {}
        return self.data


def matched(b: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries for these rows (numbered from the chunk's first): which are about rows of the batch, and about which of them."""
    here = tc.int64(b, ROW) % CHUNK
    at = np.full(CHUNK, -1, np.int64)
    at[here] = np.arange(len(here))
    use = np.flatnonzero(at[rows] >= 0)
    return use, at[rows[use]]
