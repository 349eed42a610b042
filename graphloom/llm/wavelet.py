"""Token ids as a wavelet matrix: one compressed file per shard.

The ids of a shard are kept as bit planes, highest bit first; each plane orders
the ids stably by its bit for the next.  Counts of ones before every block of
512 bits give rank in constant time, so a token, the number of its occurrences
in a range and the place of its k-th occurrence are found from the planes alone.

Cases: a null text counts as empty and still has its end id; null ids come first;
repeated rows are kept, ordered by text; a text of any length is whole in one shard; an empty table writes no file and gives
no rows; further columns are not carried along.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm import textcore as tc
from graphloom.llm.shared import map_arrow, read_bytes, shared_dir, texts, write_bytes, written

MAGIC = b"WVM1"
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
BLOCK = 64  # bytes between stored counts


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.bits = planes, zeros, n, len(planes)
        self._ranks: list[np.ndarray | None] = [None] * self.bits

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low = cur[~bit]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[bit]]) if level else cur
        return cls(planes, zeros, len(ids))

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        p = self.planes[level]
        counts = self._ranks[level]
        if counts is None:
            pop = _POP[np.concatenate([p, np.zeros(-len(p) % BLOCK, np.uint8)])].reshape(-1, BLOCK).sum(1, dtype=np.int64)
            counts = self._ranks[level] = np.concatenate([[0], np.cumsum(pop)])
        at = np.asarray(at, np.int64)
        byte = at >> 3
        block = byte // BLOCK
        out = counts[block].copy()
        pad = np.concatenate([p, np.zeros(BLOCK + 1, np.uint8)])
        for k in range(BLOCK):
            b = block * BLOCK + k
            out += np.where(b < byte, _POP[pad[np.minimum(b, len(pad) - 1)]], 0)
        return out + _POP[pad[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.planes[level][at >> 3] >> (at & 7).astype(np.uint8) & 1

    def access(self, at) -> np.ndarray:
        """Ids at these positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            b, one = self._bit(k, at).astype(bool), self._rank1(k, at)
            out = out << 1 | b
            at = np.where(b, self.zeros[k] + one, at - one)
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            x, y = self._rank1(k, np.array([a, b])).tolist()
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (self.bits - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of a token in [a, b)."""
        lo, hi = self._range(token, a, self.n if b is None else b)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0) of a token; -1 if there is none."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            a, b = 0, self.n  # the place whose bit is the want-th of its kind
            while b - a > 1:
                m = (a + b) // 2
                r = int(self._rank1(level, np.array([m]))[0])
                a, b = (m, b) if (r if one else m - r) <= want else (a, m)
            at = a
        return at

    def locate(self, token: int) -> np.ndarray:
        return np.array([self.select(token, k) for k in range(self.count(token))], np.int64)

    def all(self) -> np.ndarray:
        """Every id in order: the stable orderings are undone from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            out[~bit] = cur[: self.zeros[k]]
            out[bit] = cur[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            cur = out
        return cur


def dump(wm: WaveletMatrix, docs: list, lengths: np.ndarray) -> bytes:
    """The file: header, document ids and lengths, then each plane, all compressed."""
    known = np.array([d is not None for d in docs])
    table = known.tobytes() + np.array([d or 0 for d in docs], "<i8").tobytes() + lengths.astype("<i8").tobytes()
    parts = [pa.compress(x, codec="zstd", asbytes=True) for x in (table, *(p.tobytes() for p in wm.planes))]
    head = struct.pack(f"<4sQQI{wm.bits}Q{len(parts)}Q", MAGIC, wm.n, len(docs), wm.bits, *wm.zeros, *map(len, parts))
    return head + b"".join(parts)


def load(data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """The matrix, the document ids and their lengths."""
    magic, n, m, bits = struct.unpack_from("<4sQQI", data)
    if magic != MAGIC:
        raise ValueError("not a wavelet file")
    at = struct.calcsize("<4sQQI")
    more = struct.unpack_from(f"<{bits}Q{bits + 1}Q", data, at)
    at += 8 * len(more)
    raw = []
    for i, size in enumerate(more[bits:]):
        raw.append(np.frombuffer(pa.decompress(data[at : at + size], decompressed_size=17 * m if i == 0 else (n + 7) // 8, codec="zstd", asbytes=True), np.uint8))
        at += size
    known, ids, lengths = raw[0][:m], raw[0][m : 9 * m].view("<i8") if m else [], raw[0][9 * m :].view("<i8") if m else np.zeros(0, np.int64)
    return WaveletMatrix(raw[1:], list(more[:bits]), n), [int(d) if k else None for d, k in zip(ids, known, strict=True)], lengths


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, shard_tokens: int = 1 << 23, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents in ascending id order; returns one row per shard: shard, path, start, n_docs, n_tokens.

    Documents are range-partitioned by id, so only the shards' sizes are ever put in
    one place; a shard is closed once it holds `shard_tokens` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = bpe.encoder(tokenizer), TaskContext.get().partitionId()
        bits = max(1, (enc.size - 1).bit_length())
        names: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size, number = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, held, lengths, size, number
            path, sizes = f"{folder}/shard-{part:06d}-{number:06d}.wvm", np.concatenate(lengths)
            write_bytes(path, dump(WaveletMatrix.build(np.concatenate(held), bits), names, sizes))
            row = pa.record_batch([pa.array([x]) for x in (part << 24 | number, path, len(names), int(sizes.sum()))], names=["shard", "path", "n_docs", "n_tokens"])
            names, held, lengths, size, number = [], [], [], 0, number + 1
            return row

        for b, buf, off in tc.slices(batches, limit=4 << 20):
            ids, to = enc.encode(buf, off)
            if end_id is not None:
                ids = np.insert(ids, to[1:], end_id)
                to = to + np.arange(len(to))
            names += tc.column(b, "doc_id").to_pylist()
            held.append(ids.astype(np.uint16 if bits <= 16 else np.uint32))
            lengths.append(to[1:] - to[:-1])
            size += len(ids)
            if size >= shard_tokens:
                yield close()
        if names:
            yield close()

    rows = texts(docs, doc, text)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(map_arrow(ordered, run, "shard long, path string, n_docs long, n_tokens long"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(tc.column(b, "path").to_pylist(), tc.column(b, "start").to_pylist(), strict=True):
                wm, names, lengths = load(read_bytes(path))
                ids, ends = wm.all(), np.cumsum(lengths)
                raw = [ids[a:e].astype("<u4").tobytes() for a, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(names, pa.int64()), pa.array(ends - lengths + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.record_batch([*cols, *([pa.array(raw, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    # a stated number of partitions, as shards are small rows that stand for much work
    spread = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return map_arrow(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def new_folder(docs: DataFrame) -> str:
    return shared_dir(docs.sparkSession) + "/shards"
