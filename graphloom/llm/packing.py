"""Bounded-space online packing of token ids into windows of fixed length.

Each partition keeps `open_windows` windows open.  A document's tokens (cut into
full windows first if it is longer than one) go to the window where they fit
best.  Where none has room, the fullest is topped up with the head of what is
waiting, emitted, and the rest is placed in turn.  What is open at the end of a
partition is joined there to full windows and less than one more; those last
ones of all partitions, ids included, are merged in one pass over at most one
window a partition.  The final remainder is cut at powers of two, which are not
padded.

Cases: a null text counts as empty and still has its end id; a null doc_id
packs like any other; repeated rows are packed once each; a text of any length is cut into full windows; of equally
roomy windows the first opened is taken; an empty table gives no
rows; further columns are not carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm import textcore as tc
from graphloom.llm.shared import map_arrow, texts, written

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, waiting int"
_ARROW = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary()), ("waiting", pa.int32())])
Piece = tuple  # (doc_id, start, ids, doc_tokens)


class Packer:
    """Open windows by free room.  `put` returns the windows that it closed."""

    def __init__(self, window: int, count: int):
        self.window, self.count = window, count
        self.open: list[tuple[int, list[Piece]]] = []  # (room, pieces)

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, ids, total = piece
        while len(ids) >= self.window:
            yield [(doc, start, ids[: self.window], total)]
            ids, start = ids[self.window :], start + self.window
        while len(ids):
            fits = [(room, i) for i, (room, _) in enumerate(self.open) if room >= len(ids)]
            if fits and (len(self.open) >= self.count or min(fits)[0] < self.window // 4):
                room, i = min(fits)
            elif len(self.open) < self.count:
                self.open.append((self.window, []))
                room, i = self.window, len(self.open) - 1
            else:
                room, i = min((room, i) for i, (room, _) in enumerate(self.open))
            take = min(room, len(ids))
            held = self.open[i][1]
            held.append((doc, start, ids[:take], total))
            self.open[i] = (room - take, held)
            ids, start = ids[take:], start + take
            if room == take:
                yield held
                del self.open[i]


def recut(pieces: list[Piece], window: int, powers: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Pieces laid end to end as full windows, and the rest: cut at powers of two if `powers`, else returned as pieces."""
    total, out, left = sum(len(p[2]) for p in pieces), [], list(pieces)
    sizes = [window] * (total // window)
    if powers:
        sizes += [1 << b for b in range(window.bit_length(), -1, -1) if total % window >> b & 1]
    for size in sizes:
        row: list[Piece] = []
        while size:
            doc, start, ids, n = left[0]
            take = min(size, len(ids))
            row.append((doc, start, ids[:take], n))
            left[0] = (doc, start + take, ids[take:], n)
            if take == len(ids):
                del left[0]
            size -= take
        out.append(_joined(row))
    return out, _joined(left)


def _joined(row: list[Piece]) -> list[Piece]:
    """Neighbouring pieces of one document that follow one another are one piece."""
    out: list[Piece] = []
    for p in row:
        if out and out[-1][0] == p[0] and out[-1][1] + len(out[-1][2]) == p[1] and out[-1][3] == p[3]:
            out[-1] = (p[0], out[-1][1], np.concatenate([out[-1][2], p[2]]), p[3])
        else:
            out.append(p)
    return out


def _rows(windows: list[tuple[int, list[Piece]]], keep_ids: bool, waiting: int = 0) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in _ARROW]
    for number, row in windows:
        at = 0
        for doc, start, ids, total in row:
            raw = ids.astype("<u4").tobytes()
            for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), total, number, at, raw if keep_ids or waiting else None, waiting), strict=True):
                c.append(v)
            at += len(ids)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int | None = 2, open_windows: int = 32, keep_ids: bool = False, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if `keep_ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = bpe.encoder(path), Packer(window, open_windows)
        number, ready = TaskContext.get().partitionId() << 40, []
        for part, buf, off in tc.slices(batches, limit=4 << 20):
            ids, to = enc.encode(buf, off)
            for d, a, b in zip(tc.column(part, "doc_id").to_pylist(), to[:-1].tolist(), to[1:].tolist(), strict=True):
                own = ids[a:b] if end_id is None else np.append(ids[a:b], np.int32(end_id))
                for row in packer.put((d, 0, own, len(own))):
                    ready.append((number, row))
                    number += 1
            yield _rows(ready, keep_ids)
            ready = []
        full, rest = recut([p for _, row in packer.open for p in row], window, powers=False)
        yield _rows([(number + i, row) for i, row in enumerate(full)], keep_ids)
        if rest:
            yield _rows([(number + len(full), rest)], True, 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = -1, []
        for b in batches:
            for d, start, raw, total in zip(*(tc.column(b, k).to_pylist() for k in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                held.append((d, start, np.frombuffer(raw, "<u4").astype(np.int32), total))
            full, held = recut(held, window, powers=False)
            yield _rows([(number - i, row) for i, row in enumerate(full)], keep_ids)
            number -= len(full)
        full, _ = recut(held, window, powers=True)
        yield _rows([(number - i, row) for i, row in enumerate(full)], keep_ids)

    placed = written(map_arrow(texts(docs, doc, text), run, SCHEMA), by=("waiting",))
    # at most one window a partition waits, so one task streams them all
    last = map_arrow(placed.filter("waiting = 1").drop("waiting").repartitionByRange(1, "sequence_id").sortWithinPartitions("sequence_id", "offset"), merge, SCHEMA)
    out = [F.col(k) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))]
    return placed.filter("waiting = 0").select(out).unionByName(last.select(out))
