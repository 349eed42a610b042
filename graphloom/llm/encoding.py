"""BPE encoding and decoding of a text column.

Cases: a null or empty text has no ids and decodes to an empty text; a null id
keeps its row; repeated rows are encoded once each; an empty table gives an
empty result with the same columns; a text of any length is encoded whole (long pieces by a heap); further columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import bpe
from graphloom.llm import textcore as tc
from graphloom.llm.shared import map_arrow, texts

SLICE = 4 << 20
KINDS = {"n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
DDL = {"n_tokens": "long", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `outputs`: n_tokens, ids (little-endian unsigned 32-bit), decoded, ids_sha256, decoded_sha256.

    One pass over the scan's own partitions; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for part, buf, off in tc.slices(batches, limit=SLICE):
            ids, to = enc.encode(buf, off)
            ids = ids.astype("<u4")
            cells: dict[str, list] = {k: [] for k in outputs}
            for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
                own = ids[a:b]
                for k, v in cells.items():
                    if k == "n_tokens":
                        v.append(b - a)
                    elif k == "ids":
                        v.append(own.tobytes())
                    elif k == "ids_sha256":
                        v.append(hashlib.sha256(own.tobytes()).hexdigest())
                    else:
                        plain = enc.decode(own)
                        v.append(plain.decode() if k == "decoded" else hashlib.sha256(plain).hexdigest())
            yield pa.record_batch([tc.column(part, "doc_id"), *(pa.array(cells[k], KINDS[k]) for k in outputs)], names=["doc_id", *outputs])

    return map_arrow(texts(docs, doc, text), run, "doc_id long, " + ", ".join(f"{k} {DDL[k]}" for k in outputs))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and text of rows with binary ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for b in batches:
            out = [enc.decode(np.frombuffer(x or b"", "<u4")).decode() for x in tc.column(b, "ids").to_pylist()]
            yield pa.record_batch([tc.column(b, "doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.selectExpr("doc_id", f"`{ids}` as ids"), run, "doc_id long, text string")
