"""Toxicity by a factorization machine over hashed terms.

A term is a word (lower case, outer punctuation removed) or one of its leading
parts of 4, 5 and 6 bytes, hashed to a fixed number of buckets.  The machine adds,
to a weight for each term, an inner product of learned factors for each pair of
terms in a text, so that words that are harmless alone can count together.

Which terms enter is tested twice: terms whose own rate of label 1 departs from the mean
(at most `kept`, strongest first), and pairs of terms whose joint odds depart from the product of
their own odds, whatever each of them tells alone; all terms of such pairs enter.

Fitting uses a bounded sample of labelled rows, `max_rows` and at most `max_terms` terms of
them, those least by hash; the pair test takes `pair_rows` of either label from the sample.
The sample stays in the shared folder; the driver reads it in parts and holds counts and the places of the terms that enter.
Scoring reads every whole text once and shuffles nothing.

Cases: a null or empty text has no terms and gets the score of the bias; a text of any
length is scored whole, each term once; equal scores of the sample are never parted by the
threshold; a null id keeps its row, is not held out and is never learned from; of repeated labels
for one id the larger counts; labels other than 0 and 1 are not learned from;
without any label the score is a constant 0.5 - 1e-6; repeated documents are scored alike, and
learned from once each; empty documents give an empty result; further columns, whatever they
are called, are ignored by `score` and kept by `reject`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.shared import filesystem, map_arrow, remainder, texts, written

BITS = 20
FOLDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PART = 1 << 18  # terms that the fit reads at once, where they are in memory already
Parts = Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]]  # again and again: documents, ascending, and their buckets
_PUNCT = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


@dataclass
class Machine:
    """bias, and for each kept bucket its weight and factors."""

    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, doc: np.ndarray, term: np.ndarray, docs: int) -> np.ndarray:
        """Probability for each document, from its distinct kept terms."""
        z = self.bias + np.bincount(doc, self.weight[term], docs)
        if len(term):
            v = self.factor[term]
            for k in range(v.shape[1]):
                z += 0.5 * (np.bincount(doc, v[:, k], docs) ** 2 - np.bincount(doc, v[:, k] ** 2, docs))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of every term of a slice, and its document."""
    low = _LOWER[buf]
    if len(low) > 1:  # capital letters of the Latin-1 range
        low[1:] += (((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) * 32).astype(np.uint8)
    starts, ends, wo = tc.spans(low, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(wo))
    pad = np.concatenate([_PUNCT[low], [False]])
    while (w := pad[ends - 1] & (ends > starts)).any():
        ends = ends - w
    while (w := pad[starts] & (ends > starts)).any():
        starts = starts + w
    some = ends > starts
    starts, ends, doc = starts[some], ends[some], doc[some]
    hashes, docs = [tc.span_hashes(low, starts, ends)], [doc]
    for k in (4, 5, 6):
        long = np.flatnonzero(ends - starts >= k)
        hashes.append(tc.mix(tc.span_hashes(low, starts[long], starts[long] + k) + np.uint64(k)))
        docs.append(doc[long])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _distinct(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def _parts(doc: np.ndarray, bucket: np.ndarray) -> Parts:
    return lambda: ((doc[i : i + PART], bucket[i : i + PART]) for i in range(0, len(doc), PART))


def pair_terms(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, df: np.ndarray, rows: int, least: float = 8.0, block: int = 512) -> np.ndarray:
    """Terms of all pairs that have label 1 `least` standard errors more or less often than the product of their own odds would have it.

    Of terms that one in a hundred texts (and three) have, on up to `rows` texts of either label.
    """
    return _pair_terms(_parts(doc, bucket), label, df, rows, least, block)


def _pair_terms(parts: Parts, label: np.ndarray, df: np.ndarray, rows: int, least: float = 8.0, block: int = 512) -> np.ndarray:
    n = len(label)
    often = np.flatnonzero((df >= max(3, n // 100)) & (df < n))
    at = np.full(1 << BITS, -1, np.int32)
    at[often] = np.arange(len(often))
    kinds = [np.flatnonzero(label == y)[:rows] for y in (1, 0)]
    if not len(often) or min(map(len, kinds)) == 0:
        return often[:0]
    chosen = np.concatenate(kinds)
    number = np.full(n, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    term, row = [], []
    for doc, bucket in parts():
        t, r = at[bucket], number[doc]
        both = (t >= 0) & (r >= 0)
        t, r = t[both], r[both]
        order = np.argsort(t, kind="stable")
        term.append(t[order].astype(np.uint16 if len(often) <= 1 << 16 else np.int32))
        row.append(r[order].astype(np.uint16 if len(chosen) <= 1 << 16 else np.int32))
    n1, n0 = map(len, kinds)

    def dense(i: int) -> np.ndarray:
        x = np.zeros((n1 + n0, min(block, len(often) - i)), np.float32)
        for t, r in zip(term, row, strict=True):
            a, b = np.searchsorted(t, [i, i + block])
            x[r[a:b], t[a:b] - i] = 1
        return x

    one, none = (sum(np.bincount(t[(r < n1) == side], minlength=len(often)) for t, r in zip(term, row, strict=True)) for side in (True, False))
    own = (np.log((one + 0.5) / (n1 + 1)) - np.log((none + 0.5) / (n0 + 1))).astype(np.float32)
    lean = np.float32(np.log(n0 / n1))
    told = np.zeros(len(often), bool)
    for i in range(0, len(often), block):
        x = dense(i)
        for j in range(i, len(often), block):
            y = x if i == j else dense(j)
            c1, c0 = x[:n1].T @ y[:n1], x[n1:].T @ y[n1:]
            m = c1 + c0
            p = 1 / (1 + np.exp(np.clip(lean - own[i : i + block, None] - own[None, j : j + block], -30, 30)))
            z = (c1 - m * p) / np.sqrt(m * p * (1 - p) + 1)
            if i == j:
                np.fill_diagonal(z, 0)
            hit = np.abs(z) > least
            told[i : i + block] |= hit.any(1)
            told[j : j + block] |= hit.any(0)
    return often[told]


def fit(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, kept: int = 4096, pair_rows: int = 4000, rank: int = 8, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the log loss, over terms that tell alone or in pairs.  `doc` ascends."""
    return _fit(_parts(doc, bucket), label, kept, pair_rows, rank, epochs, rate, decay, seed)


def _fit(parts: Parts, label: np.ndarray, kept: int = 4096, pair_rows: int = 4000, rank: int = 8, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    n = len(label)
    prior = float(label.mean()) if n else 0.0
    none = Machine(np.zeros(0, np.int64), float(np.log(min(max(prior, 1e-6), 0.5 - 1e-6) / (1 - min(max(prior, 1e-6), 0.5 - 1e-6)))) if n else -4e-6, np.zeros(0), np.zeros((0, rank)))
    if not n or prior in (0.0, 1.0):
        if prior == 1.0:
            none.bias = 4.0
        return none
    df, pos, one = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), label > 0
    for doc, bucket in parts():
        df += np.bincount(bucket, minlength=1 << BITS)
        pos += np.bincount(bucket[one[doc]], minlength=1 << BITS)
    z = (pos - prior * df) / np.sqrt(df * prior * (1 - prior) + 1)
    use = np.flatnonzero((df >= min(3, 1 + n // 100)) & (np.abs(z) > 2.5))
    use = use[np.argsort(-np.abs(z[use]), kind="stable")][:kept]
    del z, pos
    use = np.union1d(use, _pair_terms(parts, label, df, pair_rows))
    del df
    at = np.full(1 << BITS, -1, np.int32)
    at[use] = np.arange(len(use))
    held, size = [], np.zeros(n, np.int64)
    for doc, bucket in parts():
        t = at[bucket]
        held.append(t[t >= 0])
        size += np.bincount(doc[t >= 0], minlength=n)
    term = np.concatenate(held)
    del held, at
    begin = np.concatenate([[0], np.cumsum(size)])
    rng = np.random.default_rng(seed)
    m = Machine(use, float(np.log(prior / (1 - prior))), np.zeros(len(use)), rng.normal(0, 0.01, (len(use), rank)))
    gb, gw, gv = 1e-8, np.full(len(use), 1e-8), np.full(m.factor.shape, 1e-8)
    for _ in range(epochs):
        perm = rng.permutation(n)
        for i in range(0, n, 128):
            rows = perm[i : i + 128]
            t = term[tc.ragged(begin[rows], size[rows])]
            d = np.repeat(np.arange(len(rows)), size[rows])
            p = m.score(d, t, len(rows))
            g = (p - label[rows]) / len(rows)
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(gb)
            if not len(t):
                continue
            v = m.factor[t]
            s = np.stack([np.bincount(d, v[:, k], len(rows)) for k in range(rank)], 1)
            dw = np.bincount(t, g[d], len(use))
            dv = np.zeros_like(m.factor)
            np.add.at(dv, t, g[d][:, None] * (s[d] - v))
            hit = np.unique(t)
            dw[hit] += decay * m.weight[hit]
            dv[hit] += decay * m.factor[hit]
            gw[hit] += dw[hit] ** 2
            gv[hit] += dv[hit] ** 2
            m.weight[hit] -= rate * 4 * dw[hit] / np.sqrt(gw[hit])
            m.factor[hit] -= rate * dv[hit] / np.sqrt(gv[hit])
    p = np.concatenate([m.score(np.repeat(np.arange(min(256, n - i)), size[i : i + 256]), term[begin[i] : begin[min(n, i + 256)]], min(256, n - i)) for i in range(0, n, 256)])
    m.bias -= _cut(np.log(p / (1 - p)), label)
    return m


def _cut(z: np.ndarray, label: np.ndarray) -> float:
    """Of the points that part the sample with fewest errors, the middle of the widest gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], label[order]
    errors = np.concatenate([[(1 - y).sum()], (1 - y).sum() + np.cumsum(2 * y - 1)])[1:-1]  # all up to here called 0
    gap = np.diff(z)
    best = np.flatnonzero((errors == errors[gap > 0].min()) & (gap > 0)) if (gap > 0).any() else []
    if not len(best):
        return 0.0
    i = best[np.argmax(gap[best])]
    return float((z[i] + z[i + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16000, max_terms: int = 1 << 25, folds: int = FOLDS, doc: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> Machine:
    """Fits on at most `max_rows` labelled rows and `max_terms` terms outside the held-out fold."""
    known = labels.select(F.col(doc).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter((remainder("doc_id", folds) > 0) & F.col("y").isin(0, 1))
    sample = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = texts(docs, doc, text).join(F.broadcast(sample), "doc_id")  # at most max_rows pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, off in tc.slices(batches):
            bucket, owner = terms(buf, off)
            owner, bucket = _distinct(owner, bucket)
            cut = np.searchsorted(owner, np.arange(b.num_rows + 1)).tolist()
            yield pa.record_batch([tc.column(b, "doc_id"), tc.column(b, "y"), pa.array([bucket[i:j].astype("<u4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "y", "terms"])

    made = written(map_arrow(chosen, run, "doc_id long, y int, terms binary"))
    so_far = F.sum(F.octet_length("terms") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "terms"))  # over at most max_rows rows
    held = written(made.select("*", so_far.alias("so_far")).filter(F.col("so_far") <= max_terms).select("y", "terms"))  # in the window's order
    paths = sorted(held.inputFiles())

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = 0
        for b in _batches(paths, ["terms"]):
            rows = b["terms"].to_pylist()
            yield np.repeat(np.arange(n, n + len(rows), dtype=np.int32), [len(x) // 4 for x in rows]), np.frombuffer(b"".join(rows), "<i4")
            n += len(rows)

    return _fit(parts, np.array([y for b in _batches(paths, ["y"]) for y in b["y"].to_pylist()], float), **options)


def _batches(paths: list[str], columns: list[str], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A few rows of a Parquet table at a time, read through a small buffer."""
    for path in paths:
        fs, at = filesystem(path)
        with fs.open_input_file(at) as f:
            yield from pa.parquet.ParquetFile(f, buffer_size=1 << 20).iter_batches(rows, columns=columns, use_threads=False)


def score(docs: DataFrame, machine: Machine, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and n_terms (distinct terms that the machine knows) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # at most `kept` terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        at = np.full(1 << BITS, -1, np.int32)
        at[m.buckets] = np.arange(len(m.buckets))
        for b, buf, off in tc.slices(batches):
            bucket, owner = terms(buf, off)
            term = at[bucket]
            known = term >= 0
            owner, term = _distinct(owner[known], term[known].astype(np.int64))
            yield pa.record_batch([tc.column(b, "doc_id"), pa.array(m.score(owner, term, b.num_rows)), pa.array(np.bincount(owner, minlength=b.num_rows))], names=["doc_id", "score", "n_terms"])

    return map_arrow(texts(docs, doc, text), run, "doc_id long, score double, n_terms long")


def reject(docs: DataFrame, machine: Machine, threshold: float = 0.5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, that score under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        at = np.full(1 << BITS, -1, np.int32)
        at[m.buckets] = np.arange(len(m.buckets))
        for b, buf, off in tc.slices(batches, text=text):
            bucket, owner = terms(buf, off)
            term = at[bucket]
            known = term >= 0
            owner, term = _distinct(owner[known], term[known].astype(np.int64))
            yield b.filter(pa.array(m.score(owner, term, b.num_rows) < threshold))

    return docs.mapInArrow(run, docs.schema)
