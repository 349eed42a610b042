"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: unit vectors, less the sample's mean, are turned by rotations that iterative
quantization has fitted on a bounded sample, and signs are taken.  Several
rotations from different starts are laid end to end.  A code is split into
substrings of 16 bits, each with an index of its own.  For r = a * substrings + b, two codes
that differ in at most r bits differ in at most a bits in one of the first b + 1
substrings or in fewer than a in one of the others, so probing the indexes within
those radii meets every code within r.  Codes met within `far` bits in all are
ranked by cosines of the vectors in double precision.

r is the least radius at which `reach` of the sample's own true neighbours are met, and
`far` the distance within which that share of them lie.  Every row is indexed, in the block of
rows of the task that holds it; queries are read in blocks from a table in the shared
folder and each task sends on only its best `k` for a query.  A substring's buckets
within a radius are listed by flipping bits, or, where the block has fewer different
substrings than there are flips, by comparing those: the same buckets either way.
Queries that find fewer than `k` are searched again with an unlimited radius.

Equal vectors of a block are one entry with its k + 1 smallest ids, which loses
nothing: more of them could not be among anyone's k.

A bound on recall is measured, not proved: neighbours that are met nowhere within r are lost.

Cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; a null id takes no part; rows with equal ids are
one candidate (its best vector counts) and one query (its least vector); ties go to the
smaller id; fewer than k candidates give fewer rows; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import textcore as tc
from graphloom.llm.shared import filesystem, map_arrow, written

BLOCK = 1 << 16
QUERIES = 256


PART = 16  # bits of a substring


@dataclass
class Coder:
    mean: np.ndarray
    turns: list[np.ndarray]
    radius: int
    far: int

    @property
    def bits(self) -> int:
        return sum(t.shape[1] for t in self.turns)

    @property
    def parts(self) -> int:
        return -(-self.bits // PART)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Packed codes, rows of bytes padded to whole 64-bit words."""
        sign = np.concatenate([(unit - self.mean) @ t > 0 for t in self.turns], 1)
        packed = np.packbits(sign, axis=1, bitorder="little")
        return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))))

    def reaches(self, radius: int) -> np.ndarray:
        """Bits to flip in each substring so that every code within `radius` is met (-1: none needed)."""
        a, b = divmod(radius, self.parts)
        return np.where(np.arange(self.parts) <= b, a, a - 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances between packed codes."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for u, v in zip(a.view(np.uint64).T, b.view(np.uint64).T, strict=True):
        out += np.bitwise_count(u[:, None] ^ v[None, :])
    return out


def fit(sample: np.ndarray, rotations: int = 6, steps: int = 25, k: int = 5, reach: float = 0.98, seed: int = 5) -> Coder:
    """Rotations by iterative quantization, and the radius at which `reach` of the sample's own true neighbours are met.

    A larger table has closer neighbours than its sample, so the radius errs on the wide side.
    """
    rng = np.random.default_rng(seed)
    unit = _unit(sample)
    mean = unit.mean(0)
    x = unit - mean
    d = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1].T[::-1]
    turns = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.normal(size=(d, d)))
        v = x @ axes.T
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        turns.append(axes.T @ r)
    coder = Coder(mean, turns, sum(t.shape[1] for t in turns), sum(t.shape[1] for t in turns))
    if len(unit) <= k:
        return coder
    drawn = np.random.default_rng(seed).permutation(len(unit))[:1024]  # of the whole sample: groups of ids may be alike
    q = unit[drawn]
    near = q @ unit.T
    near[np.arange(len(q)), drawn] = -np.inf
    top = np.argsort(-near, 1)[:, :k]
    codes = coder.codes(unit)
    apart = np.bitwise_count(codes.view(np.uint16)[drawn][:, None, : coder.parts] ^ codes.view(np.uint16)[top][:, :, : coder.parts]).astype(np.int64)
    need = (apart * coder.parts + np.arange(coder.parts)).min(2)  # the least radius at which some substring is probed so far
    coder.radius = int(np.quantile(need, reach, method="higher"))
    coder.far = int(np.quantile(apart.sum(2), 1 - (1 - reach) / 2, method="higher"))
    return coder


class MultiIndex:
    """Buckets of the rows of one block by each substring of their codes."""

    def __init__(self, codes: np.ndarray, coder: Coder):
        self.codes, self.coder, self.met = codes, coder, 0
        words = codes.view(np.uint16)
        self.order = [np.argsort(words[:, j], kind="stable") for j in range(coder.parts)]
        self.values, self.begin = [], []
        for j, o in enumerate(self.order):
            value, first = np.unique(words[o, j], return_index=True)
            self.values.append(value)
            self.begin.append(np.append(first, len(o)))

    def _buckets(self, j: int, value: int, flips: int) -> np.ndarray:
        """Numbers of the substring's buckets within that many flips of a value."""
        masks = _flips(min(flips, PART))
        if len(masks) >= len(self.values[j]):
            return np.flatnonzero(np.bitwise_count(self.values[j] ^ np.uint16(value)) <= flips)
        want = masks ^ np.uint16(value)
        at = np.minimum(np.searchsorted(self.values[j], want), len(self.values[j]) - 1)
        return at[self.values[j][at] == want]

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows that some substring's probes meet: all within `radius`, and others."""
        met = np.zeros(len(self.codes), bool)
        for j, flips in enumerate(self.coder.reaches(radius).tolist()):
            if flips >= 0:
                at = self._buckets(j, int(query.view(np.uint16)[j]), flips)
                begin = self.begin[j][at]
                met[self.order[j][tc.ragged(begin, self.begin[j][at + 1] - begin)]] = True
        self.met += int(met.sum())
        return np.flatnonzero(met)

    def within(self, query: np.ndarray, radius: int, far: int | None = None) -> np.ndarray:
        """Rows met whose codes differ from this one in at most `far` bits; without that, exactly those within `radius`."""
        rows = self.probe(query, radius)
        return rows[distances(query[None, :], self.codes[rows])[0] <= (radius if far is None else far)]


_masks: dict[int, np.ndarray] = {}


def _flips(n: int) -> np.ndarray:
    """All substrings of at most n ones."""
    if n not in _masks:
        every = np.arange(1 << PART).astype(np.uint16)
        _masks[n] = every[np.bitwise_count(every) <= n]
    return _masks[n]


def _valid(df: DataFrame, vec: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    ok = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (size["d"] if size else 0))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    col = tc.column(b, "v")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = 8192, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among all other rows, by cosine."""
    rows = _valid(vectors, vec, embedding)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().sort_by("vec_id").combine_chunks()
    if not some.num_rows:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    coder = fit(_matrix(some.to_batches()[0]), k=k)
    asked = written(_valid(queries, vec, embedding).groupBy("vec_id").agg(F.min("v").alias("v")))
    best = written(_best(_run(rows, asked, coder, coder.radius, coder.far, k), k))
    short = best.groupBy("query_id").count().filter(F.col("count") >= k)
    again = asked.join(short, asked.vec_id == short.query_id, "left_anti")
    if again.isEmpty():
        return best
    again = written(again)
    rest = _best(_run(rows, again, coder, coder.bits, coder.bits, k), k)
    return best.join(again, best.query_id == again.vec_id, "left_anti").unionByName(rest)


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _run(rows: DataFrame, asked: DataFrame, coder: Coder, radius: int, far: int, k: int) -> DataFrame:
    paths = sorted(asked.inputFiles())
    model = rows.sparkSession.sparkContext.broadcast(coder)  # rotations of one vector length

    def ask(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        coder = model.value
        _, one, group = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        first = np.searchsorted(group[order], np.arange(len(one) + 1))
        x = x[one]
        norm = np.sqrt((x * x).sum(1))
        index = MultiIndex(coder.codes(x / norm[:, None]), coder)
        for path in paths:
            fs, at = filesystem(path) if "://" in path else filesystem("file://" + path.removeprefix("file:"))
            for b in pq.ParquetFile(fs.open_input_file(at)).iter_batches(QUERIES):
                out: list[list] = [[], [], []]
                q = _matrix(b)
                codes = coder.codes(_unit(q))
                for i, (qid, qv) in enumerate(zip(tc.column(b, "vec_id").to_pylist(), q, strict=True)):
                    hit = index.within(codes[i], radius, far)
                    cos = (x[hit] * qv).sum(1) / (norm[hit] * np.sqrt((qv * qv).sum()))
                    keep = cos >= (np.partition(cos, len(cos) - k - 1)[len(cos) - k - 1] if len(cos) > k else -np.inf)
                    pairs = [(-c, v) for c, g in zip(cos[keep].tolist(), hit[keep].tolist(), strict=True) for v in ids[order[first[g] : min(first[g + 1], first[g] + k + 1)]].tolist() if v != qid]
                    for c, v in sorted(pairs)[:k]:
                        out[0].append(qid)
                        out[1].append(v)
                        out[2].append(-c)
                yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, n = [], [], 0
        for b in batches:
            if b.num_rows:
                ids.append(tc.int64(b, "vec_id"))
                xs.append(_matrix(b))
                n += b.num_rows
            if n >= BLOCK:
                yield from ask(np.concatenate(ids), np.concatenate(xs))
                ids, xs, n = [], [], 0
        if n:
            yield from ask(np.concatenate(ids), np.concatenate(xs))

    return map_arrow(rows, run, "query_id long, vec_id long, score double")
