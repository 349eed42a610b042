"""Sets of hashed items compared block by block.

Rows are sets, kept sparse; what two groups of rows have in common is a product of incidence
matrices, made dense for a bounded number of rows and columns at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASKED, KNOWN, COLUMNS = 1024, 8192, 2048  # rows that ask, rows that are met, items made dense at once


def lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and flat values of a column of lists."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(c.offsets.to_numpy()), c.flatten().to_numpy(zero_copy_only=False)


class Sets:
    """Rows of items with values (1 if none are given); items that only one row has are left out unless `alone`, as nothing else shares them."""

    def __init__(self, size: np.ndarray, item: np.ndarray, value: np.ndarray | None = None, alone: bool = False):
        owner = np.repeat(np.arange(len(size)), size)
        self.items, column, count = np.unique(item, return_inverse=True, return_counts=True)
        kept = (count > 1) | alone
        use = kept[column]
        self.items, self.column = self.items[kept], (np.cumsum(kept) - 1)[column[use]]
        self.value = np.ones(len(self.column)) if value is None else value[use]
        self.size = np.bincount(owner[use], minlength=len(size))
        self.start = np.concatenate([[0], np.cumsum(self.size)])

    def at(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all items of these rows, and which of the rows each belongs to."""
        n = self.size[rows]
        return np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(rows)), n)

    def dense(self, rows: np.ndarray, low: int, values: bool = False) -> np.ndarray:
        at, owner = self.at(rows)
        column = self.column[at] - low
        width = min(COLUMNS, len(self.items) - low)
        use = (column >= 0) & (column < width)
        x = np.zeros((len(rows), width), np.float64 if values else np.float32)
        x[owner[use], column[use]] = self.value[at[use]] if values else 1
        return x

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items each of the rows a and each of the rows b have in common."""
        out = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, len(self.items), COLUMNS):
            out += self.dense(a, low) @ self.dense(b, low).T
        return out

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums of products of values over the common items."""
        out = np.zeros((len(a), len(b)))
        for low in range(0, len(self.items), COLUMNS):
            out += self.dense(a, low, True) @ self.dense(b, low, True).T
        return out

    def weights(self, a: np.ndarray) -> np.ndarray:
        """Sums of values over the items that each two of the rows a have in common."""
        out = np.zeros((len(a), len(a)))
        for low in range(0, len(self.items), COLUMNS):
            out += self.dense(a, low, True) @ self.dense(a, low).T
        return out

    def summed(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each of the rows a the sum of its values over the items that it shares with rows b, which count n times."""
        out = np.zeros(len(a))
        for low in range(0, len(self.items), COLUMNS):
            out += self.dense(a, low, True) @ (self.dense(b, low).T.astype(np.float64) @ n)
        return out


def every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def spread(blocks: DataFrame, pairs: int) -> DataFrame:
    """Block pairs (i, j) in partitions of their own: they are small to read and long to compute, so they must not be put together by size."""
    return blocks.repartition(min(pairs, 4096), "i", "j").groupBy("i", "j")


def least(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least finite values of each row in order, of equal ones the first."""
    if x.shape[1] > k:
        limit = np.partition(x, k - 1, axis=1)[:, k - 1 : k]
    else:
        limit = np.full((len(x), 1), np.inf)
    row, column = np.nonzero((x <= limit) & np.isfinite(x))
    order = np.lexsort((column, x[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k]


def strongest(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """a, b, score: for each row (a, n, x) the k rows (b, n, x) with the greatest sum of products of x over common items n, among those that have one; ties (to nine places) to the smaller b.

    `n` are arrays of longs, `x` of doubles.  Every pair of blocks is one product and sends on only k for each a.
    """
    na, nb = max(1, -(-asked.count() // ASKED)), max(1, -(-known.count() // KNOWN))
    left = asked.select(F.col("a").alias("key"), "n", "x", F.pmod(F.xxhash64("a"), F.lit(na)).cast("int").alias("i"), every(nb).alias("j"), F.lit(True).alias("asks"))
    right = known.select(F.col("b").alias("key"), "n", "x", every(na).alias("i"), F.pmod(F.xxhash64("b"), F.lit(nb)).cast("int").alias("j"), F.lit(False).alias("asks"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("key").combine_chunks()
        asks, key = t["asks"].to_numpy(), t["key"].to_numpy()
        (size, item), (_, value) = lists(t["n"]), lists(t["x"])
        s, a, b = Sets(size, item, value), np.flatnonzero(asks), np.flatnonzero(~asks)
        score = np.where(s.shared(a, b) > 0, s.products(a, b), -np.inf)
        row, column = least(-np.round(score, 9), k)  # columns are in key order
        return pa.table({"a": key[a][row], "b": key[b][column], "score": score[row, column]})

    found = spread(left.unionByName(right), na * nb).applyInArrow(meet, "a long, b long, score double")
    w = Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "b")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


ORDERED, STEP = 32768, 512  # records of a range, and of the parts that are compared record by record


def later(asked: DataFrame, ordered: DataFrame, jaccard: bool = False) -> DataFrame:
    """id, pairs, weight of every row of `ordered` (id, c): how many rows of greater id have an item in common with it, and the sum of their weights.

    `asked` (c, n, x, own) has the items of each set c with their values.  The weight of a pair is the sum of x over common
    items, or with `jaccard` their share of all `own` items of both.  Rows are in ranges by id: a later range counts
    by its sets, and inside a range halves of halves meet by the sets that they have, so no pairs are made.
    """
    from graphloom.plans.lineage import cut

    parts, blocks = max(1, -(-ordered.count() // ORDERED)), max(1, -(-asked.count() // KNOWN))
    placed = cut(ordered.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()).withColumn("i", F.spark_partition_id()))
    have = cut(placed.groupBy("i", "c").agg(F.count("*").alias("m")))
    grid = asked.select("c", every(parts).alias("i")).join(have, ["c", "i"], "left").fillna(0, ["m"])
    after = grid.withColumn("m", F.sum("m").over(Window.partitionBy("c").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1))).filter("m > 0")
    own = have.select("i", "c").join(asked, "c")
    none = F.lit(None)
    left = own.select("i", every(blocks).alias("j"), "c", "n", "x", "own", none.cast("long").alias("m"))
    right = after.join(asked, "c").select("i", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("j"), "c", "n", "x", "own", "m")

    def added(s: Sets, held: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs, weight = np.zeros(len(a)), np.zeros(len(a))
        for k in range(0, len(a), STEP):
            rows = a[k : k + STEP]
            shared = s.shared(rows, b)
            pairs[k : k + STEP] = (shared > 0) @ n
            if jaccard:
                shared = shared.astype(np.float64)
                weight[k : k + STEP] = (shared / (held[rows][:, None] + held[b][None, :] - shared)) @ n
        return pairs, weight if jaccard else s.summed(a, b, n)

    def outside(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        (size, item), (_, value) = lists(t["n"]), lists(t["x"])
        asks = t["m"].is_null().to_numpy()
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        pairs, weight = added(Sets(size, item, value), t["own"].to_numpy(), a, b, t["m"].to_numpy()[b].astype(np.float64))
        return pa.table({"i": t["i"].take(a), "c": t["c"].take(a), "pairs": pairs, "weight": weight})

    def inside(t: pa.Table) -> pa.Table:
        sets, rows = t.filter(t["at"].is_null()).sort_by("c").combine_chunks(), t.filter(t["at"].is_valid()).sort_by("at").combine_chunks()
        (size, item), (_, value) = lists(sets["n"]), lists(sets["x"])
        s, held = Sets(size, item, value, alone=True), sets["own"].to_numpy()
        at = np.searchsorted(sets["c"].to_numpy(), rows["c"].to_numpy())
        pairs, weight = np.zeros(len(at)), np.zeros(len(at))
        for k in range(0, len(at), STEP):
            u, of = np.unique(at[k : k + STEP], return_inverse=True)
            shared = s.shared(u, u).astype(np.float64)
            w = shared / (held[u][:, None] + held[u][None, :] - shared) if jaccard else s.weights(u)
            pairs[k : k + STEP] = np.triu((shared > 0)[of][:, of], 1).sum(1)
            weight[k : k + STEP] = np.triu(w[of][:, of], 1).sum(1)
        half = STEP
        while half < len(at):
            for k in range(0, len(at) - half, 2 * half):
                (a, of), (b, n) = np.unique(at[k : k + half], return_inverse=True), np.unique(at[k + half : k + 2 * half], return_counts=True)
                p, w = added(s, held, a, b, n.astype(np.float64))
                pairs[k : k + half] += p[of]
                weight[k : k + half] += w[of]
            half *= 2
        return pa.table({"id": rows["id"], "i": rows["i"], "c": rows["c"], "pairs": pairs, "weight": weight})

    far = spread(left.unionByName(right), parts * blocks).applyInArrow(outside, "i int, c long, pairs double, weight double").groupBy("i", "c").agg(F.sum("pairs").alias("p"), F.sum("weight").alias("w"))
    empty = own.select("i", F.lit(0).alias("j"), "c", "n", "x", "own", none.cast("long").alias("at"), none.cast("string").alias("id"))
    full = placed.select("i", F.lit(0).alias("j"), "c", none.cast("array<long>").alias("n"), none.cast("array<double>").alias("x"), none.cast("long").alias("own"), "at", "id")
    near = spread(empty.unionByName(full), parts).applyInArrow(inside, "id string, i int, c long, pairs double, weight double")
    out = near.join(far, ["i", "c"], "left")
    more = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("id", (F.col("pairs") + more("p")).cast("long").alias("pairs"), (F.col("weight") + more("w")).alias("weight"))


def strengths(sets: DataFrame) -> DataFrame:
    """sig, k of every set (sig, f, n) that has any: the pairs of its n members with each other and with members of sets that have items in common with it."""
    blocks, others = _sides(sets)
    sides = sets.select("sig", "f", "n", F.pmod(F.xxhash64("sig"), F.lit(blocks)).cast("int").alias("i"), every(others).alias("j"), F.lit(True).alias("asks"))
    sides = sides.unionByName(sets.select("sig", "f", "n", every(blocks).alias("i"), F.pmod(F.xxhash64("sig"), F.lit(others)).cast("int").alias("j"), F.lit(False).alias("asks")))

    def meet(t: pa.Table) -> pa.Table:
        s, a, b, n, same = _sigs(t)
        k = ((s.shared(a, b) > 0) @ n[b]) * n[a] - np.where(same >= 0, n[a], 0)
        return pa.table({"sig": t["sig"].take(a), "k": k})

    return spread(sides, blocks * others).applyInArrow(meet, "sig string, k double").groupBy("sig").agg(F.sum("k").alias("k")).filter("k > 0")


def best_moves(state: DataFrame, resolution: float, total: float) -> DataFrame:
    """sig, to: the community of greatest gain for each set (sig, f, n, k, c), its own included; ties (to nine places) to the least.

    The side that is met is in blocks of whole communities, so each block knows its gains and sends on one for each set.
    """
    blocks, others = _sides(state)
    group = F.pmod(F.xxhash64("c"), F.lit(others)).cast("int")
    sides = state.select("sig", "f", "n", "k", "c", F.pmod(F.xxhash64("sig"), F.lit(blocks)).cast("int").alias("i"), every(others).alias("j"), F.lit(True).alias("asks"))
    sides = sides.unionByName(state.select("sig", "f", "n", "k", "c", every(blocks).alias("i"), group.alias("j"), F.lit(False).alias("asks")))

    def meet(t: pa.Table) -> pa.Table:
        s, a, b, n, same = _sigs(t)
        if not len(a) or not len(b):
            return pa.table({"sig": pa.array([], pa.string()), "g": np.zeros(0), "c": np.zeros(0, np.int64)})
        c, k = t["c"].to_numpy(), t["k"].to_numpy()
        b_order = np.argsort(c[b], kind="stable")
        place = np.empty(len(b), np.int64)
        place[b_order] = np.arange(len(b))
        same = np.where(same >= 0, place[same], -1)
        b = b[b_order]
        named, begin = np.unique(c[b], return_index=True)
        held = np.add.reduceat(k[b], begin)
        gain, to = np.zeros(len(a)), np.zeros(len(a), np.int64)
        here = np.zeros(len(a), bool)
        for r in range(0, len(a), STEP):
            rows = a[r : r + STEP]
            w = (s.shared(rows, b) > 0) * n[b][None, :] * n[rows][:, None]
            me = np.flatnonzero(same[r : r + STEP] >= 0)
            w[me, same[r : r + STEP][me]] = 0
            w = np.add.reduceat(w, begin, axis=1)
            now = named[None, :] == c[rows][:, None]
            g = w - resolution * k[rows][:, None] * (held[None, :] - np.where(now, k[rows][:, None], 0.0)) / total
            g = np.where(np.abs(g) < 9e6, np.round(g, 9), g)
            g[(w == 0) & ~now] = -np.inf
            best = g.argmax(1)  # communities are in order
            gain[r : r + STEP], to[r : r + STEP] = g[np.arange(len(rows)), best], named[best]
            here[r : r + STEP] = np.isfinite(gain[r : r + STEP])
        return pa.table({"sig": t["sig"].take(a[here]), "g": -gain[here], "c": to[here]})

    found = spread(sides, blocks * others).applyInArrow(meet, "sig string, g double, c long")
    return found.groupBy("sig").agg(F.min(F.struct("g", "c")).alias("m")).select("sig", F.col("m.c").alias("to"))


def _sides(sets: DataFrame) -> tuple[int, int]:
    n = sets.count()
    return max(1, -(-n // ASKED)), max(1, -(-n // KNOWN))


def _sigs(t: pa.Table) -> tuple[Sets, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a block pair, the rows of both sides, member counts, and for each row that asks its place among the others, or -1."""
    asks = t["asks"].to_numpy()
    a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
    at = {x: i for i, x in enumerate(t["sig"].take(b).to_pylist())}
    same = np.array([at.get(x, -1) for x in t["sig"].take(a).to_pylist()], np.int64)
    return Sets(*lists(t["f"])), a, b, t["n"].to_numpy().astype(np.float64), same
