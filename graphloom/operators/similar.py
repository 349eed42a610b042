"""Similarity, nearest neighbours and what follows from them: rates, recommendation, co-occurrence, training tables."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import numeric, vectors
from graphloom.functions import text as tx
from graphloom.operators import structure
from graphloom.operators.blocks import ASKED, KNOWN, Sets, every, least, lists, spread, strongest
from graphloom.operators.build import Graph
from graphloom.plans.lineage import cut


def nearest(asked: DataFrame, known: DataFrame, k: int, sharing: bool = False) -> DataFrame:
    """a, b, distance: for each set (a, f) the k nearest of the sets (b, f) by Jaccard distance, ties to the smaller b; `sharing` leaves out those with nothing in common.

    `f` are arrays of longs, `a` and `b` longs.  Blocks of sets meet as products of incidence
    matrices over the items that both blocks have, and a block pair sends on only k for each a.
    """
    na, nb = max(1, -(-asked.count() // ASKED)), max(1, -(-known.count() // KNOWN))
    left = asked.select(F.col("a").alias("key"), "f", F.pmod(F.xxhash64("a"), F.lit(na)).cast("int").alias("i"), every(nb).alias("j"), F.lit(True).alias("asks"))
    right = known.select(F.col("b").alias("key"), "f", every(na).alias("i"), F.pmod(F.xxhash64("b"), F.lit(nb)).cast("int").alias("j"), F.lit(False).alias("asks"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("key").combine_chunks()
        asks, key = t["asks"].to_numpy(), t["key"].to_numpy()
        size, item = lists(t["f"])
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        shared = Sets(size, item).shared(a, b).astype(np.float64)
        union = size[a][:, None] + size[b][None, :] - shared
        distance = 1.0 - np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        if sharing:
            distance[shared == 0] = np.inf
        row, column = least(distance, k)  # columns are in key order
        return pa.table({"a": key[a][row], "b": key[b][column], "distance": distance[row, column]})

    found = spread(left.unionByName(right), na * nb).applyInArrow(meet, "a long, b long, distance double")
    w = Window.partitionBy("a").orderBy("distance", "b")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def signatures(sets: DataFrame) -> DataFrame:
    """f and first: every different set with the least order number that has it."""
    return sets.groupBy("f").agg(F.min("ord").alias("first"))


def neighbour_sets(g: Graph, features_only: bool = False) -> DataFrame:
    """id, ord and f (hashes of its neighbours, sorted) of every record; written once, as several plans start from it."""
    records = g.nodes.filter("is_record").select("id", "ord")
    ends = g.ends().join(records.select(F.col("id").alias("src")), "src", "left_semi")
    if features_only:
        ends = ends.join(records.select(F.col("id").alias("dst")), "dst", "left_anti")
    sets = ends.groupBy("src").agg(F.sort_array(F.collect_set(F.xxhash64("dst"))).alias("f"))
    return cut(records.join(sets, records.id == sets.src, "left").select("id", "ord", F.coalesce("f", F.array().cast("array<bigint>")).alias("f")))


def members(sets: DataFrame, sig: DataFrame, k: int) -> DataFrame:
    """b, peer, peer_ord: the first k records of every signature."""
    head = sets.withColumn("r", F.row_number().over(Window.partitionBy("f").orderBy("ord"))).filter(F.col("r") <= k)
    return head.join(sig, "f").select(F.col("first").alias("b"), F.col("id").alias("peer"), F.col("ord").alias("peer_ord"))


def knn(g: Graph, k: int = 5, features_only: bool = False) -> DataFrame:
    """id, peer, rank, distance: the k records nearest by Jaccard distance of neighbour sets, ties by order.

    Exact, without comparing records pair by pair.  Records with equal neighbour sets
    are one signature; the k + 1 nearest signatures of each, with their k + 1 first
    members, hold everyone's k nearest, those that share nothing (distance 1) included.
    """
    sets = neighbour_sets(g, features_only)
    sig = cut(signatures(sets))
    near = nearest(sig.select(F.col("first").alias("a"), "f"), sig.select(F.col("first").alias("b"), "f"), k + 1)
    close = near.join(members(sets, sig, k + 1), "b")
    w = Window.partitionBy("a").orderBy("distance", "peer_ord")
    top = close.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("a", "peer", "peer_ord", "distance")
    mine = sets.join(sig, "f").select("id", F.col("first").alias("a")).join(top, "a").filter("id <> peer")
    w = Window.partitionBy("id").orderBy("distance", "peer_ord")
    return cut(mine.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("id", "peer", "rank", "distance"))


def knn_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.avg("distance").alias("avg_distance"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))


def similar_pairs(vecs: DataFrame, threshold: float = 0.7, block: int = 2048) -> DataFrame:
    """Pairs (a, b, weight) of different vectors whose cosine is at least `threshold`.

    Every pair of blocks is one task's matrix product, so only pairs over the threshold are ever made.
    """
    n = vecs.count()
    blocks = max(1, -(-n // block))
    at = vecs.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = at.select("id", "v", "b", other.alias("o")).select("id", "v", "b", F.least("b", F.col("o")).alias("lo"), F.greatest("b", F.col("o")).alias("hi"))

    def product(t: pa.Table) -> pa.Table:
        ids, x, b = t["id"].to_numpy(), lists(t["v"])[1].astype(float).reshape(t.num_rows, -1), t["b"].to_numpy()
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        lo, hi = b == t["lo"][0].as_py(), b == t["hi"][0].as_py()
        rows, cols = np.flatnonzero(lo), x[hi]
        met = [(k + i, j, s[i, j]) for k in range(0, len(rows), 512) for s in (x[rows[k : k + 512]] @ cols.T,) for i, j in (np.nonzero(s >= threshold),)]
        i, j, w = (np.concatenate(p) for p in zip(*met, strict=True)) if met else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        a, c = ids[lo][i], ids[hi][j]
        keep = (a < c) if t["lo"][0].as_py() == t["hi"][0].as_py() else a != c
        return pa.table({"a": np.minimum(a, c)[keep], "b": np.maximum(a, c)[keep], "weight": w[keep]})

    return sent.repartition(min(4096, blocks * (blocks + 1) // 2), "lo", "hi").groupBy("lo", "hi").applyInArrow(product, "a long, b long, weight double")


def _factor(type_weights: Mapping[str, float] | None) -> Column:
    factor = F.lit(1.0)
    for name, w in (type_weights or {}).items():
        factor = F.when(F.col("etype") == name, float(w)).otherwise(factor)
    return factor


def find_similar(g: Graph, sources: DataFrame, top_k: int = 5, hops: int = 2, type_weights: Mapping[str, float] | None = None, exclude: tuple[str, ...] = (), use_idf: bool = True) -> DataFrame:
    """source, target, score, rank for all ids in `sources` (id) at once: weighted paths of up to `hops` edges, later hops counting less.

    Two hops are not walked: the score is a product of what source and target are linked to, so records
    with equal links are one signature, as in `knn`.  Direct edges between records are added pair by pair.
    Other numbers of hops, and weights under 0, which could push a target back, are walked.
    """
    factor = _factor(type_weights)
    if hops != 2 or g.edges.filter(F.col("weight") * factor < 0).limit(1).count():
        return _walked(g, sources, top_k, hops, type_weights, exclude, use_idf)
    records = g.nodes.filter("is_record").select("id", "ord", F.xxhash64("id").alias("s"))
    counted = ~F.col("etype").isin(*exclude) if exclude else F.lit(True)
    e = g.edges.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("n"), F.when(counted, F.col("weight") * factor).alias("v"))
    both = e.unionByName(e.select(F.col("n").alias("s"), F.col("s").alias("n"), "v"))
    item = cut(both.join(records.select("s"), "s", "left_semi").groupBy("s", "n").agg(F.sum("v").alias("v")))  # v is NULL where no edge counts
    sets = item.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("n", "v", (F.col("n") == F.col("s")).alias("own")))).alias("f"))
    sets = cut(records.join(sets, "s").select("id", "ord", "f"))
    sig = cut(signatures(sets))
    degree = both.select("s", "n").distinct().groupBy(F.col("s").alias("n")).agg(F.count("*").alias("d"))
    idf = numeric.idf(F.col("d")) if use_idf else F.lit(1.0)
    items = cut(sig.select("first", F.explode("f").alias("e")).select("first", "e.*").join(degree, "n").withColumn("u", 0.5 * idf))
    listed = lambda rows, x: rows.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("n", F.col(x).alias("x")))).alias("l")).select("first", F.col("l.n").alias("n"), F.col("l.x").alias("x"))
    mine = cut(sets.join(sources.select("id"), "id", "left_semi").join(sig, "f").select("id", "ord", F.col("first").alias("a")))
    asked = listed(items.filter("not own").join(mine.select(F.col("a").alias("first")).distinct(), "first", "left_semi"), "u").withColumnRenamed("first", "a")
    near = strongest(asked, listed(items.filter("v is not null"), "v").withColumnRenamed("first", "b"), top_k + 1)
    close = near.join(members(sets, sig, top_k + 1), "b")
    w = Window.partitionBy("a").orderBy(F.desc(F.round("score", 9)), "peer_ord")
    top = close.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_k + 1).select("a", F.col("peer").alias("target"), F.col("peer_ord").alias("ord"), "score")
    found = mine.select(F.col("id").alias("source"), "a").join(top, "a").filter("source <> target").select("source", "target", "ord", "score")
    name = lambda side: records.select(F.col("s").alias(f"{side}_key"), F.col("id").alias(side), F.col("ord").alias(f"{side}_ord"))
    direct = cut(item.filter("s <> n and v is not null").select(F.col("s").alias("source_key"), F.col("n").alias("target_key"), F.col("v").alias("w")).join(name("source"), "source_key").join(name("target"), "target_key").join(sources.select(F.col("id").alias("source")), "source", "left_semi"))
    if not direct.isEmpty():
        path = direct.join(item.select(F.col("s").alias("source_key"), "n").filter("source_key <> n"), "source_key").join(item.filter("v is not null").select(F.col("s").alias("target_key"), "n", "v"), ["target_key", "n"])
        second = path.join(degree, "n").groupBy("source", "target").agg(F.sum(0.5 * idf * F.col("v")).alias("more"))
        full = direct.join(second, ["source", "target"], "left").select("source", "target", F.col("target_ord").alias("ord"), (F.col("w") + F.coalesce("more", F.lit(0.0))).alias("score"))
        found = found.join(direct.select("source", "target"), ["source", "target"], "left_anti").unionByName(full)
    w = Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "ord")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select("source", "target", "score", "rank")


def _walked(g: Graph, sources: DataFrame, top_k: int, hops: int, type_weights: Mapping[str, float] | None, exclude: tuple[str, ...], use_idf: bool) -> DataFrame:
    """`find_similar`, hop by hop."""
    t = g.typed()
    degree = g.adjacency().groupBy(F.col("src").alias("at")).agg(F.count("*").alias("d"))
    factor = _factor(type_weights)
    frontier = sources.select(F.col("id").alias("source"), F.col("id").alias("at"))
    seen, scores = frontier, None
    records = g.nodes.filter("is_record").select(F.col("id").alias("target"), "ord")
    for h in range(hops):
        step = frontier.join(t.withColumnRenamed("src", "at"), "at")
        if use_idf and h:
            step = step.join(degree, "at").withColumn("idf", numeric.idf(F.col("d")))
        else:
            step = step.withColumn("idf", F.lit(1.0))
        counted = step.filter(~F.col("etype").isin(*exclude)) if exclude else step
        part = counted.filter("dst <> source").select("source", F.col("dst").alias("target"), (F.col("weight") / (h + 1) * factor * F.col("idf")).alias("s"))
        part = part.join(records.select("target"), "target", "left_semi").groupBy("source", "target").agg(F.sum("s").alias("s"))
        scores = part if scores is None else scores.unionByName(part)
        if h < hops - 1:
            frontier = step.select("source", F.col("dst").alias("at")).distinct().join(seen, ["source", "at"], "left_anti")
            seen = seen.unionByName(frontier)
    total = scores.groupBy("source", "target").agg(F.sum("s").alias("score")).join(records, "target")
    w = Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "ord")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select("source", "target", "score", "rank")


def match(g: Graph, attributes: Mapping[str, str], top_k: int = 5) -> DataFrame:
    """Records with the most of these attribute values: target, score, rank."""
    ids = [f"{c}:{v.strip()}".lower() for c, cell in attributes.items() for v in str(cell).split(",") if v.strip()]
    hit = g.adjacency().filter(F.col("dst").isin(ids)).groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("score"))
    out = hit.join(g.nodes.filter("is_record").select("id", "ord"), "id")
    return out.orderBy(F.desc("score"), "ord").limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord"))).select(F.col("id").alias("target"), "score", "rank")


def neighborhood(g: Graph, start: str, hops: int = 1) -> DataFrame:
    """id and hop of every node within `hops` edges."""
    adj = g.adjacency()
    seen = g.nodes.filter(F.col("id") == start).select("id", F.lit(0).alias("hop"))
    last = seen
    for h in range(1, hops + 1):
        last = adj.join(last.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(last)
    return seen


def rates(found: DataFrame, owned: DataFrame, values: list[str] | None = None) -> DataFrame:
    """id, value, rate, votes: the share of each record's peers that have a value, for every value (or those named), zeros included.

    `found` are neighbours (id, peer), `owned` distinct pairs (id, value).
    """
    if values is not None:
        owned = owned.filter(F.col("value").isin(values))
    votes = found.join(owned.select(F.col("id").alias("peer"), "value"), "peer").groupBy("id", "value").agg(F.count("*").alias("votes"))
    peers = found.groupBy("id").agg(F.count("*").alias("peers"))
    catalogue = sorted(values if values is not None else (r["value"] for r in owned.select("value").distinct().collect()))  # the distinct target values, which name columns
    grid = peers.withColumn("value", F.explode(F.array(*map(F.lit, catalogue)))) if catalogue else peers.withColumn("value", F.lit("")).limit(0)
    n = F.coalesce("votes", F.lit(0))
    return grid.join(votes, ["id", "value"], "left").select("id", "value", (n / F.col("peers")).alias("rate"), n.alias("votes"))


def recommend(found: DataFrame, owned: DataFrame, min_rate: float = 0.5, dominant: float | None = None, top_k: int | None = None) -> DataFrame:
    """id, value, rate, rank, reason: what peers have and the record does not, most frequent first."""
    votes = found.join(owned.select(F.col("id").alias("peer"), "value"), "peer").groupBy("id", "value").agg(F.count("*").alias("votes"))
    peers = found.groupBy("id").agg(F.count("*").alias("peers"))
    r = votes.join(peers, "id").withColumn("rate", F.col("votes") / F.col("peers")).filter(F.col("rate") >= min_rate).join(owned, ["id", "value"], "left_anti")
    if dominant is not None:
        share = owned.groupBy("value").agg(F.count("*").alias("n"))
        n = found.select("id").distinct().count()
        r = r.join(share.filter(F.col("n") > dominant * n), "value", "left_anti")
    w = Window.partitionBy("id").orderBy(F.desc(F.round("rate", 4)), "value")
    r = r.withColumn("rank", F.row_number().over(w)).withColumn("reason", F.format_string("%d of %d peers have %s", "votes", "peers", "value"))
    r = r.filter(F.col("rank") <= top_k) if top_k else r
    return r.select("id", "value", "rate", "rank", "reason")


def co_occurrence(owned: DataFrame, min_support: int = 5, outcome: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (a, b) of values that records have together: support, p_ba (of b given a) and lift; with outcomes (id, won) also how many won and at what rate."""
    n = owned.select("id").distinct().count()
    count = owned.groupBy("value").agg(F.count("*").alias("n"))
    x, y = owned.select("id", F.col("value").alias("a")), owned.select("id", F.col("value").alias("b"))
    pairs = x.join(y, "id").filter("a <> b")
    aggs = [F.count("*").alias("support")]
    if outcome is not None:
        pairs = pairs.join(outcome, "id", "left")
        aggs += [F.count(F.when(F.col("won"), 1)).alias("co_won"), F.avg(F.coalesce(F.col("won"), F.lit(False)).cast("double")).alias("co_rate_won")]
    p = pairs.groupBy("a", "b").agg(*aggs).filter(F.col("support") >= min_support)
    p = p.join(count.select(F.col("value").alias("a"), F.col("n").alias("na")), "a").join(count.select(F.col("value").alias("b"), F.col("n").alias("nb")), "b")
    p = p.withColumn("p_ba", F.col("support") / F.col("na")).withColumn("lift", F.col("support") * F.lit(float(n)) / (F.col("na") * F.col("nb")))
    return p.select("a", "b", "support", "p_ba", "lift", *(["co_won", "co_rate_won"] if outcome is not None else []))


def ml_matrix(g: Graph, found: DataFrame, owned: DataFrame, etypes: list[str], values: list[str]) -> DataFrame:
    """One row a record: degrees, degrees by type (NULL where none), peer rates of each value, mean and least distance."""
    base = structure.degrees(g).select("id", "degree", "unique_neighbors")
    return base.join(structure.degree_by_type(g, etypes), "id", "left").join(peer_rates(found, owned, values), "id", "left")


def peer_rates(found: DataFrame, owned: DataFrame, values: list[str]) -> DataFrame:
    """id, avg_distance, min_distance and rate_<value> for each value: one aggregation over peers, whose values are marked first."""
    has = owned.filter(F.col("value").isin(values)).groupBy(F.col("id").alias("peer")).agg(*(F.max((F.col("value") == v).cast("int")).alias(f"has_{i}") for i, v in enumerate(values))) if values else None
    each = found.join(has, "peer", "left") if values else found
    return each.groupBy("id").agg(F.avg("distance").alias("avg_distance"), F.min("distance").alias("min_distance"), *(F.avg(F.coalesce(F.col(f"has_{i}"), F.lit(0)).cast("double")).alias(f"rate_{v}") for i, v in enumerate(values)))


def ml_labels(records: DataFrame, owned: DataFrame, values: list[str]) -> DataFrame:
    """0/1 for each value."""
    y = owned.groupBy("id").pivot("value", values).agg(F.lit(1))
    out = records.select("id").join(y, "id", "left")
    return out.select("id", *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"y_{v}") for v in values))


def explain(g: Graph, found: DataFrame, owned: DataFrame, k: int = 5, min_rate: float = 0.2) -> DataFrame:
    """For each record: its peers with shared labels and similarity, and its recommendations."""
    adj = g.adjacency()
    both = found.join(adj.select(F.col("src").alias("id"), F.col("dst").alias("n")), "id").join(adj.select(F.col("src").alias("peer"), F.col("dst").alias("n")), ["peer", "n"])
    label = g.nodes.select(F.col("id").alias("n"), tx.node_label(F.col("type"), F.col("label")).alias("label"))
    named = both.join(label, "n").withColumn("r", F.row_number().over(Window.partitionBy("id", "peer").orderBy("label"))).filter("r <= 10")
    shared = named.groupBy("id", "peer").agg(F.sort_array(F.collect_list("label")).alias("shared"))
    peers = found.filter(F.col("rank") <= k).join(shared, ["id", "peer"], "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "peer", F.round(1 - F.col("distance"), 3).alias("similarity"), "shared"))).alias("peers"))
    rec = recommend(found, owned, min_rate, top_k=5).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "value", F.round("rate", 4).alias("rate"), "reason"))).alias("recommended"))
    return peers.join(rec, "id", "left")


def embedding_neighbours(queries: DataFrame, vecs: DataFrame, k: int = 5, exclude_self: bool = True) -> DataFrame:
    """For each row of `queries`, the k nearest of `vecs` by cosine, itself excluded: query_id, vec_id, distance, rank.

    Queries are a stated, bounded set; each meets all rows in blocks and keeps k from a block.
    """
    import numpy as np
    import pyarrow as pa

    asked = queries.select(F.col("vec_id").cast("long").alias("q"), F.col("embedding").cast("array<double>").alias("qv"))
    n = vecs.count()
    blocks = max(1, -(-n // 20000))
    qblocks = max(1, -(-asked.count() // 2000))
    rows = vecs.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"))
    left = asked.select(F.col("q").alias("id"), F.col("qv").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("q"), F.lit(qblocks)).alias("qb"), F.lit(True).alias("is_query"))
    right = rows.select("id", "v", F.col("b").cast("int"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qblocks - 1).cast("long"))).alias("qb"), F.lit(False).alias("is_query"))

    def near(t: pa.Table) -> pa.Table:
        ids, x, isq = t["id"].to_numpy(), np.array(t["v"].to_pylist(), float).reshape(t.num_rows, -1), t["is_query"].to_numpy(zero_copy_only=False)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        out: list[list] = [[], [], []]
        rid, r = ids[~isq], x[~isq]
        for qid, qv in zip(ids[isq].tolist(), x[isq], strict=True):
            d = 1 - r @ qv
            keep = (rid != qid) | (not exclude_self)
            o = np.lexsort((rid[keep], np.round(d[keep], 12)))[:k]
            out[0] += [qid] * len(o)
            out[1] += rid[keep][o].tolist()
            out[2] += d[keep][o].tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "distance"])

    found = left.unionByName(right).groupBy("b", "qb").applyInArrow(near, "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def context(g: Graph, rank: DataFrame, n: int = 10, connections: int = 10) -> DataFrame:
    """What a question about the graph is answered from: the first n records by rank with some of their connections."""
    top = rank.join(g.nodes.filter("is_record").select("id", "label", "ord"), "id").orderBy(F.desc(F.round("pagerank", 12)), "ord").limit(n)
    linked = top.join(g.adjacency().withColumnRenamed("src", "id"), "id").join(g.nodes.select(F.col("id").alias("dst"), tx.node_label(F.col("type"), F.col("label")).alias("name")), "dst")
    w = Window.partitionBy("id").orderBy("name")
    few = linked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= connections)
    return few.groupBy("id", tx.shorten(F.col("label"), 200).alias("label")).agg(F.sort_array(F.collect_list("name")).alias("connections"))


def ask(g: Graph, question: str, complete, rank: DataFrame | None = None, n: int = 10) -> dict:
    """An answer from the graph's context (n records at most), with the records it was given."""
    rows = context(g, structure.pagerank(g) if rank is None else rank, n).collect()
    lines = [f"{r['label']}: {', '.join(r['connections'])}" for r in rows]
    return {"text": complete(question + "\n\n" + "\n".join(lines)), "entities": [r["label"] for r in rows]}


def neighborhood_edges(g: Graph, start: str, hops: int = 1) -> DataFrame:
    """Edges with an end less than `hops` from a node: src, dst, etype, each once."""
    inner = neighborhood(g, start, hops - 1).select("id")
    e = g.edges.select("src", "dst", "etype")
    return e.join(inner.select(F.col("id").alias("src")), "src", "left_semi").unionByName(e.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "etype")).distinct()


def cosine_to(df: DataFrame, column: str, query: Column) -> DataFrame:
    return df.withColumn("score", vectors.cosine(F.col(column), query))
