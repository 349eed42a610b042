"""Features that very many records share: what is worked out over signatures against the same worked out pair by pair, and tables whose pairs are too many to make."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import blocks, build, similar, structure

CONFIG = build.Config("name", "k", categorical=["a", "b"], relationships={"knows": "KNOWS"})


@pytest.fixture(scope="module")
def small(spark):
    """37 records of few kinds, some with direct edges, one of them to itself."""
    rows = [(f"r{i:02}", i, f"x{i % 3}", f"y{i * i % 5}", f"r{i // 4:02}" if i % 3 == 0 else None) for i in range(37)]
    return build.build(spark.createDataFrame(rows, "name string, k long, a string, b string, knows string"), CONFIG).kept()


@pytest.fixture(scope="module")
def hubs(spark):
    """20,000 records of four kinds: 200 million pairs."""
    rows = spark.range(20000).select(F.format_string("r%05d", "id").alias("name"), F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("a"), (F.floor(F.col("id") / 2) % 2).cast("string").alias("b"), F.lit(None).cast("string").alias("knows"))
    return build.build(rows, CONFIG).kept()


def test_find_similar_against_walks(small):
    sources = small.nodes.filter("is_record").select("id")
    for options in ({}, {"type_weights": {"HAS_B": 3.0}}, {"exclude": ("HAS_A",)}, {"use_idf": False}, {"type_weights": {"KNOWS": -1.0}}):
        got = {(r["source"], r["rank"]): (r["target"], round(r["score"], 9)) for r in similar.find_similar(small, sources, 4, **options).collect()}
        args = {"top_k": 4, "hops": 2, "type_weights": None, "exclude": (), "use_idf": True} | options
        want = {(r["source"], r["rank"]): (r["target"], round(r["score"], 9)) for r in similar._walked(small, sources, **args).collect()}
        assert got == want and len({s for s, _ in got}) == 37


def test_find_similar_of_every_record(hubs):
    found = similar.find_similar(hubs, hubs.nodes.filter("is_record").select("id"))
    got = {(r["source"], r["rank"]): (r["target"], r["score"]) for r in found.filter("source in ('entity:r00000', 'entity:r19999')").collect()}
    assert found.count() == 5 * 20000
    same = 1.0 / math.log(10001)  # half of each of two features
    for rank in range(1, 6):
        assert got["entity:r00000", rank] == (f"entity:r{4 * rank:05}", pytest.approx(same)) and got["entity:r19999", rank] == (f"entity:r{4 * rank - 1:05}", pytest.approx(same))


def test_find_similar_query_has_every_record(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    assert entry.queries()["find_similar"](spark, d).select("source").distinct().count() == n
    assert "ord % 50" not in entry.oracle_sql()["find_similar"]


@pytest.mark.parametrize("method", ["adamic_adar", "shared_count", "jaccard"])
def test_projection_totals_against_pairs(small, method, monkeypatch):
    monkeypatch.setattr(blocks, "ORDERED", 10)
    monkeypatch.setattr(blocks, "STEP", 3)
    monkeypatch.setattr(blocks, "KNOWN", 4)
    want = {r["a"]: (r["n"], round(r["w"], 9)) for r in structure.projection(small, method).groupBy("a").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert {r["a"]: (r["pairs"], round(r["weight"], 9)) for r in structure.projection_totals(small, method).collect()} == want


def test_projection_totals_of_hubs(hubs):
    got = {r["a"]: (r["pairs"], r["weight"]) for r in structure.projection_totals(hubs, "shared_count").collect()}
    assert len(got) == 19999 and got["entity:r00000"] == (14999, 19998.0) and got["entity:r19998"] == (1, 1.0)


def test_communities_in_blocks(small, hubs, monkeypatch):
    whole = {tuple(r) for r in structure.communities(small).collect()}
    assert len(whole) == 37
    monkeypatch.setattr(blocks, "ASKED", 5)
    monkeypatch.setattr(blocks, "KNOWN", 4)
    assert {tuple(r) for r in structure.communities(small).collect()} == whole
    found = structure.communities(hubs).groupBy("community_id", "community_size").count().collect()
    assert sum(r["count"] for r in found) == 20000 and all(r["community_size"] == r["count"] for r in found)


def _neighbours(g):
    out = {}
    for r in g.adjacency().filter("src <> dst").collect():
        out.setdefault(r["src"], set()).add(r["dst"])
    return out


def test_clustering_and_rank_against_plain_loops(small):
    near = _neighbours(small)
    got = {r["id"]: r["clustering_coeff"] for r in structure.clustering(small).collect()}
    assert len(got) == 37 and any(got.values())
    for i, c in got.items():
        pairs = list(itertools.combinations(sorted(near.get(i, ())), 2))
        assert c == pytest.approx(sum(b in near[a] for a, b in pairs) / len(pairs) if pairs else 0)
    every = {}
    for r in small.adjacency().collect():
        every.setdefault(r["src"], set()).add(r["dst"])
    rank = dict.fromkeys(every, 1 / len(every))
    for _ in range(20):
        rank = {i: 0.15 / len(every) + 0.85 * sum(rank[j] / len(every[j]) for j in n) for i, n in every.items()}
    assert {r["id"]: round(r["pagerank"], 12) for r in structure.pagerank(small).collect()} == {i: round(x, 12) for i, x in rank.items()}


def test_clustering_of_a_hub(spark):
    """A hub before 30,000 others in order: its 450 million pairs of neighbours are not made."""
    rows = spark.range(30000).select(F.format_string("r%05d", "id").alias("name"), F.col("id").alias("k"), F.lit("x").alias("a"), F.lit(None).cast("string").alias("b"), F.when(F.col("id") > 0, "r00000").alias("knows"))
    got = {r["id"]: r["clustering_coeff"] for r in structure.clustering(build.build(rows, CONFIG)).filter("id in ('entity:r00000', 'entity:r00007')").collect()}
    assert got["entity:r00007"] == 1.0 and got["entity:r00000"] == pytest.approx(29999 / (30000 * 29999 / 2))


def test_walks_follow_edges_by_weight(small, spark):
    names = {r["h"]: r["id"] for r in small.nodes.select("id", F.xxhash64("id").alias("h")).collect()}
    near = {}
    for r in small.adjacency().collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    paths = [[names[x] for x in r["path"]] for r in structure.walked(small, 200, 3, 4.0).collect()]
    assert len(paths) == 200 * len(near) and all(len(p) == 3 and all(b in near[a] for a, b in itertools.pairwise(p)) for p in paths)
    met, drawn = {}, {}
    for first, at, to in paths:
        close = to == first or to in near[first]
        k = len(near[at] & (near[first] | {first}))
        total = k + (len(near[at]) - k) / 4
        met[at] = met.get(at, 0) + close
        drawn[at] = drawn.get(at, 0) + k / total
    assert sum(met.values()) == pytest.approx(sum(drawn.values()), rel=0.05)
    assert [tuple(r) for r in structure.walked(small, 2, 3).orderBy("first", "walk").collect()] == [tuple(r) for r in structure.walked(small, 2, 3).orderBy("first", "walk").collect()]


def test_keyword_search_sends_only_the_best_of_a_batch(spark):
    """3,000 documents that all match: nearly as many rows of each query were scored in a shuffle before, now ten a batch."""
    from graphloom.operators import retrieval

    docs = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word "), F.repeat(F.lit("rare "), (F.col("id") % 7).cast("int")), F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(3000, None), (3001, "")], "doc_id long, text string"))
    q = spark.createDataFrame([(1, "common rare"), (2, "even"), (3, "absent")], "query_id long, text string")
    p = retrieval.Postings(q, docs)
    assert p.rows.count() == 3002 and p.rows.filter(F.size("term") > 3).count() == 0
    got = [tuple(r) for r in p.bm25(4).orderBy("query_id", "rank").collect()]
    assert [(x, d, r) for x, d, _, r in got] == [(1, 6, 1), (1, 13, 2), (1, 20, 3), (1, 27, 4), (2, 0, 1), (2, 14, 2), (2, 28, 3), (2, 42, 4)]
    n, df = 3002, {"common": 3000, "rare": 2571}
    mean = sum(3 + i % 7 for i in range(3000)) / 3001
    s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 9 / mean)) for t, tf in (("common", 1), ("rare", 6)))
    assert got[0][2] == pytest.approx(s)
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in p.overlap(1).orderBy("query_id").collect()] == [(1, 1, 2.0), (2, 0, 1.0)]


def test_similar_pairs_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(60, 4))
    x[7] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {(a, b): pytest.approx(w) for a, b in itertools.combinations(range(60), 2) if (w := float(unit[a] @ unit[b])) >= 0.4}
    for block in (7, 2048):
        assert {(r["a"], r["b"]): r["weight"] for r in similar.similar_pairs(v, 0.4, block).collect()} == want
