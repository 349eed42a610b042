import itertools
import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import build, export, profile, reference, similar, structure, temporal
from graphloom.streaming import streams

ROWS = [
    ("A", 1, "saas", "aws, k8s, react", "cdn", 100.0, "2024-01-05"),
    ("B", 2, "saas", "aws,k8s", "cdn, waf", 250.0, "2024-02-05"),
    ("C", 3, "retail", "php", "zt", 0.0, "2024-03-05"),
    ("D", 4, "retail", "php, aws", "waf", 5e6, "2024-04-05"),
    ("A", 5, "SaaS", "go", None, 100.0, "2024-05-05"),
    (None, 6, "x", "y", "z", 1.0, "2024-05-05"),
]
CONFIG = build.Config("id", "ord", categorical=["industry"], lists={"tech": "USES"}, numeric=["size"], time_column="day")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, ord long, industry string, tech string, products string, size double, day string")


@pytest.fixture(scope="module")
def graph(rows):
    g = build.build(rows, CONFIG)
    return build.Graph(g.nodes.cache(), g.edges.cache(), CONFIG)


def brute(graph, k):
    recs = [(r["id"], r["ord"]) for r in graph.nodes.filter("is_record").orderBy("ord").collect()]
    sets = {i: set() for i, _ in recs}
    for r in graph.adjacency().collect():
        if r["src"] in sets:
            sets[r["src"]].add(r["dst"])
    out = {}
    for a, _ in recs:
        d = sorted((1 - (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 0), o, b) for b, o in recs if b != a)
        out[a] = [(b, round(x, 9)) for x, _, b in d[:k]]
    return out


def test_build(graph):
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    assert {i for i, r in nodes.items() if r["is_record"]} == {"entity:a", "entity:b", "entity:c", "entity:d"}
    assert nodes["industry:saas"]["label"] == "saas"
    edges = {(r["src"], r["dst"], r["etype"]) for r in graph.edges.collect()}
    assert ("entity:a", "tech:go", "USES") in edges and ("entity:c", "size_range:zero", "IN_SIZE_RANGE") in edges
    assert len(edges) == graph.edges.count()


def test_as_of_and_leakage(rows, graph):
    from dataclasses import replace

    c = replace(CONFIG, as_of="2024-02-28")
    early = build.build(rows, c)
    later = build.build(rows.unionByName(rows.withColumn("day", F.lit("2025-01-01"))), c)
    assert early.nodes.filter("is_record").count() == 2
    assert sorted(map(tuple, early.edges.collect()), key=str) == sorted(map(tuple, later.edges.collect()), key=str)


def test_incremental_equals_whole(rows, graph):
    part = build.add_records(build.build(rows.filter("ord < 3"), CONFIG), rows.filter("ord >= 3"))
    key = lambda g: sorted((r["src"], r["dst"], r["etype"], r["weight"]) for r in g.edges.collect())
    assert key(part) == key(graph)


def test_frozen_refuses(graph):
    g = build.Graph(graph.nodes, graph.edges, CONFIG, True)
    with pytest.raises(RuntimeError, match="frozen"):
        build.add_relationship(g, "a", "X", "b")


@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_knn_is_brute_force(graph, k):
    got = {}
    for r in similar.knn(graph, k).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["peer"], round(r["distance"], 9)))
    assert got == brute(graph, k)


def test_pagerank_sums_to_one(graph):
    assert abs(structure.pagerank(graph, steps=5).agg(F.sum("pagerank")).first()[0] - 1) < 1e-9


def test_communities(graph):
    rows = structure.communities(graph, rounds=4).collect()
    assert len(rows) == 4 and all(r["community_id"] >= 0 for r in rows)
    sizes = {r["community_id"]: r["community_size"] for r in rows}
    assert sum(sizes.values()) == 4


def test_rates_and_recommend(rows, graph, spark):
    from graphloom.functions import text as tx

    owned = rows.filter("id is not null and products is not null").select(tx.node_id("entity", F.col("id")).alias("id"), F.explode(tx.items(F.col("products"))).alias("value")).distinct()
    found = similar.knn(graph, 2)
    rates = {(r["id"], r["value"]): r["rate"] for r in similar.rates(found, owned).collect()}
    assert len(rates) == 4 * 3 and rates["entity:a", "waf"] == 1.0
    rec = {(r["id"], r["value"]) for r in similar.recommend(found, owned).collect()}
    assert ("entity:a", "waf") in rec and ("entity:a", "cdn") not in rec
    co = {(r["a"], r["b"]): r["p_ba"] for r in similar.co_occurrence(owned, 1).collect()}
    assert co["cdn", "waf"] == 0.5


def test_reference_computations(graph, spark):
    ref = spark.createDataFrame([("entity:a",)], "id string")
    shared = {r["id"]: r["value"] for r in reference.shared_count(graph, ref).collect()}
    assert shared["entity:a"] == 0 and shared["entity:b"] == 4
    dist = {r["id"]: r["value"] for r in reference.compute("distance_to_nearest", graph, ref=ref).collect()}
    assert dist["entity:a"] == 0 and dist["entity:b"] == 2
    with pytest.raises(ValueError, match="unknown computation"):
        reference.compute("nope", graph)


def test_score_has_training_columns(rows, graph, tmp_path, spark):
    owned = spark.createDataFrame([("entity:a", "cdn"), ("entity:b", "waf")], "id string, value string")
    f = temporal.freeze(graph, str(tmp_path / "g"), owned, 2)
    train = similar.ml_matrix(graph, similar.knn(graph, 2), owned, f.etypes, f.values)
    scored = temporal.score_batch(f, rows.filter("id = 'D'"), owned)
    assert set(train.columns) - {"unique_neighbors"} == set(scored.columns)
    assert scored.count() == 1 and f.graph.frozen and not f.unfreeze().frozen


def test_profile(rows):
    d = profile.profile(rows.filter("id is not null").drop("ord"), "id")
    assert d.roles["size"] == "numeric" and d.roles["tech"] == "list" and d.roles["day"] == "date" and d.roles["id"] == "id"
    assert d.set_type("tech", "skip").by_role("skip") == ["tech"]


def test_exports(graph):
    c = export.to_cytoscape(graph, max_nodes=20)
    ids = {x["data"]["id"] for x in c["elements"]["nodes"]}
    assert all(x["data"]["source"] in ids and x["data"]["target"] in ids for x in c["elements"]["edges"])
    assert export.to_mermaid(graph).startswith("flowchart LR") and "<graphml" in export.to_graphml(graph)
    assert json.dumps(export.to_d3(graph)) and "<!doctype html>" in export.to_html(graph)
    assert export.colour("x") == export.colour("x")


def test_stream_equals_batch(rows, graph, tmp_path, spark):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    streams.upsert_edges(stream, CONFIG, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda e: sorted((r["src"], r["dst"], r["etype"]) for r in e.collect())
    assert key(streams.current_edges(spark, out)) == key(graph.edges)


def test_log_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    df = spark.createDataFrame([(f"2024-01-0{d} 0{h}:00:00", k, 1.0) for d, h, k in itertools.product((1, 2, 3), (1, 2), "ab")], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(src)
    q = streams.log_windows(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*), sum(requests) from w").first()[:] == (6, 12)
