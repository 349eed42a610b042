import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import build, export, pages, retrieval, similar, structure, temporal
from graphloom.sources import files

ROWS = [("A", 1, "saas", "fast edge cache network for the web", "2024-01-05"), ("B", 2, "saas", "fast edge cache network for the web today", "2024-02-05"), ("C", 3, "retail", "shoes and hats", "2024-03-05"), ("D", 4, "retail", None, "2024-04-05")]
DDL = "id string, ord long, industry string, notes string, day string"
CONFIG = build.Config("id", "ord", categorical=["industry"], text=["notes"], time_column="day")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, DDL)


@pytest.fixture(scope="module")
def graph(rows):
    return build.build(rows, CONFIG).kept()


def test_files_with_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xe9 \xff ok")
    (tmp_path / "b.md").write_bytes(b" \n")
    (tmp_path / "c.png").write_bytes(b"x")
    got = files.read_folder(spark, str(tmp_path)).collect()
    assert [(r["filename"], r["text"]) for r in got] == [("a.txt", "caf  ok")]
    assert files.read_glob(spark, str(tmp_path / "c.*")).count() == 1


def test_url_source(spark):
    p = spark.createDataFrame([(1, "/a", "<p>Hello <b>you</b></p>"), (2, "/b", "<p></p>")], "page_id long, url string, html string")
    assert [r["source"] for r in files.read_urls(p).collect()] == ["/a"]
    assert files.read_urls(p, ["/b"]).count() == 0
    got = pages.extract(p.filter("page_id = 1"), lambda prompt: "Sure: " + json.dumps({"n": len(prompt) > 0}), "n boolean").first()
    assert got["found"]["n"] is True


def test_similarity_edges_of_a_build(rows):
    g = build.build_with_similarity(rows, CONFIG)
    e = g.edges.filter("etype = 'SIMILAR_TO'").collect()
    assert [(r["src"], r["dst"]) for r in e] == [("entity:a", "entity:b")] and 0.7 <= e[0]["weight"] <= 1
    d = {r["id"]: r for r in structure.degrees(g).collect()}
    assert d["entity:a"]["similar_count"] == 1 and d["entity:a"]["max_similarity"] == e[0]["weight"] and d["entity:d"]["similar_count"] == 0


def test_graph_as_a_container(graph):
    assert len(graph) == graph.nodes.count() and "A" in graph and "entity:a" in graph and "nobody" not in graph
    assert list(graph) == ["entity:a", "entity:b", "entity:c", "entity:d"] and "nodes" in repr(graph)


def test_roles_of_the_first_row(spark):
    df = spark.createDataFrame([("x", "a, b", "one", 3, "t" * 101, True)], "id string, tags string, kind string, n int, body string, flag boolean")
    assert build.first_row_roles(df, "id") == {"categorical": ["kind"], "list": ["tags"], "numeric": ["n"], "text": ["body"]}
    assert build.first_row_roles(df.limit(0), "id") == {"categorical": [], "list": [], "numeric": [], "text": []}


def test_build_from_settings(rows):
    g = build.build_from_config(rows, {"id_column": "id", "order_column": "ord", "categorical": ["industry"], "temporal_column": "day", "as_of": "2024-02-28"})
    assert list(g) == ["entity:a", "entity:b"]
    with pytest.raises(TypeError):
        build.build_from_config(rows, {"id_column": "id", "order_column": "ord", "colour": 1})


def test_text_jobs_and_relations(rows, graph):
    def job(text):
        if "hats" in text:
            raise ValueError("model is away")
        return json.dumps([{"target": "Zed", "type": "works with"}])

    replies = build.text_jobs(rows, CONFIG, "notes", job)
    assert {r["src"] for r in replies.collect()} == {"entity:a", "entity:b"}
    g = build.add_relations(graph, replies)
    e = g.edges.filter("etype = 'WORKS_WITH'").collect()
    assert {(r["src"], r["dst"], r["weight"], r["confidence"]) for r in e} == {("entity:a", "entity:zed", 0.8, 0.7), ("entity:b", "entity:zed", 0.8, 0.7)}
    assert not g.nodes.filter("id = 'entity:zed'").first()["is_record"]


def test_compute_features_and_report(graph):
    f = structure.compute_features(graph, ["HAS_INDUSTRY"], community=True)
    got = {r["id"]: r for r in f.collect()}
    assert len(got) == 4 and got["entity:a"]["HAS_INDUSTRY_degree"] == 1 and got["entity:a"]["community_id"] == got["entity:b"]["community_id"] >= 0
    r = structure.feature_report(f, len(graph))
    assert r["entities"] == 4 and "HAS_INDUSTRY_degree" in r["groups"]["degree"] and "pagerank" in r["groups"]["rank"]
    assert "4 entities" in structure.print_report(r)


def test_temporal_dataset_has_no_later_rows(spark):
    c = build.Config("id", "ord", categorical=["kind"], time_column="ts")
    ev = spark.createDataFrame([("A", 1, "x", "2024-01-01", "open"), ("A", 2, "y", "2024-03-01", "won"), ("B", 3, "x", "2024-01-10", "open"), ("C", 4, "x", "2024-06-01", "won")], "id string, ord long, kind string, d string, status string").withColumn("ts", F.to_timestamp("d"))
    got = {(r["id"], r["degree"], r["n_events"], r["label"]) for r in temporal.dataset(ev, ["2024-02-01"], c, "status", "won", 60).collect()}
    assert got == {("entity:a", 1, 1, 1), ("entity:b", 1, 1, 0)}


def test_frozen_scores_with_peers_and_communities(spark, graph, rows, tmp_path):
    f = temporal.freeze(graph, str(tmp_path), None, 2)
    com = structure.communities(graph)
    new = spark.createDataFrame([("N", 9, "saas", None, None)], DDL)
    r = temporal.score_batch(f, new, spark.createDataFrame([], "id string, value string"), communities=com, with_peers=True).first()
    home = {x["id"]: x["community_id"] for x in com.collect()}
    assert r["knn_peers"] == "entity:a,entity:b" or r["knn_peers"] == "entity:b,entity:a"
    assert r["community_id"] == home["entity:a"] and r["HAS_INDUSTRY_degree"] == 1


def test_nearest_sets_against_all_pairs(spark):
    import random

    r = random.Random(5)
    sets = {i: sorted({r.randrange(30) for _ in range(r.randrange(6))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "a long, f array<long>")
    dist = lambda x, y: 1 - len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 1.0
    old, similar.ASKED, similar.KNOWN = (similar.ASKED, similar.KNOWN), 16, 16
    try:
        for sharing in (False, True):
            got = {}
            for x in similar.nearest(df, df.withColumnRenamed("a", "b"), 3, sharing).collect():
                got.setdefault(x["a"], []).append((round(x["distance"], 9), x["b"]))
            for a, f in sets.items():
                want = sorted((round(dist(f, g), 9), b) for b, g in sets.items() if not sharing or set(f) & set(g))[:3]
                assert sorted(got.get(a, [])) == want
    finally:
        similar.ASKED, similar.KNOWN = old


def test_ingest_hybrid_and_text(spark):
    src = spark.createDataFrame([("a.txt", "word " * 400), ("b.txt", "short"), ("c.txt", "")], "source string, text string")
    vectors, counts = retrieval.ingest(src)
    c = counts.first()
    assert c["n_chunks"] == c["n_vectors"] == vectors.count() and c["n_sources"] == 2
    again, _ = retrieval.ingest(src, vectors)
    assert again.count() == vectors.count()
    docs = spark.createDataFrame([(1, "edge cache", "x"), (2, "edge network", "y"), (3, "shoes", "x")], "doc_id long, text string, kind string")
    q = spark.createDataFrame([(1, "edge cache")], "query_id long, text string")
    found = retrieval.hybrid(q, docs, 3)
    assert found.filter("rank = 1").first()["doc_id"] == 1
    assert {r["doc_id"] for r in retrieval.hybrid(q, docs, 3, filters={"kind": "y"}).collect()} == {2}
    assert retrieval.hybrid(q, docs, 3, boost=F.when(F.col("doc_id") == 2, 9.0).otherwise(1.0)).filter("rank = 1").first()["doc_id"] == 2
    assert retrieval.hybrid(q, docs, 3, threshold=1.0).count() == 0
    text = retrieval.search_text(found.join(docs.withColumn("source", F.col("kind")), "doc_id")).first()["text"]
    assert text.startswith("[Score: 0.0") and "edge cache" in text
    said = retrieval.ask_text("why?", docs.select(F.col("kind").alias("source"), "text"), lambda p: "because")
    assert said.startswith("because") and said.count("- x") == 1


def test_ask_and_facade(graph, tmp_path):
    got = similar.ask(graph, "who?", lambda p: f"{len(p.splitlines())} lines", n=2)
    assert len(got["entities"]) == 2 and got["text"] == "4 lines"
    kg = export.KnowledgeGraph(graph)
    assert json.loads(kg.to_d3_json())["nodes"] and kg.to_mermaid().startswith("flowchart") and "graphml" in kg.to_graphml() and kg.to_cytoscape()["metadata"]
    kg.render_html(str(tmp_path / "g.html"))
    assert (tmp_path / "g.html").read_text().startswith("<!doctype html>")


def test_neighbourhood_edges(graph):
    one = similar.neighborhood_edges(graph, "industry:saas", 1).collect()
    assert {(r["src"], r["dst"]) for r in one} == {("entity:a", "industry:saas"), ("entity:b", "industry:saas")}
