import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import history, models, pages, retrieval, structured
from graphloom.sources import files


@given(st.text(max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_chunks_cover_the_text(text, size, overlap):
    parts = retrieval.split_text(text, size, overlap)
    assert all(0 < len(p) <= size + 2 for p in parts)
    assert all(c.isspace() or any(c in p for p in parts) for c in text)


def test_chunks_need_room():
    with pytest.raises(ValueError):
        retrieval.split_text("x" * 50, 10, 10)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.txt", "alpha"), ("sub/b.md", "béta"), ("c.png", "no"), ("d.txt", "  ")):
        (tmp_path / name).write_text(body)
    got = {r["filename"]: r["text"] for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "alpha", "b.md": "béta"}
    assert files.read_glob(spark, str(tmp_path / "*.txt")).count() == 1


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "red fox")], "query_id long, text string")
    r = retrieval.bm25(q, docs)
    assert [x["doc_id"] for x in r.orderBy("rank").collect()] == [1, 2]
    assert retrieval.fuse(r, r).count() == 2


def test_hash_embedder_is_unit(spark):
    v = spark.createDataFrame([("a b a",), ("",)], "t string").select(retrieval.hash_embedder(F.col("t"), 8).alias("v")).collect()
    assert abs(sum(x * x for x in v[0]["v"]) - 1) < 1e-9 and sum(v[1]["v"]) == 0


def test_pages():
    html = "<html><head><title>T</title><style>x</style></head><body><h1>Hi</h1><div class='c'><p id=p>One <b>two</b></p><a href='/x'>go</a></div><script>bad()</script></body></html>"
    text = pages.to_text(html)
    assert "# Hi" in text and "One two" in text and "bad" not in text
    assert pages.select(html, [".c p", "#p", "a", "h2"]) == [(".c p", 0, "One two"), ("#p", 0, "One two"), ("a", 0, "go")]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], "source string, target string")
    assert [tuple(r) for r in pages.crawl(links, "a", 10, 2).collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_history(spark):
    m = spark.createDataFrame([("s", 0, "{}", "2024-01-01"), ("s", 1, "{}", "2024-01-02"), ("t", 0, "{}", "2024-01-03")], "session_id string, message_index int, message_data string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r["session_id"] for r in history.list_sessions(m).collect()] == ["t", "s"]
    assert history.delete_session(m, "s").count() == 1
    assert history.save_messages(m, m.filter("session_id = 's' and message_index = 1")).count() == 2


def test_structured():
    assert structured.extract_json('a ```json\n{"x": 1}\n```') == '{"x": 1}'
    assert structured.extract_json('well {"x": {"y": 2}} ok') == '{"x": {"y": 2}}'
    schema = {"title": "T", "properties": {"title": {"type": "string", "description": "d", "default": 1}}, "$defs": {"E": {"title": "E", "properties": {"a": {}}}}}
    assert structured.simplify_schema(schema) == {"properties": {"title": {"type": "string"}}, "$defs": {"E": {"properties": {"a": {}}}}}
    assert structured.schema_stats(schema)["fields"] == 2
    replies = iter(["no", '{"a": 2}'])
    assert structured.complete("p", {}, lambda _: next(replies)) == {"a": 2}
    with pytest.raises(ValueError, match="no valid reply"):
        structured.complete("p", {}, lambda _: "no", retries=2)


def test_models(spark):
    t = models.table(spark)
    assert models.list_models(t, capability="vision").count() == 1
    assert models.recommend_model(t, "classification") == "small-chat"


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
