from pyspark.sql import functions as F

from graphloom.functions import dates, numeric, vectors
from graphloom.functions import text as tx


def one(spark, value, expr, ddl="string"):
    return spark.createDataFrame([(value,)], f"v {ddl}").select(expr(F.col("v")).alias("x")).first()["x"]


def test_node_id_trims_and_lowers(spark):
    assert one(spark, " Ab\t", lambda c: tx.node_id("entity", c)) == "entity: ab"


def test_null_words(spark):
    for v in (None, "", " N/A ", "None", "-", "unknown"):
        assert one(spark, v, tx.is_null_word) is True
    assert one(spark, "x", tx.is_null_word) is False


def test_items(spark):
    assert one(spark, "a, b,,n/a , c", tx.items) == ["a", "b", "c"]
    assert one(spark, None, tx.items) == []
    assert one(spark, None, tx.cell_items) == ["none"]


def test_numbers(spark):
    for v, want in (("$180M", 180e6), ("1,234", 1234.0), ("12%", 12.0), ("5d", None), ("abc", None), (None, None), (" 7 ", 7.0), ("2.5K", 2500.0)):
        assert one(spark, v, numeric.parse) == want


def test_buckets(spark):
    for v, want in ((-5.0, "zero"), (0.0, "zero"), (999.0, "tiny"), (1e3, "small"), (1e5, "medium"), (1e6, "large"), (1e8, "very_large"), (1e9, "massive"), (float("nan"), None), (None, None)):
        assert one(spark, v, numeric.bucket, "double") == want


def test_dates(spark):
    for v in ("2024-02-03", "2/3/2024", "02-03-2024", "2024/2/3", "Feb 3, 2024", "February 3, 2024", "2024-02-03 00:00:00"):
        assert str(one(spark, v, lambda c: dates.parse(c).cast("string"))).startswith("2024-02-03"), v
    assert one(spark, "soon", dates.parse) is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.707107, 0.0, 0.0]


def test_json_part(spark):
    assert one(spark, 'x ```json\n{"a": 1}\n``` y', tx.json_part) == '{"a": 1}'
    assert one(spark, 'so {"a": 1} it is', tx.json_part) == '{"a": 1}'
    assert one(spark, "none {here", tx.json_part) == "none {here"
