"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns a table; each is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import neardup, packing, quality, substring, toxicity
from graphloom.llm.shared import tokenizer_path, written

#: Token identities and similarity are beyond SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; a null or empty text scores the bias, a null id keeps its row, no labels reject nothing; order and further columns stay."""
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose failure bits the current policy's mask leaves empty; null and empty texts fail, null ids and ties are judged by their text alone, further columns stay."""
    return quality.accept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (least id, then file and row) of each class; texts without words and null ids are classes of their own, further columns stay."""
    return neardup.first_of_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words that a document of smaller id has; null texts stay null, equal ids do not cut each other, `n_chars` follows, further columns stay."""
    return substring.dedup_text(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens, one row a piece; a null text has its end token, and only ids are carried on, as a window has many documents."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near duplicates", drop_near_duplicates), ("repeated passages", cut_repeats), ("packing", pack_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
