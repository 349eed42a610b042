"""One query for each corpus operator, over whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from graphloom.llm import chat, encoding, neardup, neighbours, packing, quality, scoring, substring, toxicity, wavelet
from graphloom.llm.shared import remainder, tokenizer_path

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factorization machine, learned outside the held-out fold, over every whole text."""
    docs = _read(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return rows.select("doc_id", (remainder("doc_id", toxicity.FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes by ProbMinHash: one row per document."""
    return neardup.classes(_read(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 13 words that an earlier document has, by relative Lempel-Ziv factors."""
    return substring.dedup(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded-space online packing of all documents into windows of 4096."""
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(WORDS))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ledger with the current policy's verdict."""
    return quality.judge(quality.ledger(_read(spark, sf_dir, "documents")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE by contiguous rank arrays, there and back."""
    return encoding.encode(_read(spark, sf_dir, "documents"), tokenizer_path(WORDS), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as wavelet matrices and read back."""
    docs = _read(spark, sf_dir, "documents")
    return wavelet.read_shards(wavelet.write_shards(docs, tokenizer_path(BYTES), wavelet.new_folder(docs)))


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and causal self-attention score of every document."""
    return scoring.score(_read(spark, sf_dir, "documents"), tokenizer_path(WORDS))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every speaker's perspective."""
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest by cosine, of every fiftieth row among all rows."""
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_neardup, op3_substring, op4_packing, op5_quality, op6_bpe, op7_wavelet, op8_scoring, op9_chat, op10_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": quality.SQL, "op9_chat": chat.SQL}
