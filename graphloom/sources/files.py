"""Text files, folders and globs as (source, filename, text) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx

EXTENSIONS = tuple("txt md rst csv tsv json jsonl yaml yml xml html htm log ini cfg toml py js ts java go rs c cc cpp h hpp rb php sh sql css tex org adoc".split())


def _decoded(df: DataFrame) -> DataFrame:
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))  # bytes that are no UTF-8 are left out
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(F.col("path").alias("source"), name.alias("filename"), text.alias("text")).filter(tx.strip(F.col("text")) != "")


def read_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """All text files below a folder; blank ones are left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return _decoded(df.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)))


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All files that fit a pattern, whatever their extension."""
    return _decoded(spark.read.format("binaryFile").load(pattern))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return read_glob(spark, path)


def raw(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows of plain text, named by a hash of how they begin."""
    return df.select(tx.text_source_label(F.col(column)).alias("source"), F.lit(None).cast("string").alias("filename"), F.col(column).alias("text"))


def read_urls(pages: DataFrame, urls: list[str] | None = None) -> DataFrame:
    """Fetched pages (url, html) as sources, as plain text; all, or those of a stated list of addresses."""
    from graphloom.operators import pages as pg

    asked = pages.filter(F.col("url").isin(urls)) if urls is not None else pages
    text = pg.texts(asked).withColumnRenamed("text", "_text")
    found = asked.select("page_id", "url").join(text.select("page_id", "_text"), "page_id")
    return found.select(F.col("url").alias("source"), F.lit(None).cast("string").alias("filename"), F.col("_text").alias("text")).filter(tx.strip(F.col("text")) != "")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records by extension: Parquet, JSON lines or CSV with a header."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if path.endswith((".csv", ".tsv")):
        return spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",")
    return spark.read.parquet(path)
