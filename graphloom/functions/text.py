"""Column expressions over strings: node ids, null words, lists, labels, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_WORDS = ("", "none", "null", "nan", "n/a", "na", "unknown", "-")
_EDGE_SPACE = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at both ends, tabs and line ends included."""
    return F.regexp_replace(c.cast("string"), _EDGE_SPACE, "")


def node_id(kind: Column | str, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return strip(F.lower(F.concat(kind, F.lit(":"), value.cast("string"))))


def is_null_word(c: Column) -> Column:
    """True for NULL and for words that stand for a missing value."""
    return c.isNull() | F.lower(strip(c)).isin(*NULL_WORDS)


def items(c: Column, is_array: bool = False) -> Column:
    """Items of a comma list (or of an array): trimmed, without empty ones and null words."""
    parts = F.coalesce(c, F.array().cast("array<string>")) if is_array else F.split(F.coalesce(c.cast("string"), F.lit("")), ",")
    return F.filter(F.transform(parts, strip), lambda x: ~is_null_word(x))


def cell_items(c: Column, is_array: bool = False) -> Column:
    """As `items`, but only empty items go; for target columns, where a word like "none" is a value."""
    parts = F.coalesce(c, F.array().cast("array<string>")) if is_array else F.split(F.coalesce(c.cast("string"), F.lit("none")), ",")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def node_label(kind: Column, label: Column) -> Column:
    """How a node reads in explanations: label, column=label, and ranges without their suffix."""
    return F.when(kind.isin("entity", "concept"), label).otherwise(F.concat(F.replace(kind, F.lit("_range"), F.lit("")), F.lit("="), label))


def canonicalise(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replaces a column by its canonical form where `aliases` (alias, canonical) has one, ignoring case and outer space."""
    names = aliases.groupBy(F.lower(strip(F.col("alias"))).alias("_alias")).agg(F.min("canonical").alias("_canonical"))
    out = df.join(names, F.lower(strip(F.col(column))) == F.col("_alias"), "left")
    return out.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def shorten(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def vector_id(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, 32)


def text_source_label(c: Column) -> Column:
    return F.concat(F.lit("text:"), F.substring(F.md5(F.substring(c, 1, 100)), 1, 8))


def json_part(c: Column) -> Column:
    """JSON inside a reply: a fenced block, else from the first { to the last } if that parses, else the text."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    carved = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when((carved != "") & F.try_parse_json(carved).isNotNull(), carved).otherwise(c)


def phrases(c: Column, most: int = 10) -> Column:
    """Capitalised phrases of a text in order of appearance, lower-cased, at most `most` distinct ones."""
    found = F.regexp_extract_all(c, F.lit(r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"), 1)
    return F.slice(F.array_distinct(F.transform(found, F.lower)), 1, most)
