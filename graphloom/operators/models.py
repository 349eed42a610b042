"""A catalogue of language models as a small table, with choice rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, family string, context int, tools boolean, vision boolean, reasoning boolean, json boolean, speed string, best_for array<string>"
#: Callers bring their own rows; these show the shape.
SAMPLE = [
    ("large-chat", "chat", 131072, True, False, False, True, "medium", ["structured", "agents"]),
    ("small-chat", "chat", 32768, True, False, False, True, "fast", ["classification"]),
    ("thinker", "reasoning", 65536, False, False, True, False, "slow", ["planning"]),
    ("viewer", "vision", 131072, True, True, False, True, "medium", ["images"]),
]
FLAGS = ("tools", "vision", "reasoning", "json")


def table(spark: SparkSession, rows: list[tuple] = SAMPLE) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def list_models(models: DataFrame, family: str | None = None, capability: str | None = None) -> DataFrame:
    if family:
        models = models.filter(F.col("family") == family)
    if capability:
        models = models.filter(F.col(capability) if capability in FLAGS else F.array_contains("best_for", capability))
    return models


def recommend_model(models: DataFrame, task: str = "structured", speed: str | None = None, schema_size: int = 0) -> str | None:
    """The first that suits the task and speed, with the largest context if the schema is large."""
    fit = models.withColumn("miss", F.when(F.array_contains("best_for", task), 0).otherwise(1) + (F.when(F.col("speed") == speed, 0).otherwise(1) if speed else F.lit(0)))
    order = [F.desc("context")] if schema_size > 4000 else ["miss", F.desc("context")]
    row = fit.orderBy(*order, "name").first()
    return row["name"] if row else None
