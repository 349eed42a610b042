"""Structured Streaming forms of upsert, scoring and log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from graphloom.operators import build, temporal
from graphloom.functions import text as tx


def upsert_edges(records: DataFrame, config: build.Config, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch's edges under its own number, so that a repeated batch replaces itself; `current_edges` merges them."""

    def write(batch: DataFrame, number: int) -> None:
        e = build.projected(batch, config).withColumn("dst", tx.node_id(F.col("kind"), F.col("label")))
        build.upsert(e).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_edges(spark, path: str) -> DataFrame:
    return build.upsert(spark.read.parquet(path).drop("batch"))


def score(records: DataFrame, frozen: temporal.Frozen, owned: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """New records scored against the frozen tables, batch by batch."""

    def write(batch: DataFrame, number: int) -> None:
        temporal.score_batch(frozen, batch, owned).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def log_windows(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Requests and totals by window and kind; rows later than the watermark are dropped."""
    g = events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), F.col(kind).alias("kind"))
    return g.agg(F.count("*").alias("requests"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "kind", "requests", "total")
