"""Message history by session and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def create_messages(spark, table: str = "messages") -> None:
    spark.sql(f"create table if not exists {table} (session_id string, message_index int, message_data string, created_at timestamp) using parquet")


def get_messages(messages: DataFrame, session) -> DataFrame:
    return messages.filter(F.col("session_id") == session).orderBy("message_index")


def save_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the sessions of `new` replaced whole."""
    return messages.join(new.select("session_id").distinct(), "session_id", "left_anti").unionByName(new)


def list_sessions(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.max("created_at").alias("last_updated")).orderBy(F.desc("last_updated"), "session_id")


def delete_session(messages: DataFrame, session) -> DataFrame:
    return messages.filter(~F.col("session_id").eqNullSafe(F.lit(session)))


def get_logs(logs: DataFrame, limit: int = 20, page: int = 1, order: str = "id", **equal) -> DataFrame:
    """A page of the logs that have these values, newest id first."""
    for c, v in equal.items():
        if v is not None:
            logs = logs.filter(F.col(c) == v)
    w = Window.orderBy(F.desc(order))
    top = logs.orderBy(F.desc(order)).limit(limit * page)  # only pages up to this one are ranked
    return top.withColumn("row", F.row_number().over(w)).filter((F.col("row") > limit * (page - 1)) & (F.col("row") <= limit * page))


def get_log(logs: DataFrame, log_id, key: str = "id") -> DataFrame:
    return logs.filter(F.col(key) == log_id)


def add_feedback(logs: DataFrame, feedback: DataFrame, key: str = "id") -> DataFrame:
    """Logs with score and feedback where given, else as they were."""
    f = feedback.select(key, F.col("score").alias("_s"), F.col("feedback").alias("_f"))
    for c, t in (("score", "double"), ("feedback", "string")):
        if c not in logs.columns:
            logs = logs.withColumn(c, F.lit(None).cast(t))
    return logs.join(f, key, "left").withColumn("score", F.coalesce("_s", "score")).withColumn("feedback", F.coalesce("_f", "feedback")).drop("_s", "_f")


def analytics(logs: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", start=None, end=None, every: str = "1 day") -> DataFrame:
    """Requests and totals for each interval and kind."""
    if start is not None:
        logs = logs.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        logs = logs.filter(F.col(time) < F.lit(end).cast("timestamp"))
    g = logs.groupBy(F.window(time, every).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("requests"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), "kind", "requests", "total")


def totals(logs: DataFrame, kind: str = "event_type", value: str = "value") -> DataFrame:
    """Requests and totals by kind and over all (kind NULL)."""
    return logs.rollup(F.col(kind).alias("kind")).agg(F.count("*").alias("requests"), F.sum(value).alias("total"))


def delete_logs(logs: DataFrame) -> DataFrame:
    return logs.limit(0)
