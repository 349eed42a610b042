"""Column profiling: one pass of conditional aggregates, then rules on a handful of numbers a column."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import numeric
from graphloom.functions import text as tx

ID_NAMES = ("id", "account_id", "customer_id", "user_id", "record_id", "entity_id")
_URL, _PHONE, _UUID = r"(?i)^https?://", r"^[+(]", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_DATE = r"^(\d{4}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}/\d{2}/\d{2}|[A-Z][a-z]{2,8} \d{1,2}, \d{4})"


def long_form(df: DataFrame) -> DataFrame:
    """(column, value as text) of every cell; a date-like cell reads as Spark prints it."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def measures(df: DataFrame) -> DataFrame:
    """For each column: rows, nulls, distinct values, and how many values read as each kind."""
    v = tx.strip(F.col("value"))
    given = ~(F.col("value").isNull() | v.isin("", "nan", "None"))
    n = lambda when, name: F.count(F.when(given & when, 1)).alias(name)
    yes = F.lit(True)
    return long_form(df).groupBy("column").agg(
        F.count("*").alias("n_rows"), n(yes, "n_given"), F.count_distinct(F.when(given, v)).alias("n_distinct"),
        n(numeric.parse(v).isNotNull(), "n_numeric"), n(v.rlike(_URL), "n_url"), n(v.rlike(_PHONE), "n_phone"), n(v.rlike(_UUID), "n_uuid"), n(v.rlike(_DATE), "n_date"), n(F.contains(v, F.lit(",")), "n_list"),
        F.coalesce(F.avg(F.when(given, F.length(v))), F.lit(0.0)).alias("avg_length"), F.coalesce(F.avg(F.when(given, F.size(F.split(v, ",")))), F.lit(0.0)).alias("avg_items"),
    )


def roles(m: DataFrame, id_column: str | None = None, text_length: float = 50, most_values: int = 50) -> DataFrame:
    """The measures with a role for each column; rules apply in this order."""
    r = lambda c: F.col(c) / F.col("n_given")
    role = F.when(F.col("n_given") < 0.1 * F.col("n_rows"), "skip")
    if id_column:
        role = role.when(F.col("column") == id_column, "id")
    role = role.when(r("n_numeric") > 0.8, "numeric")
    for c in ("n_url", "n_phone", "n_uuid"):
        role = role.when(r(c) > 0.5, "skip")
    role = role.when(r("n_date") > 0.6, "date").when(F.col("avg_length") > text_length, "text").when(r("n_list") > 0.3, "list")
    return m.withColumn("role", role.otherwise("categorical"))


def id_candidates(m: DataFrame) -> DataFrame:
    """Columns by how well they serve as id: a usual name with over 0.9 distinct first, then over 0.95 distinct."""
    share = F.col("n_distinct") / F.col("n_rows")
    named = F.col("column").isin(*ID_NAMES) | F.col("column").endswith("_id")
    return m.select("column", F.when(named & (share > 0.9), 1).when(share > 0.95, 2).otherwise(3).alias("tier"), F.round(share, 6).alias("distinct_rate"))


def detect_id(df: DataFrame, rows: int = 100) -> str:
    head = measures(df.limit(rows))
    order = {c: i for i, c in enumerate(df.columns)}
    return min(id_candidates(head).collect(), key=lambda r: (r["tier"], order[r["column"]]))["column"]


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of each column; ties to the smaller value."""
    counts = long_form(df).filter("value is not null").groupBy("column", "value").count()
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("column", "value", F.col("count").alias("n"), "rank")


def sentinel_zero(df: DataFrame, columns: list[str], rate: float = 0.3) -> DataFrame:
    """Numeric columns and whether so many of their numbers are 0 that 0 means missing."""
    x = numeric.parse(F.col("value"))
    m = long_form(df.select(*columns)).groupBy("column").agg(F.count(x).alias("n_numbers"), F.count(F.when(x == 0, 1)).alias("n_zero"))
    return m.withColumn("is_sentinel", (F.col("n_numbers") > 0) & (F.col("n_zero") >= rate * F.col("n_numbers")))


def warnings(df: DataFrame, lists: list[str] = ()) -> DataFrame:
    """Columns that make a poor graph, with the reason."""
    m = measures(df)
    reason = F.when(F.col("n_given") < 0.5 * F.col("n_rows"), "mostly null").when(F.col("n_distinct") == 1, "1 unique").when((F.col("n_rows") > 20) & (F.col("n_distinct") > 0.95 * F.col("n_given")), "nearly unique")
    if lists:
        reason = reason.when(F.col("column").isin(*lists) & (F.col("avg_items") < 0.5), "empty lists")
    return m.withColumn("warning", reason).filter("warning is not null").select("column", "warning", "n_rows", "n_given", "n_distinct")


@dataclass
class Dictionary:
    """Roles of the columns of a table, open to correction before a graph is built."""

    roles: dict[str, str]
    stats: dict[str, dict[str, Any]] = field(default_factory=dict)

    def set_type(self, column: str, role: str) -> Dictionary:
        if column not in self.roles:
            raise KeyError(column)
        self.roles[column] = role
        return self

    def by_role(self, role: str) -> list[str]:
        return [c for c, r in self.roles.items() if r == role]

    def review(self) -> list[str]:
        """Columns whose role is uncertain."""
        s = self.stats
        return [c for c, r in self.roles.items() if (r == "categorical" and s.get(c, {}).get("n_distinct", 0) > 30) or (r == "list" and s.get(c, {}).get("avg_items", 9) < 1.5)]

    def summary(self) -> str:
        return "\n".join(f"{c}: {r}" for c, r in self.roles.items())

    def to_dict(self) -> dict[str, Any]:
        return {c: {"role": r} | self.stats.get(c, {}) for c, r in self.roles.items()}


def profile(df: DataFrame, id_column: str | None = None, sample: int | None = 100, reviewer=None, **rules) -> Dictionary:
    """The dictionary of a table, from its first `sample` rows (all if None)."""
    some = df.limit(sample) if sample else df
    chosen = id_column or detect_id(df)
    rows = {r["column"]: r.asDict() for r in roles(measures(some), chosen, **rules).collect()}
    out = Dictionary({c: rows[c]["role"] for c in df.columns if c in rows}, rows)
    return reviewer(out) or out if reviewer else out
