"""Features of every record relative to a group of reference records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import similar
from graphloom.operators.build import Graph
from graphloom.plans.lineage import cut

CAP = 10


def group(g: Graph, rows: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Ids of the records whose cells contain all these texts, ignoring case; all records without filters.  `rows` has id and the columns."""
    out = rows
    for c, v in filters.items():
        out = out.filter(F.contains(F.lower(F.col(c).cast("string")), F.lower(F.lit(v))))
    return out.select("id").distinct()


def neighbours(g: Graph, kind: str | None = None) -> DataFrame:
    """Distinct (id, n) of every record, of one node type if given."""
    adj = g.adjacency().join(g.nodes.filter("is_record").select(F.col("id").alias("src")), "src", "left_semi")
    if kind:
        adj = adj.join(g.nodes.filter(F.col("type") == kind).select(F.col("id").alias("dst")), "dst", "left_semi")
    return adj.select(F.col("src").alias("id"), F.col("dst").alias("n"))


def _value(g: Graph, found: DataFrame, value) -> DataFrame:
    return g.nodes.filter("is_record").select("id").join(found, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).cast("double").alias("value"))


def shared_count(g: Graph, ref: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes in common with the group; 0 for its members."""
    n = neighbours(g, kind)
    union = n.join(ref, "id", "left_semi").select("n").distinct()
    found = n.join(union, "n", "left_semi").join(ref, "id", "left_anti").groupBy("id").agg(F.count("*").alias("c"))
    return _value(g, found, F.col("c"))


def overlap_rate(g: Graph, ref: DataFrame, kind: str | None = None) -> DataFrame:
    """Jaccard similarity of a record's nodes with the group's."""
    n = neighbours(g, kind)
    union = n.join(ref, "id", "left_semi").select("n").distinct()
    size = union.count()
    own = n.groupBy("id").agg(F.count("*").alias("d"))
    both = n.join(union, "n", "left_semi").groupBy("id").agg(F.count("*").alias("c"))
    found = own.join(both, "id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return _value(g, found, F.col("c") / F.greatest(F.col("d") + size - F.col("c"), F.lit(1)))


def adoption_rate(g: Graph, found: DataFrame, owned: DataFrame, target: str) -> DataFrame:
    """The share of a record's nearest peers that have the target value."""
    return _value(g, similar.rates(found, owned, [target]).select("id", "rate"), F.col("rate"))


def distance_to_nearest(g: Graph, ref: DataFrame, cap: int = CAP) -> DataFrame:
    """Edges to the nearest member, found for all records by one search outwards from the whole group; `cap` if there is none so near."""
    adj = cut(g.adjacency())
    seen = cut(ref.select("id", F.lit(0).alias("hop")))
    last = seen
    for h in range(1, cap):
        last = cut(adj.join(last.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)))
        if last.isEmpty():
            break
        seen = cut(seen.unionByName(last))
    out = g.nodes.filter("is_record").select("id").join(seen, "id", "left")
    return out.select("id", F.coalesce("hop", F.lit(cap)).cast("double").alias("value"))


def subgraph_degree(g: Graph, ref: DataFrame, kind: str | None = None) -> DataFrame:
    """Neighbours inside the group or among its nodes."""
    n = neighbours(g, kind)
    inside = n.join(ref, "id", "left_semi").select("n").unionByName(ref.select(F.col("id").alias("n"))).distinct()
    return _value(g, n.join(inside, "n", "left_semi").groupBy("id").agg(F.count("*").alias("c")), F.col("c"))


def reference_rate(g: Graph, ref: DataFrame, target: str) -> DataFrame:
    """The group's rate of a target node, weighted by 0.5 + 0.5 * overlap with the group."""
    size = ref.count()
    has = g.adjacency().filter(F.col("dst") == target).join(ref.withColumnRenamed("id", "src"), "src", "left_semi").count()
    rate = has / size if size else 0.0
    return overlap_rate(g, ref).select("id", F.round(F.lit(rate) * (0.5 + 0.5 * F.col("value")), 4).alias("value"))


def co_occurrence_lift(g: Graph, target: str) -> DataFrame:
    """The greatest lift of any of a record's feature nodes with the target node."""
    features = neighbours(g).join(g.nodes.filter("type <> 'entity'").select(F.col("id").alias("n")), "n", "left_semi")
    total = float(g.nodes.filter("is_record").count())
    holders = features.filter(F.col("n") == target).select("id")
    nt = holders.count()
    count = features.groupBy("n").agg(F.count("*").alias("c"))
    both = features.join(holders, "id", "left_semi").groupBy("n").agg(F.count("*").alias("both"))
    lift = count.join(both, "n").filter(F.col("n") != target).select("n", (F.col("both") * total / (F.col("c") * max(nt, 1))).alias("lift"))
    return _value(g, features.join(lift, "n").groupBy("id").agg(F.max("lift").alias("m")), F.round("m", 4))


def compute(name: str, g: Graph, **arguments) -> DataFrame:
    """One of the seven computations by name."""
    table = {f.__name__: f for f in (shared_count, overlap_rate, adoption_rate, distance_to_nearest, subgraph_degree, reference_rate, co_occurrence_lift)}
    if name not in table:
        raise ValueError(f"unknown computation: {name}; one of {', '.join(sorted(table))}")
    arguments.pop("aggregation", None)
    return table[name](g, **arguments)


def degenerate(values: DataFrame) -> float:
    """The share of the most frequent value; 0.8 and more says little."""
    n = values.count()
    top = values.groupBy("value").count().agg(F.max("count")).first()[0]
    return (top or 0) / n if n else 0.0


def from_text(question: str, g: Graph, parser, **arguments) -> DataFrame:
    """Computes what `parser` (text to a dict with `computation`) makes of a question."""
    spec = dict(parser(question))
    return compute(spec.pop("computation"), g, **{**arguments, **spec})
