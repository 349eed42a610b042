"""Training sets without leakage, frozen graphs, and scoring against them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import build as b
from graphloom.operators import similar, structure
from graphloom.plans.lineage import cut


def _snapshots(events: DataFrame, dates: list[str]) -> DataFrame:
    """Every event once for each snapshot date; the dates are a stated, short list."""
    return events.withColumn("snapshot", F.explode(F.array(*(F.lit(d).cast("timestamp") for d in dates))))


def features(events: DataFrame, dates: list[str], c: b.Config) -> DataFrame:
    """snapshot, id, degree and n_events of every record as known at each date.

    All snapshots are one plan whose keys carry the date; nothing after a date
    enters its rows.
    """
    known = _snapshots(events, dates).filter(F.col(c.time_column) <= F.col("snapshot"))
    rows = b.records(known, c)
    parts = [(col, tx.node_id(col, tx.strip(F.col(col))), ~tx.is_null_word(F.col(col))) for col in c.categorical]
    from graphloom.functions import numeric

    parts += [(col, tx.node_id(f"{col}_range", numeric.bucket(F.col(col).cast("double"))), numeric.bucket(F.col(col).cast("double")).isNotNull()) for col in c.numeric]
    edges = F.filter(F.array(*(F.when(ok, F.struct(F.lit(col).alias("etype"), node.alias("dst"))) for col, node, ok in parts)), lambda x: x.isNotNull())
    each = rows.select("snapshot", F.col("_node").alias("id"), F.explode(edges).alias("e")).select("snapshot", "id", "e.*")
    # one pass: an event is counted apart from its edges, so that joins are not needed
    degree = each.distinct().groupBy("snapshot", "id").agg(F.count("*").alias("degree"))
    n = rows.groupBy("snapshot", F.col("_node").alias("id")).agg(F.count("*").alias("n_events"))
    return n.join(degree, ["snapshot", "id"], "left").select("snapshot", "id", F.coalesce("degree", F.lit(0)).alias("degree"), "n_events")


def labels(events: DataFrame, dates: list[str], c: b.Config, label_column: str, label_value: str | None = None, horizon: int = 180) -> DataFrame:
    """snapshot, id, label of every record seen in (date, date + horizon days]; without an end if the horizon is 0.

    1 if any event's cell contains `label_value`, else 0; without one, the sorted distinct values.
    """
    s = _snapshots(events, dates)
    end = F.col("snapshot") + F.expr(f"interval {horizon} days")
    later = s.filter((F.col(c.time_column) > F.col("snapshot")) & (F.lit(horizon <= 0) | (F.col(c.time_column) <= end)))
    rows = b.records(later, c).groupBy("snapshot", F.col("_node").alias("id"))
    cell = F.col(label_column).cast("string")
    if label_value is not None:
        return rows.agg(F.max(F.contains(F.lower(cell), F.lower(F.lit(label_value))).cast("int")).alias("label"))
    return rows.agg(F.array_join(F.sort_array(F.collect_set(cell)), ",").alias("label"))


def dataset(events: DataFrame, dates: list[str], c: b.Config, label_column: str, label_value: str, horizon: int = 180) -> DataFrame:
    """snapshot, id, degree, n_events and label of every record known at each date; label 0 where nothing followed."""
    y = labels(events, dates, c, label_column, label_value, horizon)
    return features(events, dates, c).join(y, ["snapshot", "id"], "left").fillna(0, ["label"])


@dataclass
class Frozen:
    """A graph as it was: node and edge tables in a folder, with what scoring needs to agree with training."""

    path: str
    graph: b.Graph
    etypes: list[str]
    values: list[str]
    k: int

    def unfreeze(self) -> b.Graph:
        self.graph.frozen = False
        return self.graph


def freeze(g: b.Graph, path: str, owned: DataFrame | None = None, k: int = 5) -> Frozen:
    """Writes the graph and fixes the schema of its features."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = g.nodes.sparkSession
    kept = b.Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), g.config, True)
    etypes = sorted(r[0] for r in kept.edges.select("etype").distinct().collect())
    values = sorted(r[0] for r in owned.filter(~tx.is_null_word(F.col("value"))).select("value").distinct().collect()) if owned is not None else []
    meta = spark.createDataFrame([(json.dumps({"version": 2, "etypes": etypes, "values": values, "k": k}),)], "value string")
    meta.coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return Frozen(path, kept, etypes, values, k)


def known_nodes(f: Frozen, new: DataFrame) -> DataFrame:
    """id, n: the feature nodes of new records that the frozen graph has.  Values are canonicalised as in the build."""
    rows = b.projected(new, f.graph.config).select("src", tx.node_id(F.col("kind"), F.col("label")).alias("n"), "etype").distinct()
    have = f.graph.nodes.filter("type <> 'entity' or not is_record").select(F.col("id").alias("n"))
    return rows.join(have, "n", "left_semi").select(F.col("src").alias("id"), "n", "etype")


def peers(f: Frozen, new: DataFrame) -> DataFrame:
    """id, peer, rank, distance of the k frozen records nearest to each new one by Jaccard distance of feature nodes."""
    sets = similar.neighbour_sets(f.graph, features_only=True)
    sig = cut(similar.signatures(sets))
    known = known_nodes(f, new).groupBy("id").agg(F.sort_array(F.collect_set(F.xxhash64("n"))).alias("f"))
    mine = cut(known.withColumn("a", F.xxhash64("f")))  # new records of equal features are one question
    near = similar.nearest(mine.select("a", "f").dropDuplicates(["a"]), sig.select(F.col("first").alias("b"), "f"), f.k, sharing=True)
    close = near.join(similar.members(sets, sig, f.k), "b")
    w = Window.partitionBy("a").orderBy("distance", "peer_ord")
    top = close.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= f.k)
    return cut(mine.select("id", "a").join(top, "a").select("id", "peer", "rank", "distance"))


def peer_communities(found: DataFrame, communities: DataFrame) -> DataFrame:
    """id, community_id, community_size: the community that most peers are in, ties to the nearest peer's; -1 counts as size 0."""
    at = found.join(communities.select(F.col("id").alias("peer"), "community_id", "community_size"), "peer")
    votes = at.groupBy("id", "community_id").agg(F.count("*").alias("n"), F.min("rank").alias("near"), F.max("community_size").alias("size"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "near", "community_id", "size")).alias("m"))
    return best.select("id", F.col("m.community_id").alias("community_id"), F.when(F.col("m.community_id") >= 0, F.col("m.size")).otherwise(0).alias("community_size"))


def score_batch(f: Frozen, new: DataFrame, owned: DataFrame, found: DataFrame | None = None, communities: DataFrame | None = None, with_peers: bool = False) -> DataFrame:
    """Training's columns for new records: degree, degrees by type and rates over the frozen catalogue, 0 where absent; if asked, the peers' community and their ids, nearest first."""
    found = peers(f, new) if found is None else found
    known = known_nodes(f, new)
    ids = b.records(new, f.graph.config).select(F.col("_node").alias("id")).distinct()
    degree = known.groupBy("id").agg(F.count_distinct("n").alias("degree"), *(F.count(F.when(F.col("etype") == e, 1)).alias(f"{e}_degree") for e in f.etypes))
    votes = found.join(owned.select(F.col("id").alias("peer"), "value"), "peer").groupBy("id", "value").agg(F.count("*").alias("v"))
    n = found.groupBy("id").agg(F.count("*").alias("peers"), F.avg("distance").alias("avg_distance"), F.min("distance").alias("min_distance"))
    rates = votes.join(n, "id").groupBy("id").agg(*(F.coalesce(F.max(F.when(F.col("value") == v, F.col("v") / F.col("peers"))), F.lit(0.0)).alias(f"rate_{v}") for v in f.values)) if f.values else ids
    out = ids.join(degree, "id", "left").join(n.drop("peers"), "id", "left").join(rates, "id", "left")
    if communities is not None:
        out = out.join(peer_communities(found, communities), "id", "left").fillna(-1, ["community_id"])
    out = out.fillna(0)
    if with_peers:
        near = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "peer"))).alias("p"))  # k at most
        out = out.join(near.select("id", F.array_join(F.transform("p", lambda x: x["peer"]), ",").alias("knn_peers")), "id", "left")
    return out


def score_one(f: Frozen, new: DataFrame, owned: DataFrame) -> dict:
    row = score_batch(f, new.limit(1), owned).first()
    return row.asDict() if row else {}


def write_features(table: DataFrame, path: str, snapshot: str | None = None) -> None:
    """A feature table with its description beside it."""
    table.write.mode("overwrite").parquet(f"{path}/features")
    meta = json.dumps({"version": 2, "snapshot_date": snapshot, "features": [c for c in table.columns if c != "id"], "entity_count": table.count()})
    table.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_features(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/features")


__all__ = ["Frozen", "features", "freeze", "known_nodes", "labels", "peers", "read_features", "score_batch", "score_one", "structure", "write_features"]
