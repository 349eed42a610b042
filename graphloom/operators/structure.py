"""Structural features of a graph: degrees, clustering, rank, projections, communities, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.blocks import best_moves, later, strengths
from graphloom.operators.build import Graph
from graphloom.plans.lineage import cut


def degrees(g: Graph) -> DataFrame:
    """id, degree (edges), unique_neighbors, degree_entity, degree_concept, similar_count, avg_similarity, max_similarity of every record."""
    kinds = g.nodes.select(F.col("id").alias("dst"), F.col("type").alias("kind"))
    t = g.typed().join(kinds, "dst")
    sim = F.when(F.col("etype") == "SIMILAR_TO", F.col("weight"))
    each = t.groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("degree"), F.count_distinct("dst").alias("unique_neighbors"),
        F.count_distinct(F.when(F.col("kind") == "entity", F.col("dst"))).alias("degree_entity"), F.count_distinct(F.when(F.col("kind") == "concept", F.col("dst"))).alias("degree_concept"),
        F.count(sim).alias("similar_count"), F.coalesce(F.avg(sim), F.lit(0.0)).alias("avg_similarity"), F.coalesce(F.max(sim), F.lit(0.0)).alias("max_similarity"),
    )
    ints = ["degree", "unique_neighbors", "degree_entity", "degree_concept", "similar_count"]
    return g.nodes.filter("is_record").select("id", "ord").join(each, "id", "left").fillna(0, ints).fillna(0.0, ["avg_similarity", "max_similarity"])


def degree_by_type(g: Graph, etypes: list[str] | None = None) -> DataFrame:
    """One column for each edge type; NULL where a record has none.  Give the types for a stable schema."""
    records = g.nodes.filter("is_record").select(F.col("id").alias("src"))
    p = g.typed().join(records, "src", "left_semi").groupBy(F.col("src").alias("id"))
    p = p.pivot("etype", etypes) if etypes else p.pivot("etype")
    out = p.agg(F.count(F.lit(1)))
    return out.select("id", *(F.col(f"`{c}`").alias(f"{c}_degree") for c in out.columns if c != "id"))


def _hashed(g: Graph) -> DataFrame:
    """`adjacency` by hashes of ids: distinct v, w, both ways."""
    e = g.edges.select(F.xxhash64("src").alias("v"), F.xxhash64("dst").alias("w"))
    return e.unionByName(e.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct()


def triangles(adj: DataFrame, k: DataFrame) -> DataFrame:
    """u, x, y: every three nodes that are all linked, once each, from hashed neighbours (v, w) and degrees (v, k)."""
    # an edge goes from the end of smaller degree to the other, so no node sends many; each triangle is one wedge at its least node
    of = lambda c: k.select(F.col("v").alias(c), F.struct("k", F.col("v").alias("id")).alias(f"{c}_at"))
    up = cut(adj.filter("v < w").join(of("v"), "v").join(of("w"), "w").select(F.least("v_at", "w_at").alias("low"), F.greatest("v_at", "w_at").alias("high")))
    ends = up.select(F.col("low.id").alias("u"), F.col("high.id").alias("x"))
    wedge = ends.join(ends.select("u", F.col("x").alias("y")), "u").filter("x < y")
    linked = adj.filter("v < w").select(F.col("v").alias("x"), F.col("w").alias("y"))
    return wedge.join(linked, ["x", "y"], "left_semi")


def clustering(g: Graph) -> DataFrame:
    """Linked pairs among a record's neighbours over all such pairs, 0 below two neighbours."""
    h = g.nodes.filter("is_record").select("id", F.xxhash64("id").alias("v"))
    adj = cut(_hashed(g).filter("v <> w"))
    k = cut(adj.groupBy("v").agg(F.count("*").alias("k")))
    closed = triangles(adj, k)
    n = closed.select(F.explode(F.array("u", "x", "y")).alias("v")).groupBy("v").agg(F.count("*").alias("linked"))
    every = h.join(k, "v", "left").join(n, "v", "left")
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return every.select("id", F.coalesce(F.when(F.col("k") >= 2, F.coalesce("linked", F.lit(0)) / pairs), F.lit(0.0)).alias("clustering_coeff"))


def pagerank(g: Graph, damping: float = 0.85, steps: int = 20) -> DataFrame:
    """Synchronous rank over all nodes that have an edge, unweighted, from a uniform start."""
    adj = cut(_hashed(g))
    # nodes with equal neighbours keep equal ranks: each such class is one node, and its neighbours are classes with counts
    marks = (F.bit_xor("w").alias("x"), F.bit_xor(F.xxhash64("w")).alias("y"))
    own = cut(adj.groupBy("v").agg(F.count("*").alias("d"), *marks))
    same = cut(own.groupBy("d", "x", "y").agg(F.min("v").alias("c")))
    of = cut(own.join(same, ["d", "x", "y"]).select("v", "c", "d"))
    into = adj.join(same.select(F.col("c").alias("v")), "v", "left_semi").join(of.select(F.col("v").alias("w"), F.col("c").alias("from"), "d"), "w")
    links = cut(into.groupBy("from", F.col("v").alias("c")).agg((F.count("*") / F.first("d")).alias("share")))
    n = own.count()
    rank = same.select("c", F.lit(1.0 / max(n, 1)).alias("pr"))
    for i in range(steps):
        sent = links.join(rank.withColumnRenamed("c", "from"), "from").groupBy("c").agg(F.sum(F.col("pr") * F.col("share")).alias("s"))
        rank = sent.select("c", ((1 - damping) / n + damping * F.col("s")).alias("pr"))
        if i % 4 == 3:
            rank = cut(rank)
    ids = g.nodes.select("id", F.xxhash64("id").alias("v"))
    return ids.join(of.join(rank, "c").select("v", "pr"), "v").select("id", F.col("pr").alias("pagerank"))


def projection(g: Graph, method: str = "adamic_adar") -> DataFrame:
    """Pairs of records (a before b) that share features, weighted by adamic_adar, jaccard or shared_count."""
    records = g.nodes.filter("is_record").select("id")
    adj = g.adjacency()
    feats = adj.join(records, adj.src == records.id, "left_semi").join(records, adj.dst == records.id, "left_anti")
    degree = feats.groupBy("dst").agg(F.count("*").alias("d"))
    own = feats.groupBy("src").agg(F.count("*").alias("n"))
    f = feats.join(degree.filter("d > 1"), "dst")
    pairs = f.alias("x").join(f.alias("y"), (F.col("x.dst") == F.col("y.dst")) & (F.col("x.src") < F.col("y.src")))
    agg = pairs.groupBy(F.col("x.src").alias("a"), F.col("y.src").alias("b")).agg(F.count("*").alias("shared"), F.sum(1.0 / F.log(F.col("x.d").cast("double"))).alias("aa"))
    if method == "adamic_adar":
        return agg.select("a", "b", F.col("aa").alias("weight"))
    if method == "shared_count":
        return agg.select("a", "b", F.col("shared").cast("double").alias("weight"))
    if method != "jaccard":
        raise ValueError(f"unknown projection: {method}")
    sized = agg.join(own.select(F.col("src").alias("a"), F.col("n").alias("na")), "a").join(own.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("weight"))


def projection_totals(g: Graph, method: str = "adamic_adar") -> DataFrame:
    """a, pairs, weight: `projection` added up by a, over records with equal features at once; its pairs, most of all records' where a feature is a hub, are not made."""
    if method not in ("adamic_adar", "shared_count", "jaccard"):
        raise ValueError(f"unknown projection: {method}")
    records = g.nodes.filter("is_record").select("id", F.xxhash64("id").alias("s"))
    ends = g.ends().select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("n")).distinct()
    feats = cut(ends.join(records.select("s"), "s", "left_semi").join(records.select(F.col("s").alias("n")), "n", "left_anti"))
    degree = feats.groupBy("n").agg(F.count("*").alias("d")).filter("d > 1")
    sets = feats.join(degree, "n", "left").groupBy("s").agg(F.count("*").alias("own"), F.sort_array(F.collect_list(F.when(F.col("d").isNotNull(), F.col("n")))).alias("f"))
    sets = cut(sets.filter(F.size("f") > 0))
    kinds = cut(sets.groupBy("f", "own").agg(F.min("s").alias("c")))
    weight = 1.0 / F.log(F.col("d").cast("double")) if method == "adamic_adar" else F.lit(1.0)
    item = kinds.select("c", "own", F.explode("f").alias("n")).join(degree, "n").groupBy("c", "own").agg(F.sort_array(F.collect_list(F.struct("n", weight.alias("x")))).alias("l"))
    asked = cut(item.select("c", "own", F.col("l.n").alias("n"), F.col("l.x").alias("x")))
    ordered = sets.join(kinds, ["f", "own"]).select("s", "c").join(records, "s").select("id", "c")
    return later(asked, ordered, method == "jaccard").filter("pairs > 0").withColumnRenamed("id", "a")


def label_propagation(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """Each node takes the label most neighbours have, ties to the smallest, all at once, a fixed number of times."""
    adj = cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    labels = adj.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    for i in range(rounds):
        votes = adj.join(labels, adj.dst == labels.id).groupBy("src", "label").count()
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("label"))).alias("m"))
        labels = best.select(F.col("src").alias("id"), F.col("m.label").alias("label"))
        if i % 2 == 1:
            labels = cut(labels)
    return labels


def communities(g: Graph, resolution: float = 1.5, rounds: int = 8) -> DataFrame:
    """id, community_id, community_size of every record; -1 for those that share nothing.

    Greedy modularity on the unweighted projection, all nodes at once; in each round only
    the half that a hash selects may move, which keeps neighbours from swapping for ever.
    Records with equal neighbours are one weighted node, and blocks of such nodes meet as products, so a hub feature is not squared.
    """
    records = g.nodes.filter("is_record").select("id", "ord")
    adj = g.adjacency().join(records.select(F.col("id").alias("src")), "src", "left_semi")
    sig = adj.groupBy("src").agg(F.md5(F.concat_ws("\x00", F.sort_array(F.collect_set("dst")))).alias("sig"))
    members = cut(records.join(sig, records.id == sig.src))
    node = members.groupBy("sig").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    sets = cut(adj.join(sig, "src").select("sig", F.xxhash64("dst").alias("f")).distinct().groupBy("sig").agg(F.collect_list("f").alias("f")).join(node, "sig").select("sig", "f", "n", "first"))
    strength = cut(strengths(sets))
    total = strength.agg(F.sum("k")).first()[0] or 1.0
    state = cut(sets.join(strength, "sig").select("sig", "f", "n", "k", F.col("first").alias("c")))
    for i in range(rounds):
        move = F.pmod(F.hash("sig", F.lit(i)), F.lit(2)) == 0
        # staying put is always a candidate, with or without neighbours there
        state = cut(state.join(best_moves(state, resolution, total), "sig").select("sig", "f", "n", "k", F.when(move, F.col("to")).otherwise(F.col("c")).alias("c")))
    found = cut(members.join(state.select("sig", "c"), "sig").select("id", "ord", "c"))
    number = found.groupBy("c").agg(F.min("ord").alias("first"), F.count("*").alias("size"))
    number = number.select("c", "size", (F.row_number().over(Window.orderBy("first")) - 1).alias("number"))  # one row a community
    out = records.join(found.join(number, "c").select("id", "number", "size"), "id", "left")
    lone = out.filter("number is null").count()
    return out.select("id", F.coalesce("number", F.lit(-1)).alias("community_id"), F.coalesce("size", F.lit(lone)).alias("community_size"))


def walk_embeddings(g: Graph, walks: int = 5, length: int = 10, width: int = 32, q: float = 2.0, seed: int = 42) -> DataFrame:
    """Skip-gram vectors of random walks (return weight 1, outward weight 1/q), steps chosen by seeded hashes: id, vector, norm."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    paths = cut(walked(g, walks, length, q, seed).select(F.transform("path", lambda x: x.cast("string")).alias("path")))
    parts = max(1, paths.count() // WALKS)
    model = Word2Vec(vectorSize=width, windowSize=5, minCount=1, maxIter=5, numPartitions=parts, seed=seed, inputCol="path", outputCol="v").fit(paths)
    v = model.getVectors().select(F.col("word").cast("long").alias("h"), vector_to_array("vector").alias("vector"))
    v = g.nodes.select("id", F.xxhash64("id").alias("h")).join(v, "h").select("id", "vector")
    return v.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))


WALKS = 500_000  # paths that one task trains on


def walked(g: Graph, walks: int = 5, length: int = 10, q: float = 2.0, seed: int = 42) -> DataFrame:
    """first, walk, path: `walks` paths of `length` nodes (hashes of ids) from each node that has an edge.

    All edges lie in one order by node, so a node's neighbours are a run of places.  A step draws a place: either one of
    those that lead back or to a neighbour of the node before (weight 1), or one of the rest (weight 1/q).  So a
    step is one join by place and one row a walk, however many neighbours there are.
    """
    adj = cut(_hashed(g))
    k = cut(adj.groupBy("v").agg(F.count("*").alias("k")))
    parts = max(1, adj.rdd.getNumPartitions())
    placed = cut(adj.repartitionByRange(parts, "v", "w").sortWithinPartitions("v", "w").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, sizes = 0, {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # one number a partition
    offset = []
    for i in range(parts):
        offset.append(before)
        before += sizes.get(i, 0)
    place = cut(placed.select("v", "w", (F.element_at(F.array(*(F.lit(x).cast("long") for x in offset)), F.col("part") + 1) + F.col("at")).alias("at")))
    node = cut(place.groupBy("v").agg(F.min("at").alias("begin")).join(k, "v"))
    # for the edge v to w: the places in w's run of v and of what v and w have in common
    third = triangles(adj.filter("v <> w"), k)
    sides = (("u", "x", "y"), ("x", "y", "u"), ("y", "u", "x"))
    common = third.select(F.explode(F.array(*(F.struct(F.col(a).alias("v"), F.col(b).alias("w"), F.col(c).alias("z")) for x, y, z in sides for a, b, c in ((x, y, z), (y, x, z))))).alias("e")).select("e.*")
    near = common.unionByName(place.select(F.col("w").alias("v"), F.col("v").alias("w"), F.col("w").alias("z"))).distinct()
    near = near.join(place.select(F.col("v").alias("w"), F.col("w").alias("z"), F.col("at").alias("back")), ["w", "z"]).groupBy("v", "w").agg(F.sort_array(F.collect_set("back")).alias("near"))
    step_to = cut(place.join(near, ["v", "w"]).join(node.withColumnRenamed("v", "w"), "w").select("at", F.col("w").alias("to"), "begin", "k", "near"))
    walk = node.select(F.col("v").alias("first"), "begin", "k", F.array().cast("array<bigint>").alias("near"), F.array("v").alias("path"), F.explode(F.array(*map(F.lit, range(walks)))).alias("walk"))
    for step in range(length - 1):
        u = F.pmod(F.xxhash64("first", "walk", F.lit(step), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        n, far = F.size("near"), 1.0 if not step else 1.0 / q
        x = u * (n + (F.col("k") - n) * far)
        other = F.least(F.floor((x - n) / far), F.col("k") - n - 1)
        shifted = F.aggregate("near", F.col("begin") + other, lambda at, p: F.when(p <= at, at + 1).otherwise(at))
        at = F.when((x < n) | (F.col("k") == n), F.element_at("near", F.least(F.floor(x).cast("int"), n - 1) + 1)).otherwise(shifted)
        walk = walk.select("first", "walk", "path", at.alias("at")).join(step_to, "at").select("first", "walk", "begin", "k", "near", F.concat("path", F.array("to")).alias("path"))
        if step % 3 == 2:
            walk = cut(walk)
    return walk.select("first", "walk", "path")


def pairwise(g: Graph, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): shared neighbours, jaccard and adamic_adar over full neighbour sets."""
    adj = g.adjacency()
    degree = adj.groupBy("src").agg(F.count("*").alias("d"))
    both = pairs.join(adj.select(F.col("src").alias("a"), F.col("dst").alias("n")), "a").join(adj.select(F.col("src").alias("b"), F.col("dst").alias("n")), ["b", "n"])
    aa = F.when(F.col("d") > 1, 1.0 / F.log(F.col("d").cast("double"))).otherwise(0.0)
    shared = both.join(degree.withColumnRenamed("src", "n"), "n").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(aa).alias("adamic_adar"))
    out = pairs.join(shared, ["a", "b"], "left")
    for side in "ab":
        out = out.join(degree.select(F.col("src").alias(side), F.col("d").alias(f"d{side}")), side, "left")
    s = F.coalesce("shared", F.lit(0))
    union = F.coalesce("da", F.lit(0)) + F.coalesce("db", F.lit(0)) - s
    return out.select("a", "b", s.alias("shared"), F.when(union == 0, 0.0).otherwise(s / union).alias("jaccard"), F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"))


def compute_features(g: Graph, etypes: list[str] | None = None, community: bool = True, resolution: float = 1.5, walks: bool = False) -> DataFrame:
    """One row a record: degrees of all kinds, degrees by type (NULL where none), similarity counts, clustering, rank, and if asked communities and walk embeddings."""
    g = g.kept()
    out = degrees(g).join(degree_by_type(g, etypes), "id", "left").join(clustering(g), "id", "left").join(pagerank(g), "id", "left").fillna(0.0, ["pagerank"])
    if community:
        out = out.join(communities(g, resolution), "id", "left")
    return out.join(walk_embeddings(g), "id", "left") if walks else out


GROUPS = {"degree": r"(^|_)degree|unique_neighbors", "similarity": r"similar", "community": r"^community", "rank": r"pagerank|clustering", "peers": r"^rate_|_distance$", "embedding": r"embedding|^walk"}


def feature_report(table: DataFrame, nodes: int | None = None) -> dict:
    """Features by group with how many rows have each and its least, mean and greatest value; in one pass."""
    import re

    numeric = [c for c, t in table.dtypes if t in ("double", "float", "int", "bigint")]
    got = table.agg(F.count("*").alias("n"), *(f(F.col(f"`{c}`")).alias(f"{i}_{k}") for i, c in enumerate(numeric) for k, f in (("count", F.count), ("min", F.min), ("mean", F.avg), ("max", F.max)))).first()
    out: dict = {"entities": got["n"], "groups": {}, "warnings": []}
    for i, c in enumerate(numeric):
        group = next((k for k, p in GROUPS.items() if re.search(p, c)), "other")
        out["groups"].setdefault(group, {})[c] = {k: got[f"{i}_{k}"] for k in ("count", "min", "mean", "max")}
    if nodes and got["n"] < 0.5 * nodes and "pagerank" in numeric:
        out["warnings"].append("ranks are spread over all nodes, of which fewer than half are records")
    return out


def print_report(report: dict) -> str:
    lines = [f"{report['entities']} entities"]
    for group, features in report["groups"].items():
        lines += [f"{group}:", *(f"  {c}: {v['count']} rows, {v['min']} to {v['max']}, mean {v['mean']}" for c, v in features.items())]
    return "\n".join([*lines, *report["warnings"]])


def degenerate(found: DataFrame, least: int = 5) -> list[str]:
    """What is wrong with a set of communities, if anything."""
    n, groups = found.agg(F.count("*"), F.count_distinct(F.when(F.col("community_id") >= 0, F.col("community_id")))).first()
    if n < least:
        return []
    if not groups:
        return ["no communities: records share no features"]
    return [f"{groups} communities for {n} records: nearly every record is alone"] if groups / n >= 0.9 else []
